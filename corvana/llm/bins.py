"""Problem 7: filling fixed-capacity containers by swap-based local search.

Texts are measured in tokens; a text larger than the capacity becomes full parts and a remainder, all others stay
whole. Items are spread by a seeded hash over groups of about `group` items, which are packed independently (a group
is bounded in size and any group can be recomputed alone). Within a group best-fit-decreasing gives the start; then
local search increases the sum of squared fills: from the emptiest bin on, a document moves into a fuller bin, or is
exchanged one for one or two for one with smaller documents of a fuller bin, until the emptiest bins are gone.
A group leaves one underfull bin on average, that is group * mean size / capacity bins to one.

Defined results: null and empty texts have 0 tokens and lie in a container like any other; repeated rows are items of
their own, each full part in a container of its own; null ids are packed too; an empty table gives no containers; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.tokens import VOCABULARY, counted
from corvana.session import stored


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: bins as lists of item numbers."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (space left, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            space, b = free.pop(at)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(free, (space - sizes[i], b))
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search on the underfull bins until no step is left; every accepted step raises the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        order = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: fill[b])
        for at, low in enumerate(order):
            for i in sorted(bins[low], key=lambda i: -sizes[i]):
                for high in reversed(order[at + 1 :]):
                    slack = capacity - fill[high]
                    if not slack or fill[high] < fill[low] or not bins[high]:
                        continue
                    gain, give = 0, None
                    if sizes[i] <= slack:
                        gain, give = sizes[i], []
                    else:
                        least = sizes[i] - slack  # what must leave `high`, and less than sizes[i]
                        own = sorted(bins[high], key=lambda j: sizes[j])
                        for j in own:  # one for one
                            if least <= sizes[j] < sizes[i] and sizes[i] - sizes[j] > gain:
                                gain, give = sizes[i] - sizes[j], [j]
                        lo, hi = 0, len(own) - 1  # two for one
                        while lo < hi:
                            two = sizes[own[lo]] + sizes[own[hi]]
                            if two < least:
                                lo += 1
                            else:
                                if two < sizes[i] and sizes[i] - two > gain:
                                    gain, give = sizes[i] - two, [own[lo], own[hi]]
                                hi -= 1
                    if gain > 0:
                        bins[low].remove(i)
                        for j in give:
                            bins[high].remove(j)
                        bins[high].append(i)
                        bins[low].extend(give)
                        fill[high] += gain
                        fill[low] -= gain
                        changed = True
                        break
    return [b for b in bins if b]


def packed(documents: DataFrame, capacity: int = 2048, group: int = 4000, seed: int = 17, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, tokens, container, space_left): the container of every text, or of every part of a larger one."""
    sized = counted(documents, ["doc_id"], path=path)
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity))
    items = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"))
    items = items.withColumn("tokens", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part") * capacity))
    items = stored(items.withColumns({"full": F.col("tokens") == capacity, "u": F.monotonically_increasing_id()}), "items")
    small = items.where(~F.col("full"))
    groups = max(1, round(small.count() / group))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "part", "u"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["tokens"].tolist()
        bins = improve(first_fit(sizes, capacity), sizes, capacity)
        name, left = [""] * len(sizes), [0] * len(sizes)
        for n, b in enumerate(bins):
            space = capacity - sum(sizes[i] for i in b)
            for i in b:
                name[i], left[i] = f"g{key[0]}-{n}", space
        return pdf.assign(container=name, space_left=left)[["doc_id", "part", "tokens", "container", "space_left"]]

    schema = "doc_id long, part int, tokens long, container string, space_left long"
    spread = small.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "part", "u"), F.lit(groups)).cast("int"))
    shared = spread.repartition(groups, "g").groupBy("g").applyInPandas(pack, schema)  # a number of its own, so that small groups are not put into one task
    alone = items.where("full").select("doc_id", "part", "tokens", F.format_string("f%d", "u").alias("container"), F.lit(0).cast("long").alias("space_left"))
    return shared.unionByName(alone)


def report(documents: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """One row: items, tokens, containers, the least possible number of containers, and the space left in all."""
    p = packed(documents, capacity, **options)
    one = p.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return one.agg(
        F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("tokens") / capacity).alias("least_containers"), (F.count(F.lit(1)) * capacity - F.sum("tokens")).alias("space_left"),
    )
