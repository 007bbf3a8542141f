"""Problem 8: mixing sources to target weights by hierarchical budgeting.

The targets' sources are leaves of a tree root - domain - language - source; a source's domain and language are the
ones of most of its tokens (language: before the hyphen; domain: the lower-cased category; unknown ones are '?').
Budgets flow down the tree by weight; a leaf holds at most its tokens times its allowed repeats, and what it cannot
take goes to its siblings by weight, then to the siblings of its language, of its domain, and so on upwards. Only
one row per source reaches the driver (the target table's size, checked against `most_sources`).

A leaf's texts are used in seeded epochs: whole epochs first, then the prefix, in the seeded order of one more epoch,
that comes nearest to the remaining tokens. The prefix is found with sums of hash ranges first and only then inside the
one range where it ends, so a source with a third of all rows is never gathered in one task.

The total is a parameter; by default it is the largest total at which every source that has any text reaches its share,
but no less than `floor` times the tokens of the targeted sources (below that, tiny sources stay short and are reported).

Defined results: texts of sources without a target, of a null source or without tokens are used 0 times; a target
without texts has the actual share 0; repeated target rows count as one with the summed share; repeated document rows
are texts of their own; an empty table on either side gives an empty plan or zero shares; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvana.llm.tokens import VOCABULARY, counted
from corvana.session import stored


def spread(weights: dict, room: dict, budget: float) -> dict:
    """Water-filling: `budget` by weight, no one beyond its room; what is left over stays with the caller."""
    got = dict.fromkeys(weights, 0.0)
    active = {k for k, w in weights.items() if w > 0 and room[k] > 0}
    left = budget
    while active and left > 1e-9:
        total = sum(weights[k] for k in active)
        full = {k for k in active if room[k] - got[k] <= left * weights[k] / total + 1e-9}
        if not full:
            for k in active:
                got[k] += left * weights[k] / total
            return got
        for k in full:
            left -= room[k] - got[k]
            got[k] = room[k]
        active -= full
    return got


def budgets(leaves: list[dict], total: float) -> dict[str, float]:
    """Tokens for every source. leaves: source, domain, language, share, room. Each node first keeps its own weight's
    part; a shortage inside a node is offered to the node's other children before it goes up."""
    scale = sum(x["share"] for x in leaves) or 1.0
    want = {x["source"]: total * x["share"] / scale for x in leaves}
    room = {x["source"]: x["room"] for x in leaves}
    share = {x["source"]: x["share"] for x in leaves}
    got = {s: min(want[s], room[s]) for s in want}
    for path in (lambda x: (x["domain"], x["language"]), lambda x: (x["domain"],), lambda x: ()):
        nodes = defaultdict(list)
        for x in leaves:
            nodes[path(x)].append(x["source"])
        for members in nodes.values():
            short = sum(want[s] for s in members) - sum(got[s] for s in members)
            if short > 1e-9:
                more = spread({s: share[s] for s in members}, {s: room[s] - got[s] for s in members}, short)
                for s in members:
                    got[s] += more[s]
    return got


def _leaf(documents: DataFrame, targets: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    sized = stored(counted(documents.withColumn("category", F.lower(F.trim("category"))), ["doc_id", "source", "lang", "category"], path=path), "tokens")
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    kind = F.struct(F.coalesce("category", F.lit("?")).alias("domain"), F.coalesce(F.lower(F.substring_index("lang", "-", 1)), F.lit("?")).alias("language"))
    by = sized.withColumn("kind", kind).groupBy("source", "kind").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("texts"))
    by = by.groupBy("source").agg(F.sum("n").alias("tokens"), F.sum("texts").alias("texts"), F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    return sized, t.join(by, "source", "left").select("source", "share", "repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("kind.domain", F.lit("?")).alias("domain"), F.coalesce("kind.language", F.lit("?")).alias("language"))


def plan(documents: DataFrame, targets: DataFrame, total: float | None = None, floor: float = 0.1, seed: int = 23, most_sources: int = 100_000, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(uses, leaves): uses (doc_id, source, tokens, repeats) for every text; leaves with target and budget of each source."""
    spark = documents.sparkSession
    sized, leaf = _leaf(documents, targets, path)
    rows = [r.asDict() for r in leaf.limit(most_sources + 1).collect()]
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources with a target")
    for r in rows:
        r["share"], r["room"] = r["share"] or 0.0, float(r["tokens"] * max(r["repeats"] or 0, 0))
    if total is None:
        whole = sum(r["share"] for r in rows) or 1.0
        fits = [r["room"] * whole / r["share"] for r in rows if r["share"] > 0 and r["room"] > 0]
        total = max(min(fits, default=0.0), floor * sum(r["tokens"] for r in rows))
    got = budgets(rows, total)
    out = []
    for r in rows:
        epochs = int(min(got[r["source"]] // r["tokens"], r["repeats"])) if r["tokens"] else 0
        rest = got[r["source"]] - epochs * r["tokens"] if epochs < (r["repeats"] or 0) else 0.0
        out.append((r["source"], r["share"], r["repeats"], r["tokens"], r["domain"], r["language"], got[r["source"]], epochs, rest, max(16, r["texts"] // 2000)))
    leaves = spark.createDataFrame(out, "source string, target_share double, max_repeats int, available long, domain string, language string, budget double, epochs int, rest double, ranges long")

    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    d = sized.where("tokens > 0").join(F.broadcast(leaves.select("source", "epochs", "rest", "ranges")), "source")  # at most most_sources rows
    d = d.select("doc_id", "source", "tokens", "epochs", "rest", order.alias("o"), F.pmod(F.shiftright(order, 20), F.col("ranges")).alias("range"), F.monotonically_increasing_id().alias("u"))
    d = stored(d, "order")
    sums = d.groupBy("source", "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # few rows a source
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    whole = sums.where("before + n <= rest").select("source", "range", F.lit(True).alias("whole"))
    cut = sums.where("before <= rest and before + n > rest").select("source", "range", F.col("before"))
    inside = d.join(cut, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("o", "doc_id", "u")))
    taken = inside.where("upto - tokens / 2 <= rest").select("u", F.lit(True).alias("taken"))
    used = d.join(whole, ["source", "range"], "left").join(taken, "u", "left")
    more = F.when((F.col("rest") > 0) & (F.coalesce("whole", F.lit(False)) | F.coalesce("taken", F.lit(False))), 1).otherwise(0)
    used = used.select("doc_id", "source", "tokens", (F.col("epochs") + more).cast("int").alias("repeats"))
    others = sized.join(F.broadcast(leaves.select("source")), "source", "left_anti").unionByName(sized.where("tokens = 0").join(F.broadcast(leaves.select("source")), "source", "left_semi"))
    return used.unionByName(others.select("doc_id", "source", "tokens", F.lit(0).alias("repeats"))), leaves


def uses(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    return plan(documents, targets, **options)[0]


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, actual_share, tokens, available, max_repeats, most_used): one row per target."""
    used, leaves = plan(documents, targets, **options)
    by = used.where("repeats > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_used"))
    j = leaves.join(by, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    all_ = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target source
    return j.select("source", "target_share", F.when(all_ > 0, F.col("tokens") / all_).otherwise(0.0).alias("actual_share"), "tokens", "available", "max_repeats", F.coalesce("most_used", F.lit(0)).alias("most_used"))
