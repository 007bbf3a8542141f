"""Token counts under a public byte-level BPE vocabulary whose path is a parameter."""

from __future__ import annotations

import base64
import os

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.functions.arrow import map_batches

VOCABULARY = os.environ.get("CORVANA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The published pre-tokenisation pattern of this vocabulary family (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter(dict):
    """Exact counts: the pattern never joins text across a single space, so the count of a text is the sum over
    its space-separated chunks, which repeat and are remembered. Texts with runs of spaces are counted whole."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> int:
        if len(self) > 300_000:
            self.clear()
        n = self[chunk] = self.whole(" " + chunk)
        return n

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text:
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else 0) + sum(map(self.__getitem__, rest))


def counted(documents: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """`keep` columns and `tokens`: the text's length in tokens; null and empty texts have 0."""
    types = dict(documents.dtypes)
    documents.sparkSession.sparkContext.addFile(path)  # once a session; executors need no copy of their own
    name = os.path.basename(path)

    def count(counter, cols):
        return {**{k: cols[k] for k in keep}, "tokens": [counter.count(t) for t in cols[text]]}

    schema = ", ".join(f"`{k}` {types[k]}" for k in keep) + ", tokens long"
    return map_batches(documents.select(*[F.col(k) for k in dict.fromkeys([*keep, text])]), count, schema, lambda: Counter(SparkFiles.get(name)))
