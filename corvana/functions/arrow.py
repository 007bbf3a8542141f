"""Arrow-batch mapping: whole columns in, whole columns out, no per-row serialisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_batches(df: DataFrame, fn: Callable[..., dict], schema: str, start: Callable[[], object] | None = None, rows: int = 2000) -> DataFrame:
    """Apply fn(state, {column: list}) -> {column: list or numpy array} to slices of at most `rows` rows.

    `start` builds per-task state (a cache, a tokenizer). fn may return None for no output. If `state`
    has a method `flush`, it is called at the end of the task and its result is emitted too.
    """
    spec = _parse_datatype_string(schema)
    assert isinstance(spec, StructType)
    out = to_arrow_schema(spec)

    def batch(cols: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type, from_pandas=False) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                got = fn(state, {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if got is not None:
                    yield batch(got)
        if state is not None and hasattr(state, "flush"):
            got = state.flush()
            if got is not None:
                yield batch(got)

    return df.mapInArrow(run, spec)
