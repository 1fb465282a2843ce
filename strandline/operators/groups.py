"""Python over the groups of a key, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = list[dict]


def _values(column: pa.Array) -> list:
    """The column as Python values, at once where it is plain and without nulls."""
    kind = column.type
    plain = pa.types.is_integer(kind) or pa.types.is_float32(kind) or pa.types.is_float64(kind) or pa.types.is_string(kind)
    return column.to_numpy(zero_copy_only=False).tolist() if plain and not column.null_count else column.to_pylist()


def each_group(df: DataFrame, keys: list[str], order: list[Column | str], solve: Callable[[Rows], list[tuple]], schema: str) -> DataFrame:
    """``solve`` on the rows of each key, in ``order``; its tuples are rows of ``schema``.

    Rows are dealt by key and sorted, so one group is held at a time and groups share batches: groups of
    a few rows cost no call each. A group is solved in one task, so keys must name bounded groups.
    """
    out, first, others = to_arrow_schema(StructType.fromDDL(schema)), keys[0], keys[1:]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows = []
        done: list[tuple] = []

        def sent() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(out)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out)], schema=out)
            done.clear()
            return batch

        for batch in batches:
            names = batch.schema.names
            for values in zip(*map(_values, batch.columns)):
                row = dict(zip(names, values))
                if held and (row[first] != held[0][first] or any(row[k] != held[0][k] for k in others)):
                    done += solve(held)
                    held = []
                    if len(done) >= 10_000:
                        yield sent()
                held.append(row)
        if held:
            done += solve(held)
        yield sent()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)
