"""Ordered folds that give a result for each row, where no window can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def folded(rows: DataFrame, group: list[str], order: list[str], reads: list[str], step: Callable, out: str) -> DataFrame:
    """`rows` with the columns of schema `out`: what `step(state, *values of reads)` gives for each row beside the next state.

    Rows of a group are read in `order`; the first state of a group is None. Nulls of numbers are read as NaN. Groups are dealt over
    tasks by their key and stream through: only the state is kept, so no group has to fit into memory, and work is linear.
    (An aggregate() over a list copies its state, results so far included, for each row.) `step` must not refer to this package:
    workers get it by value.
    """
    added = StructType.fromDDL(out)
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        at, state = None, None
        for b in batches:
            column = lambda c, b=b: b.column(b.schema.get_field_index(c))
            listed = lambda a: a.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(a.type) else a.to_pylist()
            keys, values = zip(*[column(c).to_pylist() for c in group], strict=True), zip(*[listed(column(c)) for c in reads], strict=True)
            made = []
            for key, value in zip(keys, values, strict=True):
                if key != at:
                    at, state = key, None
                state, result = step(state, *value)
                made.append(result)
            new = [pa.array(v, types[f.dataType.simpleString()]) for f, v in zip(added, zip(*made, strict=True), strict=True)] if made else [pa.array([], types[f.dataType.simpleString()]) for f in added]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))
