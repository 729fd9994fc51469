"""Sequential recurrences over many groups: sorted partitions are read as streams, row by row, with only a group's state in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that is handed back.
BATCH = 4096


def _values(column: pa.Array) -> list:
    """A column as Python values: integers and floating numbers all at once, not one by one; null is None."""
    if not (pa.types.is_integer(column.type) or pa.types.is_float64(column.type)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    values = column.fill_null(0).to_numpy().tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        values[i] = None
    return values


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    return (dict(zip(names, row)) for row in zip(*[_values(column) for column in batch.columns]))


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], visit: Callable[[Iterator[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """``visit`` gets each key's rows (an iterator of dicts, in ``order``, which should be total) and gives rows of ``schema``.

    Spark deals and sorts; thousands of small groups share a batch, and a large one is never held whole. Null keys are keys.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(rows_of(batch) for batch in batches)
        found = chain.from_iterable(visit(own) for _, own in groupby(rows, key=itemgetter(*keys)))
        while some := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*some), arrow)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
