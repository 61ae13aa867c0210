"""Global running sums of an ordered table, without one task that sees all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize


def prefix_sums(df: DataFrame, order: list[str], *values: str) -> DataFrame:
    """Add ``before_<value>`` (sum over all earlier rows) for each of ``values`` and ``position`` (number of earlier
    rows).

    Rows are range-partitioned by ``order`` and sorted; each partition sums its own rows in one streaming pass,
    and one row per partition (its totals) is all that the driver sees. The values are whole numbers without nulls.
    Ties in ``order`` get neighbouring positions in either order. An empty table gives an empty result.
    """
    names = df.columns
    sums = [f"_sum_{v}" for v in values]
    added = [
        T.StructField("_part", T.IntegerType()),
        T.StructField("_row", T.LongType()),
        *(T.StructField(s, T.LongType()) for s in sums),
    ]
    schema = T.StructType([*df.schema.fields, *added])

    def local(batches):
        part, rows, totals = TaskContext.get().partitionId(), 0, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            columns = [
                *batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rows + np.arange(n, dtype=np.int64))
            ]
            for i, value in enumerate(values):
                own = batch.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = totals[i] + np.cumsum(own)
                columns.append(pa.array(ends - own))
                totals[i] = int(ends[-1]) if n else totals[i]
            rows += n
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_row", *sums])

    keys = [F.asc_nulls_last(c) for c in order]
    done = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(local, schema), "prefix")
    starts, before = [], [0] * (1 + len(values))
    for part, *totals in done.groupBy("_part").agg(F.count("*"), *map(F.sum, values)).orderBy("_part").collect():
        starts.append((part, *before))
        before = [a + b for a, b in zip(before, totals, strict=True)]
    offsets = df.sparkSession.createDataFrame(
        starts, ", ".join(["_part int", "_row0 long", *(f"{s}0 long" for s in sums)])
    )
    shifted = [(F.col(f"{s}0") + F.col(s)).alias(f"before_{v}") for s, v in zip(sums, values, strict=True)]
    return done.join(F.broadcast(offsets), "_part").select(
        *names, *shifted, (F.col("_row0") + F.col("_row")).alias("position")
    )
