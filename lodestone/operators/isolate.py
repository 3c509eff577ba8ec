"""Work over rows of which some crash their reader: the good ones go through, the bad ones are set aside with the error.

A slice of an Arrow batch is worked on as a whole. If that fails, it's cut in two and each half is tried again, down to
single rows, so one bad row among n costs about 2 log2(n) more calls and never stops its batch, its task or the job. What
fails by itself becomes a row of the dead letters: the whole input row, the error's name, and how many calls it was in.

Only what Python can catch is isolated: a worker that dies takes its task along, which Spark tries again. Work must depend on
its rows alone (slices may be tried several times) and give one row for each row, in order.

Defined results: nulls, repeated and empty rows are passed to the work like any others; no rows give two empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.session import scratch_path, ship_package

Work = Callable[[pa.RecordBatch], pa.RecordBatch]
#: Rows that are first tried together.
SLICE = 1024


def bisected(batch: pa.RecordBatch, work: Work, calls: int = 1) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, str | None, int]]:
    """(rows, their result, None, calls) of slices that went through, (row, None, error, calls) of rows that don't, in order."""
    try:
        done = work(batch)
        if done.num_rows != batch.num_rows:
            raise ValueError(f"{done.num_rows} results for {batch.num_rows} rows")
        yield batch, done, None, calls
    except Exception as error:  # whatever a row can do to its reader
        if batch.num_rows == 1:
            yield batch, None, f"{type(error).__name__}: {error}"[:300], calls
        else:
            half = batch.num_rows // 2
            yield from bisected(batch.slice(0, half), work, calls + 1)
            yield from bisected(batch.slice(half), work, calls + 1)


def _isolating(work: Work, width: int, fields: int, kinds: list[pa.DataType] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                for rows, done, error, calls in bisected(batch.slice(at, width), work):
                    n = rows.num_rows
                    nested = pa.StructArray.from_arrays(rows.columns, names=rows.schema.names)
                    found = done.columns if done is not None else [pa.nulls(n, k) for k in kinds]
                    yield pa.RecordBatch.from_arrays(
                        [nested, *found, pa.array([error] * n, pa.string()), pa.array([calls] * n, pa.int32()), pa.array([error is not None] * n)],
                        ["__row", *[f"r{k}" for k in range(fields)], "error", "calls", "failed"],
                    )

    return run


@dataclass
class Outcome:
    """good: the input's columns (as `row`) and the work's; dead: `row`, `error`, `calls`."""

    good: DataFrame
    dead: DataFrame


def isolated(df: DataFrame, work: Work, schema: str, width: int = SLICE) -> Outcome:
    """The work over all rows of df, once; both tables are in the shared folder."""
    spark = df.sparkSession
    ship_package(spark)
    result = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(result)]
    names = [f"r{k}" for k in range(len(result))]
    columns = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, result, strict=True))
    out = df.mapInArrow(_isolating(work, width, len(result), kinds), f"__row {df.schema.simpleString()}, {columns}, error string, calls int, failed boolean")
    path = scratch_path(spark, "isolated")
    out.write.partitionBy("failed").parquet(path)
    stored = spark.read.schema(out.schema).parquet(path)
    good = stored.where("not failed").select(F.col("__row").alias("row"), *[F.col(n).alias(f.name) for n, f in zip(names, result, strict=True)])
    return Outcome(good, stored.where("failed").select(F.col("__row").alias("row"), "error", "calls"))
