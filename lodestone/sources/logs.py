"""Line logs and their sinks: receipts, debts and the journal as JSON lines, and the chunk table's batches.

Every sink writes a folder once and never changes it; what a reader sees is the set of finished folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

RECEIPT = "batch string, name string, decision string, time string, `by` string"
_BAD = "__unreadable"


class NoTable(LookupError):
    """The chunk table isn't where it should be; it's never created by a reader."""


def parsed(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Fields of JSON lines. Lines that are cut short, and those that hold anything but an object, are left out."""
    record = F.from_json(F.col(column), f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rest = [c for c in lines.columns if c != column]
    found = lines.where(F.col(column).rlike(r"^\s*\{")).select(*rest, record.alias("__record"))
    return found.where(F.col(f"__record.{_BAD}").isNull()).select(*rest, "__record.*").drop(_BAD)


def read_lines(spark: SparkSession, path: str, schema: str = RECEIPT) -> DataFrame:
    return parsed(spark.read.text(path), schema)


def write_lines(rows: DataFrame, path: str, *order: str) -> str:
    """One JSON object a line, in the order asked for; a folder that exists is an error."""
    rows.sort(*order).write.mode("errorifexists").json(path)
    return path


def create_index(spark: SparkSession, home: str, schema: str) -> bool:
    """An empty chunk table; false, and nothing changed, if there is one."""
    from pyspark.errors import AnalysisException

    try:
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(f"{home}/batch=created")
        return True
    except AnalysisException:
        return False


def append_documents(chunks: DataFrame, home: str, batch: str) -> None:
    """All chunks of the documents in one batch, or, where the job fails, none: a batch's files appear when its job commits."""
    chunks.write.mode("errorifexists").parquet(f"{home}/batch={batch}")


def open_index(spark: SparkSession, home: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("basePath", home).parquet(f"{home}/batch=*")
    except AnalysisException as error:
        raise NoTable(f"no chunk table under {home}") from error


def add_debts(debts: DataFrame, new: DataFrame) -> DataFrame:
    """Debts with new ones, one per rel: the old one stays."""
    both = debts.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    columns = [c for c in debts.columns if c != "rel"]
    return both.groupBy("rel").agg(F.min_by(F.struct(*columns), "__age").alias("x")).select("rel", "x.*").select(*debts.columns)


def drop_debts(debts: DataFrame, done: DataFrame) -> DataFrame:
    return debts.join(done.select("rel").distinct(), "rel", "left_anti")


def open_debts(debts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(debts whose file is there, rels of those whose file is gone)"""
    there = files.select("path").distinct()
    return debts.join(there, "path", "left_semi"), debts.join(there, "path", "left_anti").select("rel")


def noted(receipts: DataFrame, notes: DataFrame) -> DataFrame:
    """Receipts with an owner's notes (batch, name, decision, time) on files that are in their batch; other notes are refused."""
    known = receipts.where("by is null").select("batch", "name").distinct()
    fresh = notes.join(known, ["batch", "name"], "left_semi").withColumn("by", F.lit("owner"))
    return receipts.unionByName(fresh)


def numbered_batches(starts: DataFrame) -> DataFrame:
    """start -> batch: YYYYMMDD-HHMMSS, and -2, -3 ... for later ones of a second. starts: id, start (timestamp)."""
    from pyspark.sql import Window

    stamp = F.date_format("start", "yyyyMMdd-HHmmss")
    nth = F.row_number().over(Window.partitionBy(stamp).orderBy("start", "id"))
    return starts.withColumn("nth", nth).select("id", F.when(F.col("nth") == 1, stamp).otherwise(F.concat_ws("-", stamp, F.col("nth").cast("string"))).alias("batch"))


def expired(at: Column, now: Column, seconds: int) -> Column:
    """Whether a moment is `seconds` old or older."""
    return F.unix_timestamp(now) - F.unix_timestamp(at) >= seconds


def journal_lines(calls: DataFrame, path: str) -> str:
    """Calls (ts, server, client, tool, params map, status) as journal lines, parameters scrubbed and cut."""
    from lodestone.operators.ops import scrub

    return write_lines(calls.withColumn("params", scrub(F.col("params"))), path, "ts")


def embedded(chunks: DataFrame, embed, size: int = 48) -> DataFrame:
    """chunks with their vectors, `size` at a time; where a call fails its chunks are tried one by one, and a bad one is left
    out. embed: list of texts -> list of vectors, one each."""
    import pyarrow as pa

    at = chunks.columns.index("text")
    schema = StructType([*chunks.schema.fields, StructField("vector", ArrayType(FloatType()))])

    def vectors(texts: list[str]) -> list[list[float] | None]:
        try:
            found = embed(texts)
            if len(found) != len(texts):
                raise ValueError("a vector for each text expected")
            return found
        except Exception:  # whatever the service throws
            if len(texts) == 1:
                return [None]
            return [v for t in texts for v in vectors([t])]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                made = pa.array(vectors(part.column(at).to_pylist()), pa.list_(pa.float32()))
                whole = pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "vector"])
                yield whole.filter(made.is_valid())

    return chunks.mapInArrow(run, schema)
