"""Line sources: text files in batch and as a stream."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.parse import nonblank_lines, parse_access_logs

logger = logging.getLogger(__name__)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, file): every line of the files; files are split across tasks."""
    names = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(names).select("value", F.col("_metadata.file_path").alias("file"))


def stream_lines(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None, bytes_per_trigger: str | None = None
) -> DataFrame:
    """Streaming (value, file); a batch is bounded by file count or bytes."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        if files_per_trigger <= 0:
            raise ValueError("files_per_trigger must be greater than zero")
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(folder).select("value", F.col("_metadata.file_path").alias("file"))


def posted_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Lines handed over by a caller as a DataFrame."""
    return spark.createDataFrame([(line,) for line in lines], "value string")


def existing_files(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that are files; missing paths and folders are logged and skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for raw in paths:
        path = jvm.org.apache.hadoop.fs.Path(raw)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            logger.warning("input path is missing: %s", raw)
        elif not fs.getFileStatus(path).isFile():
            logger.warning("input path is not a file: %s", raw)
        else:
            found.append(raw)
    return found


def count_lines(spark: SparkSession, paths: str | Sequence[str]) -> int:
    return read_lines(spark, paths).count()


def strict_events(spark: SparkSession, path: str, fmt: str, **parsing: object) -> DataFrame:
    """Events of a file; the job fails on the first bad line."""
    return parse_access_logs(read_lines(spark, path), fmt, mode="failfast", **parsing)


def parsed_files(spark: SparkSession, paths: Sequence[str], fmt: str, **parsing: object) -> DataFrame:
    """Every non-blank line of the files, parsed, with ``reject_reason`` on bad ones."""
    return parse_access_logs(read_lines(spark, paths), fmt, mode="keep", **parsing)


def line_batches(lines: DataFrame, order_by: str, batch_size: int) -> DataFrame:
    """Adds ``batch_id``: consecutive batches of a dense line number."""
    if batch_size <= 0:
        raise ValueError("batch_size must be greater than zero")
    return nonblank_lines(lines).withColumn(
        "batch_id", F.floor(F.col(order_by) / F.lit(batch_size))
    )


def file_line_batches(spark: SparkSession, paths: str | Sequence[str], batch_size: int = fv.INGEST_BATCH_SIZE) -> DataFrame:
    """(value, file, line_no, batch_id): the lines of each file with their dense number, blank ones not counted,
    in consecutive batches.

    A split of a file is known by its first byte. Lines are counted per split, the counts of the splits before it
    give a split its first number, and only inside a split, which is bounded by
    ``spark.sql.files.maxPartitionBytes``, lines are numbered one by one.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be greater than zero")
    names = [paths] if isinstance(paths, str) else list(paths)
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split")]
    lines = nonblank_lines(spark.read.text(names).select("value", *split, F.monotonically_increasing_id().alias("_at")))
    counts = lines.groupBy("file", "_split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at")) - 1
    numbered = lines.withColumn("_inside", inside).join(starts, ["file", "_split"])
    number = F.col("_first") + F.col("_inside")
    return numbered.select("value", "file", number.alias("line_no"), F.floor(number / F.lit(batch_size)).alias("batch_id"))


def labelled_lines(lines: DataFrame) -> DataFrame:
    """JSON lines with ``label`` taken from ``_label`` (``clean`` when absent).

    The label stays on its own row whether or not the row parses later.
    """
    # Of repeated keys the last one counts, as in the parser.
    label = F.from_json("value", "_label string")["_label"]
    return lines.withColumn("label", F.coalesce(label, F.lit("clean")))
