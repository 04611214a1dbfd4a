"""Sinks that can be repeated: an append log of batches, and ordered text files written in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

BYTE_ORDER_MARK = "﻿"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_batch(frame: DataFrame, path: str, batch: int) -> bool:
    """Appends a batch to the JSON log at path, once: whether it was written.

    Rows go to a folder of the batch's own, and count from when its commit is
    there.  A batch that was killed before that is written anew when it is
    repeated; one that is committed stays as it is.
    """
    spark = frame.sparkSession
    if _exists(spark, f"{path}/commits/batch={batch}/_SUCCESS"):
        return False
    frame.write.mode("overwrite").json(f"{path}/rows/batch={batch}")
    spark.range(1).select(F.current_timestamp().alias("committed")).write.mode("overwrite").json(f"{path}/commits/batch={batch}")
    return True


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches, with their batch; none where no log is."""
    if not _exists(spark, f"{path}/commits") or not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
    whole = StructType([*schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(whole).option("basePath", f"{path}/rows").json(f"{path}/rows/batch=*")
    # A commit whose own writing was killed has no row in it.
    commits = spark.read.schema("committed timestamp, batch bigint").option("basePath", f"{path}/commits").json(f"{path}/commits/batch=*")
    return rows.join(commits.where("committed is not null").select("batch").distinct(), "batch", "left_semi").select(*schema.names, "batch")


def append_stream(stream: DataFrame, path: str, checkpoint: str, before_commit: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Appends each micro-batch of a stream to the log; a restart from the checkpoint repeats a batch under its number.

    before_commit is called with each batch first, as a place for further work.
    """

    def write(frame: DataFrame, number: int) -> None:
        if before_commit:
            before_commit(frame, number)
        append_batch(frame, path, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def csv_field(value: Column) -> Column:
    """A value as a CSV field: quoted where it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(fields: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_field(f) for f in fields])


def place_in(value: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; values that are not in it come last."""
    found = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(found, F.lit(0)) == 0, len(order) + 1).otherwise(found)


def write_ordered_csv(frame: DataFrame, path: str, columns: dict[str, Column], order: list[Column], *, mark: bool = False, line_end: str = "\n", parts: int | None = None) -> None:
    """Writes rows as CSV parts that, one after another by name, are the file: its header once, then all rows in order.

    Rows are dealt out in ranges of their order, which the header is the first
    of, so that no task holds the file.  columns are the fields by their titles;
    mark puts a byte order mark at the start.  Rows with equal order fields are
    ordered by their lines.  An empty table leaves the header.
    """
    line = csv_line(list(columns.values()))
    keys = [f"_o{i}" for i in range(len(order))]
    rows = frame.select(F.lit(1).alias("_body"), *[c.alias(k) for c, k in zip(order, keys, strict=True)], line.alias("value"))
    title = (BYTE_ORDER_MARK if mark else "") + ",".join(f'"{c}"'.replace('""', '"') if "," in c else c for c in columns)
    head = frame.sparkSession.range(1).select(F.lit(0).alias("_body"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys], F.lit(title).alias("value"))
    sort = ["_body", *keys, "value"]
    both = rows.unionByName(head)
    dealt = both.repartitionByRange(parts, *sort) if parts else both.repartitionByRange(*sort)
    dealt.sortWithinPartitions(*sort).select("value").write.mode("overwrite").option("lineSep", line_end).text(path)


def ordered_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, content): what each part of an ordered file holds, by its name."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("part"), F.col("value").alias("content"))


def join_parts(spark: SparkSession, path: str, target: str) -> None:
    """Copies the parts of an ordered file into one, byte by byte through a buffer of fixed size."""
    hadoop = spark._jvm.org.apache.hadoop
    source, out = hadoop.fs.Path(path), hadoop.fs.Path(target)
    conf = spark._jsc.hadoopConfiguration()
    store, kept = source.getFileSystem(conf), out.getFileSystem(conf)
    names = sorted(str(f.getPath().toString()) for f in store.listStatus(source) if f.getPath().getName().startswith("part-"))
    stream = kept.create(out, True)
    try:
        for name in names:
            part = store.open(hadoop.fs.Path(name))
            hadoop.io.IOUtils.copyBytes(part, stream, 1 << 16, False)
            part.close()
    finally:
        stream.close()
