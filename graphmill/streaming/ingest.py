"""Graph files that land in a folder, staged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables
from ..sources import readers


def landing(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(spark: SparkSession, path: str, out: str, source: str, category: str, fmt: str, checkpoint: str, pattern: str = "*", once: bool = True) -> StreamingQuery:
    """Stage every new file below path into the table out: filters, then ids that out has are left out, then an append.

    A batch that is run again after a failure writes its graphs again under the same batch number; current() counts each
    graph once, so nothing is doubled.
    """
    drawn = category == "graphs_with_drawings"

    def one_batch(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        parsed = readers.parse_files(batch.select("path", "content"), fmt, drawn)
        fs_path = s._jvm.org.apache.hadoop.fs.Path(f"{out}/_SUCCESS")
        exists = fs_path.getFileSystem(s._jsc.hadoopConfiguration()).exists(fs_path)
        known = s.read.parquet(out).filter(F.col("batch") != number) if exists else None
        kept, _ = readers.stage(parsed, source, category, known)
        kept.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(out)

    writer = landing(spark, path, pattern).writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The ingested graphs, each once: its first batch."""
    return tables.last_writes(spark.read.parquet(out), ["graph_id"], [F.asc("batch"), F.asc("path")])


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and by; on a stream, rows later than late behind the newest are left out."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    return df.groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
