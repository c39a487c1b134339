"""A stream of commands folded into a table of each key's last write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkv.functions.hashing import shard_of
from loomkv.operators.store import latest
from loomkv.sources.tables import as_commands


def stream_commands(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Commands of event files as they arrive."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if not _folder(spark, path):  # a stream reads folders: this one file of its folder, then
        path, _, name = path.rpartition("/")
        stream = stream.option("pathGlobFilter", name)
    return as_commands(stream.parquet(path))


class LastWrites:
    """A foreachBatch sink: the table lies in buckets by key; a batch rewrites those that it touches, in a folder of its number.

    A batch that is run again reads what came before it and writes the same folder, so the result doesn't change.
    What two later batches have replaced is deleted: disk holds the table and two batches' buckets.
    """

    def __init__(self, folder: str, buckets: int = 64):
        self.folder, self.buckets = folder, buckets

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch).withColumn("bucket", shard_of(F.col("key"), self.buckets))
        new.persist()
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most `buckets`
        found = self._versions(spark)
        old = [f"{self.folder}/v={max(v for v in found[b] if v < number)}/bucket={b}" for b in touched if any(v < number for v in found.get(b, ()))]
        merged = new
        if old:
            before = spark.read.parquet(*old)
            merged = latest(new.drop("bucket").unionByName(before.select(*[c for c in new.columns if c != "bucket"]))).withColumn("bucket", shard_of(F.col("key"), self.buckets))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={number}")
        new.unpersist()
        for b, versions in found.items():
            for v in versions:
                if any(v < w < number for w in versions):
                    self._fs(spark).delete(_path(spark, f"{self.folder}/v={v}/bucket={b}"), True)

    def _fs(self, spark: SparkSession):
        return _path(spark, self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, spark: SparkSession) -> dict[int, list[int]]:
        """The batches that wrote each bucket."""
        out: dict[int, list[int]] = {}
        for f in self._fs(spark).globStatus(_path(spark, f"{self.folder}/v=*/bucket=*")) or []:
            p = f.getPath()
            out.setdefault(int(p.getName().removeprefix("bucket=")), []).append(int(p.getParent().getName().removeprefix("v=")))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The table after the last batch."""
        return spark.read.parquet(*[f"{self.folder}/v={max(v)}/bucket={b}" for b, v in self._versions(spark).items()])


def fold(commands: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run the stream to its present end; returns the table."""
    sink = LastWrites(folder)
    query = commands.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.table(commands.sparkSession)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_traffic(commands: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Commands per verb and window of event time; what comes later than the watermark is dropped."""
    return commands.withWatermark("ts", late).groupBy(F.window("ts", window), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")
