"""Change feeds as Structured Streaming queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloft.operators.ingest import upsert
from sparkloft.storage import folder


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder (or one file's folder with a name filter) as a stream; the schema is read once."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    parent, _, name = path.rpartition("/")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isFile():
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def minute_counts(spark: SparkSession, path: str, lateness: str = "40 days", files_per_trigger: int = 100) -> DataFrame:
    """(minute, event_type, n, total) by a watermarked window aggregate over all there is, read back as a batch.

    Update mode into foreachBatch: each trigger's changed windows replace their former rows. Rows later than ``lateness`` behind the
    newest of the triggers before are dropped.
    """
    out, state = folder(spark, "minutes"), folder(spark, "minutes-state")
    rows = event_stream(spark, path, files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counts = rows.groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    counts = counts.select((F.unix_timestamp(F.col("w.start")) / 60).cast("long").alias("minute"), "event_type", "n", "total")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a trigger that is repeated writes the same place

    q = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    made = spark.read.parquet(out)
    newest = made.groupBy("minute", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x"))
    return newest.select("minute", "event_type", "x.n", "x.total")


class FeedTable:
    """A keyed table that takes batches of changes. Rows lie in buckets by key; a batch rewrites only the buckets that it changes.

    The rewritten buckets go to a folder of their own; then a manifest, which says where each bucket lies, comes into being by one
    rename. Readers take the newest manifest, so they see a batch whole or not at all, and a crash before the rename changes nothing. A
    batch that is repeated after its manifest is there is skipped. Folders that neither of the last two manifests names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/_manifests/*.json"))
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found or [])

    def _manifest(self, epoch: int) -> dict:
        text = self.spark.read.text(f"{self.path}/_manifests/{epoch}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table (or some buckets) as the newest manifest has it; None before the first batch."""
        epochs = self._manifests()
        if not epochs:
            return None
        now = self._manifest(epochs[-1])
        wanted = now["places"] if buckets is None else {b: p for b, p in now["places"].items() if int(b) in buckets}
        schema = T.StructType.fromJson(now["schema"])
        paths = [f"{self.path}/{place}/__bucket={b}" for b, place in wanted.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, order: str, epoch: int) -> None:
        """Puts the last row of each key into the place of the old one."""
        epochs = self._manifests()
        if epoch in epochs:
            return
        before = self._manifest(epochs[-1]) if epochs else {"places": {}, "schema": json.loads(batch.schema.json())}
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        changed = [r[0] for r in batch.select(bucket).distinct().collect()]  # numbers of buckets
        old = self.read(changed)
        merged = batch.limit(0) if old is None else old
        merged = upsert(merged, batch, self.key, order).withColumn("__bucket", bucket)
        place = f"batch-{epoch}"
        merged.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{place}")
        places = before["places"] | {str(b): place for b in changed}
        self._commit(epoch, {"places": places, "schema": json.loads(merged.drop("__bucket").schema.json())})
        self._clean()

    def _commit(self, epoch: int, manifest: dict) -> None:
        draft, final = self._path(f"{self.path}/_manifests/{epoch}.draft"), self._path(f"{self.path}/_manifests/{epoch}.json")
        out = self._fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"could not publish {final}")

    def _clean(self) -> None:
        epochs = self._manifests()
        for epoch in epochs[:-2]:
            self._fs.delete(self._path(f"{self.path}/_manifests/{epoch}.json"), False)
        used = {p for e in epochs[-2:] for p in self._manifest(e)["places"].values()}
        for f in self._fs.globStatus(self._path(f"{self.path}/batch-*")) or []:
            name = f.getPath().getName()
            if name not in used and int(name.removeprefix("batch-")) < epochs[-1]:
                self._fs.delete(f.getPath(), True)


def upsert_feed(stream: DataFrame, table: FeedTable, order: str, state: str, interval: str = "30 seconds", once: bool = False):
    """Keeps a table at its latest row for each key as files arrive; the trigger interval is the debounce."""
    w = stream.writeStream.foreachBatch(lambda batch, epoch: table.apply(batch, order, epoch)).option("checkpointLocation", state)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()
