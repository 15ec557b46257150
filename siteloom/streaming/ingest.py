"""Incremental ingestion: rows upserted by key or replaced by source, links counted, windows and summaries kept up to date."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteloom.session import shared_folder


def merged(current: DataFrame | None, batch: DataFrame, key: str, order: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """The latest row per key of both sides (largest `order`, then the batch); `keep_old` columns keep their last value that
    is not null.
    """
    new = batch.withColumn("_side", F.lit(1))
    rows = new if current is None else current.withColumn("_side", F.lit(0)).unionByName(new, allowMissingColumns=True)
    rows = rows.where(F.col(key).isNotNull())
    columns = [c for c in rows.columns if c not in (key, "_side")]
    at = F.struct(F.col(order), F.col("_side"))
    got = rows.groupBy(key).agg(F.max_by(F.struct(*columns), at).alias("_row"), *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_keep_{c}") for c in keep_old])
    return got.select(key, *[(F.col(f"_keep_{c}") if c in keep_old else F.col(f"_row.{c}")).alias(c) for c in columns])


BUCKETS = 32
#: How many versions of a bucket stay behind the current one, for readers that began before it.
KEPT = 1


class Buckets:
    """A table kept in buckets by key. A version of it is a small manifest that names, for each bucket, the batch whose files
    hold, with the table's counters beside them; it counts once it is there under its own name, so a writer that dies half-way
    leaves the last one in force, and a batch already applied is known when it is replayed. A batch rewrites the buckets it
    touches and no others; files that no kept version names are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda p: jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._path(p)), "UTF-8")

    def versions(self) -> list[int]:
        """The complete versions, oldest first."""
        if not self._fs.exists(self._path(f"{self.folder}/manifests")):
            return []
        return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))) if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": None, "buckets": {}, "counts": {}, "schema": None}
        return json.loads(self._text(f"{self.folder}/manifests/{found[-1] if version is None else version}.json"))

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The rows of the current version, of some buckets or of all; None before the first."""
        m = self.manifest()
        if m["version"] is None:
            return None
        paths = [f"{self.folder}/data/{v}/_bucket={b}" for b, v in m["buckets"].items() if only is None or int(b) in only]
        schema = StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counts(self) -> dict[str, int]:
        return self.manifest()["counts"]

    def apply(self, batch: DataFrame, number: int, change, counts=None) -> None:
        """Batch `number` brings `change`(old rows of the touched buckets or None, batch) into them; `counts`(old counts, old
        rows, new rows) gives the counters of the new version.
        """
        m = self.manifest()
        if m["version"] is not None and number <= m["version"]:
            return
        batch = batch.where(F.col(self.key).isNotNull())
        touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]
        old = self.read(touched)
        new = change(old, batch)
        new.withColumn("_bucket", self.bucket()).repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/{number}")
        # A touched bucket that has no rows left has no files either.
        written = [s.getPath().getName()[8:] for s in self._fs.listStatus(self._path(f"{self.folder}/data/{number}")) if s.getPath().getName().startswith("_bucket=")]
        kept = {b: v for b, v in m["buckets"].items() if int(b) not in touched}
        schema = json.loads(new.schema.json())
        after = {"version": number, "buckets": kept | {b: number for b in written}, "counts": m["counts"], "schema": schema}
        if counts is not None:
            rows = self.spark.read.schema(new.schema).parquet(*[f"{self.folder}/data/{number}/_bucket={b}" for b in written]) if written else self.spark.createDataFrame([], new.schema)
            after["counts"] = counts(m["counts"], old, rows)
        self._publish(after)
        self._forget()

    def clear(self) -> None:
        """Drops all versions."""
        if self._fs.exists(self._path(self.folder)):
            self._fs.delete(self._path(self.folder), True)

    def _publish(self, manifest: dict) -> None:
        at = f"{self.folder}/manifests/{manifest['version']}"
        out = self._fs.create(self._path(f"{at}.part"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.rename(self._path(f"{at}.part"), self._path(f"{at}.json"))

    def _forget(self) -> None:
        found = self.versions()
        kept = [self.manifest(v) for v in found[-1 - KEPT :]]
        named = {(str(v), b) for m in kept for b, v in m["buckets"].items()}
        for v in found[: -1 - KEPT]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{v}.json"), False)
        for d in self._fs.listStatus(self._path(f"{self.folder}/data")):
            v = d.getPath().getName()
            left = 0
            for s in self._fs.listStatus(d.getPath()):
                name = s.getPath().getName()
                if name.startswith("_bucket="):
                    if (v, name[8:]) in named:
                        left += 1
                    else:
                        self._fs.delete(s.getPath(), True)
            if not left and int(v) not in found[-1 - KEPT :]:
                self._fs.delete(d.getPath(), True)


def _started(stream: DataFrame, fold, checkpoint: str):
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, key: str, order: str, keep_old: tuple[str, ...] = ()):
    """A query (available-now trigger) that folds a stream of rows into the table of `folder`, exactly once per batch."""
    table = Buckets(stream.sparkSession, folder, key)
    return _started(stream, lambda batch, n: table.apply(batch, n, lambda old, new: merged(old, new, key, order, keep_old)), checkpoint)


def replaced(current: DataFrame | None, batch: DataFrame, source: str) -> DataFrame:
    """All rows of the sources in `batch` replaced by those of the batch: a page's images, references or captures are those of
    its last fetch.
    """
    return batch if current is None else current.join(batch.select(source).distinct(), source, "left_anti").unionByName(batch, allowMissingColumns=True)


def replace_stream(stream: DataFrame, folder: str, checkpoint: str, source: str):
    """Folds a stream of pages' rows into the table of `folder`, each batch replacing all rows of its sources."""
    table = Buckets(stream.sparkSession, folder, source)
    return _started(stream, lambda batch, n: table.apply(batch, n, lambda old, new: replaced(old, new, source)), checkpoint)


def count_stream(stream: DataFrame, folder: str, checkpoint: str, column: str, ident: str):
    """Keeps (column, count) of distinct `ident` per value under a stream of rows; repeats of a row, in one batch or in
    several, count once. State is kept by the query; of the table only the buckets of changed values are rewritten.
    """
    table = Buckets(stream.sparkSession, folder, column)
    counts = stream.where(F.col(column).isNotNull() & F.col(ident).isNotNull()).dropDuplicates([ident]).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    fold = lambda batch, n: table.apply(batch, n, lambda old, new: merged(old, new, column, "count"))
    return counts.writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and window of a stream; rows later than `late` behind the newest are dropped by the
    watermark, and closed windows leave the state.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def window_stream(events: DataFrame, folder: str, checkpoint: str, late: str = "10 minutes", width: str = "1 hour"):
    """Keeps the windows of `windowed` in the table of `folder`, open ones with what they hold so far."""
    table = Buckets(events.sparkSession, folder, "window")
    rows = windowed(events, late, width).withColumn("window", F.concat_ws(" ", F.col("start").cast("string"), "event_type"))
    fold = lambda batch, n: table.apply(batch, n, lambda old, new: merged(old, new, "window", "events"))
    return rows.writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_stream(stream: DataFrame, folder: str, checkpoint: str, key: str, order: str, flags: dict):
    """Keeps the table of `folder` under upserts, and with each version the number of its rows that meet each flag.

    A batch takes the contributions of its buckets' old rows away and adds those of the new ones; other buckets are not read.
    """
    table = Buckets(stream.sparkSession, folder, key)

    def of(rows: DataFrame | None) -> dict:
        return {n: 0 for n in flags} if rows is None else rows.agg(*[F.count_if(c).alias(n) for n, c in flags.items()]).first().asDict()

    def counts(before: dict, old: DataFrame | None, new: DataFrame) -> dict:
        gone, come = of(old), of(new)
        return {n: before.get(n, 0) - gone[n] + come[n] for n in flags}

    return _started(stream, lambda batch, n: table.apply(batch, n, lambda old, new: merged(old, new, key, order), counts), checkpoint)


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def working_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
