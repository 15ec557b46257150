"""The frontier of a crawl as tables: sitemap sources, seeds, what is queued and seen, and its checkpoints."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import url as U
from siteloom.functions.text import trimmed
from siteloom.operators import ranking
from siteloom.streaming.ingest import Buckets, merged

QUEUE = "position long, url string, depth long, from_sitemap boolean, storage_key string, list_position int, list_duplicate_index int"


def sitemap_sources(root: str, explicit: list[str] = (), declared: DataFrame | None = None, linked: DataFrame | None = None, probe: bool = True, spark: SparkSession | None = None) -> DataFrame:
    """(url, source, required) of the sitemaps to read, each once under its first source: those given (a failure of which is
    an error), those that robots.txt declares (`declared`: url), the default address, those that pages link (`linked`: url).
    """
    spark = spark or SparkSession.getActiveSession()
    fixed = [(urljoin(root, u.strip()), "explicit", 0) for u in explicit if u.strip()] + ([(urljoin(root, "/sitemap.xml"), "default", 2)] if probe else [])
    rows = spark.createDataFrame(fixed, "url string, source string, _rank int")
    for df, name, rank in ((declared, "robots", 1), (linked, "linked", 3)):
        if df is not None:
            rows = rows.unionByName(df.select(U.without_fragment(trimmed("url")).alias("url"), F.lit(name).alias("source"), F.lit(rank).alias("_rank")).where(F.rlike("url", F.lit("(?i)^https?://"))))
    first = rows.groupBy("url").agg(F.min(F.struct("_rank", "source")).alias("_f"))
    return first.select("url", F.col("_f.source").alias("source"), (F.col("_f._rank") == 0).alias("required"))


def in_sitemaps(records: DataFrame, addresses: DataFrame) -> DataFrame:
    """`records` with in_sitemap: whether url or final_url is among the addresses (location) that sitemaps name. The names are
    made distinct, so an address that half of all records share meets one row.
    """
    named = addresses.select(F.col("location").alias("_u")).where("_u is not null").distinct()
    for c in ("url", "final_url"):
        records = records.join(named.select(F.col("_u").alias(c), F.lit(True).alias(f"_in_{c}")), c, "left")
    return records.withColumn("in_sitemap", F.coalesce("_in_url", "_in_final_url", F.lit(False))).drop("_in_url", "_in_final_url")


def root_url(start: str, listed: list[str] = ()) -> str:
    """The address that a crawl's scope is about: the start, or in list mode the first listed one that is http(s)."""
    for u in listed:
        if U.resolve_href(u.strip(), u.strip()):
            return U.resolve_href(u.strip(), u.strip())
    got = U.resolve_href(start.strip(), start.strip())
    if not got:
        raise ValueError("invalid start URL")
    return got


def seeds(root: str, sitemap: DataFrame | None = None, scope: Column | None = None, most: int | None = None) -> DataFrame:
    """The first queue (QUEUE): the root, then the addresses of sitemaps (location) within `scope` (a condition on url), each
    once in the order of their text, `most` in all.
    """
    spark = SparkSession.getActiveSession() if sitemap is None else sitemap.sparkSession
    rows = spark.createDataFrame([(root, False)], "url string, from_sitemap boolean")
    if sitemap is not None:
        found = sitemap.select(U.without_fragment("location").alias("url")).where(F.col("url").isNotNull() & (F.col("url") != root)).distinct()
        found = found if scope is None else found.where(scope)
        if most is not None:
            found = found.orderBy("url").limit(max(0, most - 1))
        rows = rows.unionByName(found.withColumn("from_sitemap", F.lit(True)))
    return numbered(rows.withColumns({"depth": F.lit(0).cast("long"), "storage_key": F.col("url"), "list_position": F.lit(None).cast("int"), "list_duplicate_index": F.lit(0)}), ["from_sitemap", "url"])


def numbered(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """`rows` as QUEUE with positions from `start` in the given order."""
    return ranking.numbered(rows, order, "position", start).select(*[c.split()[0] for c in QUEUE.split(", ")])


def restored(queued: DataFrame, seen: DataFrame, root: str, scope: Column, spider: bool = True) -> tuple[DataFrame, DataFrame]:
    """(queue, seen) of a saved frontier under the scope that holds now (a condition on url). A spider's queue loses what is
    outside by now, the root aside, and these addresses count as unseen; listed addresses stay. Of a key queued twice the
    first holds.
    """
    keys = seen.select("url").distinct()
    if not spider:
        kept = queued
    else:
        queued = queued.withColumn("url", U.without_fragment("url")).withColumn("storage_key", F.col("url"))
        kept = queued.where((F.col("url") == root) | F.coalesce(scope, F.lit(False)))
        lost = queued.join(kept.select("storage_key"), "storage_key", "left_anti").select(F.col("storage_key").alias("url"))
        keys = keys.select(U.without_fragment("url").alias("url")).distinct().join(lost, "url", "left_anti")
    first = kept.groupBy("storage_key").agg(F.min("position").alias("position"))
    queue = kept.join(first, ["storage_key", "position"], "left_semi").dropDuplicates(["storage_key"]).select(*queued.columns)
    return queue, keys.unionByName(queue.select(F.col("storage_key").alias("url"))).distinct()


class Checkpoint:
    """A frontier kept in a folder: the queue and the addresses seen, in buckets, so that an update rewrites what it touches.

    `save` replaces all, `update` takes finished addresses out of the queue and adds new ones, `summary` counts. Each is
    numbered; a number already applied changes nothing, so a replayed step is harmless.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.queue, self.marks = (Buckets(spark, f"{folder}/{n}", "storage_key") for n in ("queue", "seen"))

    def _number(self) -> int:
        v = self.marks.manifest()["version"]
        return 0 if v is None else v + 1

    def save(self, queue: DataFrame, seen: DataFrame) -> None:
        self.clear()
        n = self._number()
        self.queue.apply(queue.withColumn("state", F.lit("queued")), n, lambda old, new: new)
        self.marks.apply(seen.select(F.col("url").alias("storage_key")).distinct(), n, lambda old, new: new)

    def update(self, finished: DataFrame, added: DataFrame) -> None:
        """`finished` (storage_key) leave the queue; `added` (QUEUE) enter it unless they were seen before."""
        n = self._number()
        fresh = added.join(self.seen().withColumnRenamed("url", "storage_key"), "storage_key", "left_anti").dropDuplicates(["storage_key"])
        rows = fresh.withColumn("state", F.lit("queued")).unionByName(finished.select("storage_key", F.lit("done").alias("state")), allowMissingColumns=True).withColumn("_n", F.lit(n))
        keep = lambda old, new: merged(None if old is None else old.withColumn("_n", F.lit(-1)), new, "storage_key", "_n").drop("_n").where("state = 'queued'")
        self.queue.apply(rows, n, keep)
        self.marks.apply(fresh.select("storage_key"), n, lambda old, new: new if old is None else old.unionByName(new).distinct())

    def load(self) -> DataFrame:
        """The queue in its order."""
        got = self.queue.read()
        return self.spark.createDataFrame([], QUEUE) if got is None else got.where("state = 'queued'").select(*[c.split()[0] for c in QUEUE.split(", ")]).orderBy("position")

    def seen(self) -> DataFrame:
        got = self.marks.read()
        return self.spark.createDataFrame([], "url string") if got is None else got.select(F.col("storage_key").alias("url")).distinct()

    def summary(self) -> dict[str, int]:
        queued, seen = self.load().count(), self.seen().count()
        return {"queued": queued, "seen": seen, "crawled": seen - queued}

    def clear(self) -> None:
        self.queue.clear()
        self.marks.clear()


def redirect_loops() -> Column:
    """Whether the hops of a redirect chain come to an address again (fragments aside)."""
    hops = F.transform("redirect_chain", lambda h: F.regexp_replace(h["url"], "#.*$", ""))
    return F.size(F.array_distinct(hops)) < F.size(hops)
