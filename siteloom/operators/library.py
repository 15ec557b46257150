"""Looking records up, the library of crawls and reports, measurements saved by id, and checks of what is stored."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.operators import audit, gates
from siteloom.sources.schema import once

#: Ids of one lookup: they come from a caller and are sent out with the plan.
MOST_IDS = 10_000


def by_ids(records: DataFrame, ids: list[int]) -> DataFrame:
    """The records of the given ids in the caller's order, an id given twice twice; unknown ids give nothing.

    The ids are a small table that is broadcast (MOST_IDS bounds it); the filter reaches the scan.
    """
    if len(ids) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids")
    wanted = records.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, _at long")
    rows = once(records.where(F.col("id").isin(list(set(ids)))))
    return rows.join(F.broadcast(wanted), "id").orderBy("_at").drop("_at")


def visited(rows: DataFrame, visit: Callable, order: str = "id") -> int:
    """Calls `visit` with every row in order, partition after partition, so that the driver holds one at a time. Returns how
    many there were.
    """
    n = 0
    for row in rows.orderBy(order).toLocalIterator(prefetchPartitions=False):
        visit(row)
        n += 1
    return n


def pages_of(rows: DataFrame, key: str, size: int = 1000) -> Iterator[DataFrame]:
    """The rows in pages by key (unique): each page begins after the last key of the one before, no offset is read."""
    after = None
    while True:
        page = (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)
        last = page.agg(F.max(key)).first()[0]
        if last is None:
            return
        yield page
        after = last


def incomplete(records: DataFrame, limit: int) -> DataFrame:
    """Records whose body passes `limit` bytes have an incomplete response, which no rule on content looks at."""
    over = F.coalesce(F.col("size_bytes") > limit, F.lit(False)) & gates.success()
    return records.withColumns({"indexability": F.when(over, "Non-indexable").otherwise(F.col("indexability")), "indexability_status": F.when(over, gates.INCOMPLETE).otherwise(F.col("indexability_status"))})


TIMINGS = ("dns_lookup_time_ms", "tcp_connect_time_ms", "tls_handshake_time_ms", "ttfb_ms", "download_time_ms", "total_network_time_ms", "resolved_ip_count", "transfer_rate_bytes_per_sec")


def with_timings(records: DataFrame, timings: DataFrame) -> DataFrame:
    """`records` with the network timings measured for their ids (id, TIMINGS); others keep theirs."""
    new = timings.select("id", *[F.col(c).alias(f"_t_{c}") for c in TIMINGS if c in timings.columns]).dropDuplicates(["id"])
    got = records.join(new.withColumn("_known", F.lit(True)), "id", "left")
    return got.withColumns({c: F.when(F.col("_known"), F.col(f"_t_{c}")).otherwise(F.col(c)) for c in TIMINGS if f"_t_{c}" in got.columns}).drop("_known", *[c for c in new.columns if c != "id"])


def measurable(records: DataFrame, measured: DataFrame | None = None, device: str | None = None) -> DataFrame:
    """Records worth measuring: complete pages at an http(s) address without credentials; those in `measured` (id, device) for
    the device are skipped, so that a run that was broken off goes on.
    """
    rows = once(records.where(gates.success_html() & F.rlike("final_url", F.lit(r"^https?://[^/@]+(/|\?|#|$)"))))
    if measured is None:
        return rows
    done = measured if device is None else measured.where(F.col("device") == device)
    return rows.join(done.select("id").distinct(), "id", "left_anti")


def saved(records: DataFrame, measured: DataFrame, columns: list[str]) -> DataFrame:
    """`records` with `columns` of `measured` (id, columns) in place of theirs. An id that no record has, and numbers that are
    negative or not finite, are refused.
    """
    numbers = [c for c, t in measured.dtypes if c in columns and t in ("double", "float", "bigint", "int")]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.coalesce((F.col(c) < 0) | F.isnan(F.col(c).cast("double")) | (F.col(c).cast("double") == float("inf")), F.lit(False))
    if measured.where(bad).limit(1).count():
        raise ValueError("measurements must be finite and not negative")
    if measured.join(records.select("id"), "id", "left_anti").limit(1).count():
        raise ValueError("a measurement of an unknown record")
    new = measured.select("id", *[F.col(c).alias(f"_m_{c}") for c in columns], F.lit(True).alias("_known")).dropDuplicates(["id"])
    have = set(records.columns)
    got = records.join(new, "id", "left")
    return got.withColumns({c: F.when(F.col("_known"), F.col(f"_m_{c}")).otherwise(F.col(c) if c in have else F.lit(None)) for c in columns}).drop("_known", *[f"_m_{c}" for c in columns])


#: How large the stored parts of a capture may be, in bytes, and its number of header lines.
MOST_BODY, MOST_TEXT, MOST_HEADERS, MOST_HEADER_LINES = 8 * 1024 * 1024, 4 * 1024 * 1024, 256 * 1024, 256


def capture_faults() -> Column:
    """What is wrong with a capture, by name; none: an empty array."""
    absolute = lambda c: F.rlike(F.coalesce(F.col(c), F.lit("")), F.lit(r"^https?://[^/?#]+"))
    over = lambda c, most: F.coalesce(F.octet_length(c) > most, F.lit(False))
    tests = {
        "source_url": ~absolute("source_url"), "final_url": ~absolute("final_url"), "raw_html": over("raw_html", MOST_BODY), "rendered_html": over("rendered_html", MOST_BODY), "visible_text": over("visible_text", MOST_TEXT),
        "response_headers": over("response_headers", MOST_HEADERS) | F.coalesce(F.size(F.split("response_headers", "\n")) > MOST_HEADER_LINES, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


def automation_payload(records: DataFrame, status: str = "finished", scope: list[str] = ()) -> str:
    """The summary of a crawl as JSON for another program."""
    row = audit.summary(records, scope=list(scope)).first()
    return json.dumps({"status": status, "summary": row.asDict() if row else {}}, sort_keys=True)


class Catalogue:
    """The crawls and reports that a folder holds: an entry each, the last one of an id in force."""

    COLUMNS = "kind string, id string, label string, mode string, seed string, status string, records long, updated_at timestamp, path string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, kind: str, ident: str, path: str, label: str = "", mode: str = "spider", seed: str = "", status: str = "finished", records: int = 0) -> None:
        if not ident or len(ident) > 200:
            raise ValueError("an entry needs an id of at most 200 characters")
        row = self.spark.createDataFrame([(kind, ident, label, mode, seed, status, records, path)], "kind string, id string, label string, mode string, seed string, status string, records long, path string")
        row.withColumn("updated_at", F.current_timestamp()).select(*[c.split()[0] for c in self.COLUMNS.split(", ")]).coalesce(1).write.mode("append").parquet(self.folder)

    def all(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.COLUMNS).parquet(self.folder)
        except Exception as e:  # the folder is not there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.COLUMNS)
        last = rows.groupBy("kind", "id").agg(F.max(F.struct("updated_at", "label", "mode", "seed", "status", "records", "path")).alias("_l"))
        return last.select("kind", "id", *[F.col(f"_l.{c}").alias(c) for c in ("label", "mode", "seed", "status", "records", "updated_at", "path")]).where("status <> 'deleted'")

    def get(self, kind: str, ident: str):
        return self.all().where((F.col("kind") == kind) & (F.col("id") == ident)).first()

    def delete(self, kind: str, ident: str) -> None:
        if self.get(kind, ident) is None:
            raise KeyError(ident)
        self.put(kind, ident, "", status="deleted")

    def resumable(self) -> DataFrame:
        """Crawls that were broken off."""
        return self.all().where("kind = 'crawl' and status in ('paused', 'running', 'failed')")
