"""Rows of metric providers and captured payloads, from their JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import trimmed


def _finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def search_console(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(url, clicks, impressions, ctr, average_position) of query responses: the first key of each row is the address."""
    rows = F.from_json(payload, "struct<rows:array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>>")
    return df.select(F.explode(rows["rows"]).alias("r")).select(F.try_element_at("r.keys", F.lit(1)).alias("url"), "r.clicks", "r.impressions", "r.ctr", F.col("r.position").alias("average_position")).where(F.col("url").isNotNull())


def analytics(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(url, sessions, engaged_sessions, conversions, revenue): host and path dimensions make an https address; values that are
    no finite numbers are 0.
    """
    rows = F.from_json(payload, "struct<rows:array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>>")
    dim = lambda i: F.try_element_at("r.dimensionValues", F.lit(i))["value"]
    value = lambda i: F.coalesce(_finite(F.try_element_at("r.metricValues", F.lit(i))["value"].try_cast("double")), F.lit(0.0))
    names = ("sessions", "engaged_sessions", "conversions", "revenue")
    return df.select(F.explode(rows["rows"]).alias("r")).select(F.concat(F.lit("https://"), dim(1), dim(2)).alias("url"), *[value(i).alias(n) for i, n in enumerate(names, 1)]).where(F.col("url").isNotNull())


def backlinks(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(url, backlink_count, referring_domain_count, backlink_authority) with snake or camel case field names."""
    rows = F.from_json(payload, "array<struct<url:string,backlinks:bigint,backlink_count:bigint,backlinkCount:bigint,referring_domains:bigint,referringDomains:bigint,authority_score:double,authorityScore:double>>")
    r = lambda *names: F.coalesce(*[F.col(f"r.{n}") for n in names])
    return df.select(F.explode(rows).alias("r")).select(
        "r.url", r("backlinks", "backlink_count", "backlinkCount").alias("backlink_count"), r("referring_domains", "referringDomains").alias("referring_domain_count"), _finite(r("authority_score", "authorityScore")).alias("backlink_authority")
    )


def page_speed(payload: Column | str) -> Column:
    """Lab scores and timings of a payload as a struct; scores outside 0..1 and negative timings are null."""
    p = F.from_json(payload, "struct<lighthouseResult:struct<categories:struct<performance:struct<score:double>,seo:struct<score:double>>,audits:map<string,struct<numericValue:double>>>>")["lighthouseResult"]
    score = lambda c: F.when(_finite(c).between(0, 1), c)
    timing = lambda n: F.when(_finite(p["audits"][n]["numericValue"]) >= 0, p["audits"][n]["numericValue"])
    return F.struct(score(p["categories"]["performance"]["score"]).alias("performance"), score(p["categories"]["seo"]["score"]).alias("seo"), timing("largest-contentful-paint").alias("lcp_ms"), timing("total-blocking-time").alias("tbt_ms"), timing("cumulative-layout-shift").alias("cls"))


def field_vitals(payload: Column | str) -> Column:
    """75th percentiles of field measurements, numbers or numeric strings; has_data where any is there."""
    m = F.from_json(payload, "struct<record:struct<metrics:map<string,struct<percentiles:struct<p75:string>>>>>")["record"]["metrics"]
    p75 = lambda n: F.when(_finite(m[n]["percentiles"]["p75"].try_cast("double")) >= 0, m[n]["percentiles"]["p75"].try_cast("double"))
    values = [p75(n).alias(a) for n, a in (("largest_contentful_paint", "lcp_ms"), ("interaction_to_next_paint", "inp_ms"), ("cumulative_layout_shift", "cls"))]
    any_of = F.coalesce(*values).isNotNull()
    return F.struct(*values, any_of.alias("has_data"))


SNIPPET_ROWS = 1000


def snippets(df: DataFrame) -> DataFrame:
    """(url, title, description) of a snippet table with any of the usual header names; over 1,000 rows are refused."""
    names = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    pick = lambda *options: next((F.col(f"`{names[o]}`") for o in options if o in names), F.lit(None).cast("string"))
    out = df.select(trimmed(pick("url", "address")).alias("url"), pick("title").alias("title"), pick("description", "meta_description").alias("description"))
    n = out.limit(SNIPPET_ROWS + 1).count()
    if n > SNIPPET_ROWS:
        raise ValueError(f"more than {SNIPPET_ROWS} snippets")
    return out


@dataclass
class CrawlConfig:
    """Settings of a crawl with their defaults; JSON uses camel case, unknown names are refused."""

    start_url: str = ""
    mode: str = "spider"
    max_urls: int = 10_000
    max_depth: int = 20
    include_subdomains: bool = False
    follow_nofollow: bool = False
    strip_query: bool = False
    drop_parameters: list[str] = field(default_factory=list)
    max_parameters: int | None = None
    include_patterns: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    max_url_bytes: int = 0
    max_folder_depth: int = 0
    near_duplicate_distance: int = 6
    user_agent: str = "siteloom"

    def __post_init__(self):
        if self.mode not in ("spider", "list"):
            raise ValueError(f"no mode {self.mode}")
        if self.max_urls < 1 or self.max_depth < 0 or not 0 <= self.near_duplicate_distance <= 63:
            raise ValueError("limits out of range")

    @classmethod
    def from_json(cls, text: str) -> CrawlConfig:
        raw = {"".join(f"_{c.lower()}" if c.isupper() else c for c in k): v for k, v in json.loads(text).items()}
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**raw)

    def to_json(self) -> str:
        camel = lambda k: "".join(p.title() if i else p for i, p in enumerate(k.split("_")))
        return json.dumps({camel(k): v for k, v in asdict(self).items()})


def list_seeds(urls: DataFrame, url: str, position: str) -> DataFrame:
    """(storage_key, url, list_position, list_duplicate_index) of a pasted list in order: repeats are kept and numbered per
    address. Positions are given by the input, so nothing is numbered in one task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("url").orderBy("list_position")
    rows = urls.select(trimmed(url).alias("url"), F.col(position).cast("int").alias("list_position")).where(F.col("url") != "")
    return rows.select(F.concat(F.lit("list:"), "list_position", F.lit(":"), "url").alias("storage_key"), "url", "list_position", F.row_number().over(w).alias("list_duplicate_index"))
