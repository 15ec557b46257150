"""Frozen packages of an audit report or of a comparison of two: evidence as pages and tables per finding, and a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.operators.ranking import numbered
from siteloom.sinks.files import flat

# Fixed value: the rows of an evidence page.
PAGE_ROWS = 1_000


def escaped(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\r\n]+", " ")


def evidence_pages(evidence: DataFrame, order: list[str], columns: list[str], rows: int = PAGE_ROWS) -> DataFrame:
    """(rule, page, html): documents of at most `rows` pieces of evidence each, from page 1, with links to their neighbours.

    Rows are numbered within a finding by range, so that a finding that holds most of the evidence meets no single task; a
    page gathers at most `rows` of them.
    """
    placed = numbered(evidence.select("rule", *dict.fromkeys([*order, *columns])), order, "_n", 0, by=("rule",))
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    page = (F.floor(F.col("_n") / rows) + 1).cast("long")
    groups = placed.groupBy("rule", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("_n", cells.alias("row")))).alias("_rows"))
    last = groups.groupBy("rule").agg(F.max("page").alias("_last"))
    link = lambda to, text: F.concat(F.lit('<a href="../page='), to.cast("string"), F.lit(f'">{text}</a> '))
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escaped(F.col("rule")), F.lit("</title></head><body><h1>"), escaped(F.col("rule")), F.lit(" "), F.col("page").cast("string"), F.lit(" / "), F.col("_last").cast("string"), F.lit("</h1>"))
    around = F.concat(F.when(F.col("page") > 1, link(F.col("page") - 1, "Previous page")).otherwise(""), F.when(F.col("page") < F.col("_last"), link(F.col("page") + 1, "Next page")).otherwise(""))
    names = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    html = F.concat(head, around, F.lit(names), F.array_join(F.transform("_rows", lambda r: r["row"]), ""), F.lit("</table></body></html>"))
    return groups.join(last, "rule").select("rule", "page", html.alias("html"))


def _published(df: DataFrame, folder: str, write) -> None:
    """Writes beside the folder and moves it there: it appears whole or not at all. A folder that is not empty is refused."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(folder)) and len(list(fs.listStatus(path(folder)))):
        raise ValueError("the destination must be empty")
    part = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        manifest = write(part)
        out = fs.create(path(f"{part}/manifest.json"), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, default=str).encode()))
        out.close()
        fs.delete(path(folder), True)
        fs.rename(path(part), path(folder))
    finally:
        fs.delete(path(part), True)


def _tables(rows: DataFrame, part: str) -> None:
    flat(rows, guard=True).repartitionByRange("rule").write.option("header", True).option("escape", '"').partitionBy("rule").csv(f"{part}/evidence")


def write_report_package(folder: str, findings: DataFrame, evidence: DataFrame, settings: dict | None = None, rows: int = PAGE_ROWS) -> None:
    """A folder with pages/rule=../page=.., evidence/rule=.. (CSV, formulas guarded) and a manifest of findings and counts."""

    def write(part: str) -> dict:
        columns = ["evidence_id", "request_url", "source_url", "target_url", "observed"]
        evidence_pages(evidence, ["evidence_id"], columns, rows).repartition("rule", "page").write.partitionBy("rule", "page").text(f"{part}/pages")
        _tables(evidence, part)
        found = [r.asDict() for r in findings.orderBy("rule").collect()]  # one row per rule
        return {"schema": 1, "settings": settings or {}, "findings": found, "occurrences": sum(f["occurrences"] for f in found), "page_rows": rows}

    _published(evidence, folder, write)


def write_comparison_package(folder: str, statuses: DataFrame, states: DataFrame, reasons: list[str] = (), rows: int = PAGE_ROWS) -> None:
    """The same for the comparison of two reports: pages and tables of what became of each piece of evidence."""

    def write(part: str) -> dict:
        columns = ["request_url", "occurrence", "state", "reason"]
        evidence_pages(states, ["request_url", "occurrence", "state", "reason"], columns, rows).repartition("rule", "page").write.partitionBy("rule", "page").text(f"{part}/pages")
        _tables(states, part)
        return {"schema": 1, "incompatible": list(reasons), "findings": [r.asDict() for r in statuses.orderBy("rule").collect()], "page_rows": rows}

    _published(states, folder, write)


# The limits of a snippet export.
SNIPPET_ROWS, SNIPPET_BYTES = 1_000, 5 * 1024 * 1024


def snippet_rows(records: DataFrame) -> DataFrame:
    """(url, title, description) of at most SNIPPET_ROWS pages by id, formulas guarded; larger exports are refused by size."""
    rows = records.orderBy("id").limit(SNIPPET_ROWS).select(F.col("final_url").alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("meta_description", F.lit("")).alias("description"))
    size = rows.agg(F.sum(F.octet_length("url") + F.octet_length("title") + F.octet_length("description") + 12)).first()[0] or 0
    if size > SNIPPET_BYTES:
        raise ValueError(f"{size} bytes of snippets; an export holds {SNIPPET_BYTES}")
    return flat(rows, guard=True)
