"""Frontier, lookups, library, packages and comparisons of reports on small cases."""

import json

import pytest
from pyspark.sql import functions as F
from siteloom.functions import url as U
from siteloom.operators import compare, frontier, library, ranking
from siteloom.sinks import packages
from siteloom.sources.schema import RECORD, conformed

ROOT = "https://x.test/"


def records(spark, rows, schema):
    return conformed(spark.createDataFrame(rows, schema))


def test_numbered_rows_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 900), (None, 901)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    got = {r["v"]: r["n"] for r in ranking.numbered(df, ["v"], "n").collect()}
    assert [got[v] for v in sorted(got)] == list(range(1, 303))
    per = {}
    for r in ranking.numbered(df, ["v"], "n", 0, by=("k",)).collect():
        per.setdefault(r["k"], []).append((r["v"], r["n"]))
    assert all([n for _, n in sorted(v)] == list(range(len(v))) for v in per.values()) and len(per["hot"]) == 200
    assert ranking.numbered(df.limit(0), ["v"], "n").count() == 0


def test_seeds_and_sources(spark):
    urls = spark.createDataFrame([("https://x.test/b",), ("https://x.test/a#f",), ("https://y.test/",), ("https://x.test/a",), (ROOT,), (None,)], "location string")
    got = [tuple(r) for r in frontier.seeds(ROOT, urls, U.is_internal("url", ROOT)).orderBy("position").select("position", "url", "from_sitemap").collect()]
    assert got == [(0, ROOT, False), (1, "https://x.test/a", True), (2, "https://x.test/b", True)]
    assert frontier.seeds(ROOT, urls, U.is_internal("url", ROOT), most=2).count() == 2
    declared = spark.createDataFrame([("https://x.test/sitemap.xml",), ("https://x.test/more.xml",), ("nonsense",)], "url string")
    found = {r["url"]: (r["source"], r["required"]) for r in frontier.sitemap_sources(ROOT, ["/own.xml", " "], declared).collect()}
    assert found == {"https://x.test/own.xml": ("explicit", True), "https://x.test/sitemap.xml": ("robots", False), "https://x.test/more.xml": ("robots", False)}
    assert frontier.root_url("x", ["", "https://l.test/p#q"]) == "https://l.test/p"
    with pytest.raises(ValueError):
        frontier.root_url("nothing")


def queue(spark, urls):
    return spark.createDataFrame([(i, u, 0, False, u, None, 0) for i, u in enumerate(urls)], frontier.QUEUE)


def test_restored_frontiers_lose_what_is_out_of_scope(spark):
    q = queue(spark, [ROOT, "https://x.test/a#1", "https://x.test/a", "https://y.test/"])
    seen = spark.createDataFrame([("https://y.test/",), ("https://x.test/old",)], "url string")
    kept, marks = frontier.restored(q, seen, ROOT, U.is_internal("url", ROOT))
    assert [r["url"] for r in kept.orderBy("position").collect()] == [ROOT, "https://x.test/a"]
    assert {r["url"] for r in marks.collect()} == {ROOT, "https://x.test/a", "https://x.test/old"}
    kept, marks = frontier.restored(q, seen, ROOT, U.is_internal("url", ROOT), spider=False)
    assert kept.count() == 4 and marks.count() == 5


def test_checkpoints(spark, tmp_path):
    c = frontier.Checkpoint(spark, str(tmp_path))
    assert c.load().count() == 0 and c.seen().count() == 0
    q = queue(spark, [ROOT, "https://x.test/a"])
    c.save(q, q.select("url"))
    assert c.summary() == {"queued": 2, "seen": 2, "crawled": 0}
    c.update(q.where("position = 0").select("storage_key"), queue(spark, ["https://x.test/a", "https://x.test/b", "https://x.test/b"]))
    assert {r["url"] for r in c.load().collect()} == {"https://x.test/a", "https://x.test/b"} and c.summary() == {"queued": 2, "seen": 3, "crawled": 1}
    c.update(c.load().select("storage_key"), queue(spark, []))  # buckets without rows
    assert c.summary() == {"queued": 0, "seen": 3, "crawled": 3}
    c.clear()
    assert c.summary() == {"queued": 0, "seen": 0, "crawled": 0}


def test_lookups_keep_the_callers_order(spark):
    df = records(spark, [(i, f"t{i}") for i in range(9)] + [(3, "t3")], "id long, title string")
    assert [r["title"] for r in library.by_ids(df, [5, 3, 77, 5, 0]).collect()] == ["t5", "t3", "t5", "t0"]
    assert library.by_ids(df, []).count() == 0
    with pytest.raises(ValueError):
        library.by_ids(df, [0] * (library.MOST_IDS + 1))
    seen = []
    assert library.visited(df.dropDuplicates(["id"]).select("id"), lambda r: seen.append(r["id"])) == 9 and seen == list(range(9))
    assert [[r["id"] for r in p.collect()] for p in library.pages_of(df.dropDuplicates(["id"]).select("id"), "id", 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]


def test_saved_measurements(spark):
    df = records(spark, [(1, "a"), (2, "b")], "id long, title string")
    got = {r["id"]: r["page_speed_seo_score"] for r in library.saved(df, spark.createDataFrame([(2, 0.5)], "id long, page_speed_seo_score double"), ["page_speed_seo_score"]).collect()}
    assert got == {1: None, 2: 0.5}
    for bad in ([(2, -1.0)], [(2, float("nan"))], [(9, 1.0)]):
        with pytest.raises(ValueError):
            library.saved(df, spark.createDataFrame(bad, "id long, page_speed_seo_score double"), ["page_speed_seo_score"])
    timed = {r["id"]: r["ttfb_ms"] for r in library.with_timings(df, spark.createDataFrame([(1, 30)], "id long, ttfb_ms long")).collect()}
    assert timed == {1: 30, 2: None}
    assert json.loads(library.automation_payload(df))["summary"]["total"] == 2
    pages = records(spark, [(1, 200, "text/html", "https://x.test/"), (2, 200, "text/html", "https://u:p@x.test/"), (3, 404, "text/html", "https://x.test/c"), (4, 200, "text/html", "https://x.test/d")], "id long, status_code int, content_type string, final_url string")
    assert [r["id"] for r in library.measurable(pages, spark.createDataFrame([(4, "mobile"), (1, "desktop")], "id long, device string"), "mobile").collect()] == [1]


def test_catalogue(spark, tmp_path):
    c = library.Catalogue(spark, str(tmp_path / "c"))
    assert c.all().count() == 0
    c.put("crawl", "a", "/x", status="running")
    c.put("crawl", "a", "/x", status="paused", records=5)
    c.put("report", "r", "/y")
    assert c.get("crawl", "a")["records"] == 5 and c.resumable().count() == 1
    c.delete("report", "r")
    assert c.get("report", "r") is None
    with pytest.raises(KeyError):
        c.delete("report", "r")
    with pytest.raises(ValueError):
        c.put("crawl", "", "/x")


def test_redirect_loops(spark):
    hop = lambda u: (u, 301, None, None, None, None, None, None)
    df = spark.createDataFrame([(1, [hop("https://x.test/a"), hop("https://x.test/b")]), (2, [hop("https://x.test/a"), hop("https://x.test/a#x")]), (3, [])], f"id long, redirect_chain {RECORD['redirect_chain'][0]}")
    assert [r["id"] for r in df.where(frontier.redirect_loops()).collect()] == [2]


SITE = "id long, url string, final_url string, status_code int, content_type string, title string, canonical string, title_len long"


def crawl(spark, titles, start=1):
    return records(spark, [(start + i, f"https://x.test/{i}", f"https://x.test/{i}", 200, "text/html", t, f"https://x.test/{i}", len(t or "")) for i, t in enumerate(titles)], SITE)


def test_reports_compared(spark):
    long = "A title that is long enough for the rule, %d"
    before, after = crawl(spark, [None, "short", long % 1, None]), crawl(spark, [None, long % 2, "short"])
    got = {(r["rule"], r["request_url"][-1]): (r["state"], r["reason"]) for r in compare.compared_reports(before, after, ("title.missing", "title.tooShort")).collect()}
    assert got == {("title.missing", "0"): ("persisting", None), ("title.tooShort", "1"): ("resolved", None), ("title.tooShort", "2"): ("added", None), ("title.missing", "3"): ("notObserved", "missing in the current report")}
    doubled = records(spark, [(i, "https://x.test/0", "https://x.test/0", 200, "text/html", None, None, 0) for i in (1, 2)], SITE)
    assert {r["reason"] for r in compare.compared_reports(doubled, doubled, ("title.missing",)).collect()} == {"ambiguous occurrence"}
    edge = spark.createDataFrame([(1, "https://x.test/0", "https://gone.test/", "a", "", False, "a", 200, 404, 0, 1, 0, 1)], "id long, source_url string, target_url string, anchor_text string, rel string, rel_nofollow boolean, link_type string, source_status_code int, target_status_code int, source_depth long, target_depth long, source_position long, discovery_order long")
    rows = compare.compared_reports(before, after, ("title.missing",), edges=(edge, edge.limit(0))).where("rule = 'links.broken'").collect()
    assert [(r["state"], r["reason"]) for r in rows] == [("notObserved", compare.UNATTRIBUTED)]
    assert [r["identity"] for r in compare.unattributed(before, edge, "baseline").collect()] == ["baseline:links.broken:edge:1"]
    base = {"schema": 1, "rules": 1, "scope": {"view": "All", "limit": 5}, "thresholds": {}, "exclusions": []}
    assert compare.incompatible(base, base | {"scope": {"view": "All", "limit": 9}}) == []
    assert compare.incompatible(base, base | {"rules": 2, "exclusions": ["x"]}) == [compare.VERSIONS_DIFFER, compare.EXCLUSIONS_DIFFER]


def test_workspace_and_detail(spark, tmp_path):
    before, after = crawl(spark, ["a", "b", "c"]), crawl(spark, ["a", "B", "C", "d"], 11)
    w = compare.Workspace(spark, str(tmp_path)).save(before, after)
    assert w.counts()["changed"] == 2 and w.counts()["added"] == 1
    assert [r["row_key"] for r in w.page(limit=2).collect()] == [1, 2] and [r["row_key"] for r in w.page(after=2).collect()] == [3]
    assert [(r["side"], r["title"]) for r in compare.detail(before, after, "https://x.test/1", 1).orderBy("id").collect()] == [("previous", "b"), ("current", "B")]


def test_packages(spark, tmp_path):
    df = crawl(spark, [None] * 7 + ["=1+1<b>"])
    evidence = compare.report_evidence(df, scope=[])
    findings = compare.report_findings(evidence, scope=[])
    pages = {(r["rule"], r["page"]): r["html"] for r in packages.evidence_pages(evidence, ["evidence_id"], ["evidence_id", "observed"], 3).collect()}
    assert [k for k in sorted(pages) if k[0] == "title.missing"] == [("title.missing", i) for i in (1, 2, 3)]
    assert pages["title.missing", 2].count("<tr><td>") == 3 and "Previous page" in pages["title.missing", 2] and "Next page" not in pages["title.missing", 3]
    assert "=1+1&lt;b&gt;" in pages["title.tooShort", 1]
    packages.write_report_package(str(tmp_path / "r"), findings, evidence, {"scope": "all"}, 3)
    manifest = json.loads((tmp_path / "r" / "manifest.json").read_text())
    assert manifest["occurrences"] == evidence.count() and {f["rule"] for f in manifest["findings"]} >= {"title.missing", "h1.missing"}
    told = {f["rule"]: f for f in manifest["findings"]}["title.missing"]
    assert told["title"] == "Missing page title" and told["team"] == "Content" and told["explanation"].startswith("Missing page title was detected")
    back = spark.read.option("header", True).csv(str(tmp_path / "r" / "evidence"))
    assert back.count() == evidence.count() and back.where("rule = 'title.tooShort'").first()["observed"].startswith("'=")
    with pytest.raises(ValueError):
        packages.write_report_package(str(tmp_path / "r"), findings, evidence)
    states = compare.compared_reports(df, df, ("title.missing",))
    packages.write_comparison_package(str(tmp_path / "c"), compare.finding_statuses(states), states)
    assert json.loads((tmp_path / "c" / "manifest.json").read_text())["findings"][0]["persisting"] == 7
    assert packages.snippet_rows(df).count() == 8


def test_report_queries(spark):
    evidence = compare.report_evidence(crawl(spark, [None] * 3 + ["short"]), scope=[])
    assert compare.report_query(evidence, "title.missing", limit=2).count() == 2 and compare.report_query(evidence, "title.missing", search="/1").count() == 1
    for bad in ({"rule": "none"}, {"rule": "title.missing", "limit": 0}, {"rule": "title.missing", "sort": "x"}):
        with pytest.raises(ValueError):
            compare.report_query(evidence, **bad)
    assert "observed" in compare.pruned(evidence.withColumn("extra", F.lit(1))).columns and "extra" not in compare.pruned(evidence.withColumn("extra", F.lit(1))).columns
