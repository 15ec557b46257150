"""Operators that SQL cannot check on the tables, against small cases and brute force."""

import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siteloom.functions import html as H
from siteloom.functions import text as T
from siteloom.functions import url as U
from siteloom.operators import audit, compare, graph, grid, links, references
from siteloom.sinks import files
from siteloom.sources import metrics, pages
from siteloom.sources.schema import RECORD, conformed
from siteloom.streaming import ingest

SITE = "https://a.test"


def site(spark, rows):
    """Conformed records from dicts; ids count from 1."""
    base = {"status_code": 200, "content_type": "text/html", "indexability": "Indexable", "indexability_status": "Indexable"}
    columns = sorted({k for r in rows for k in r} | set(base))
    kinds = conformed(spark.range(0)).schema
    full = [{**base, **r} for r in rows]
    data = [(i, *[r.get(c) for c in columns]) for i, r in enumerate(full, 1)]
    schema = "id long, " + ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in columns)
    df = spark.createDataFrame(data, schema)
    for c in ("url", "final_url", "storage_key"):
        if c not in df.columns:
            df = df.withColumn(c, F.concat(F.lit(f"{SITE}/"), "id"))
    return conformed(df)


def flags(df, *names):
    return {r["id"]: tuple(n for n in names if r[n]) for r in df.collect() if any(r[n] for n in names)}


def u(i):
    return f"{SITE}/{i}"


def test_canonical_flags(spark):
    df = site(spark, [{"canonical": u(2)}, {"canonical": u(3)}, {"canonical": u(2)}, {"canonical": u(4)}, {"canonical": u(6)}, {"status_code": 404}, {"canonical": u(99)}, {"canonical": u(9)}, {"status_code": 301}, {"canonical": "/relative"}, {"canonical": f"{SITE}/11#top"}])
    got = flags(references.canonical_flags(df, []), *references.FLAGS[:6])
    assert got == {1: ("canonical_chain", "canonical_loop"), 2: ("canonical_chain", "canonical_loop"), 3: ("canonical_chain", "canonical_loop"), 5: ("canonical_to_error",), 7: ("canonical_uncrawled",), 8: ("canonical_to_redirect",)}


def test_pagination_flags(spark):
    df = site(spark, [{"rel_next": u(2)}, {"rel_next": u(3), "rel_prev": u(1)}, {"rel_prev": u(1)}, {"rel_next": u(4)}, {"rel_next": u(6)}, {"status_code": 500}, {"rel_next_targets": [u(8), u(1)]}, {}])
    got = flags(references.relation_flags(df, []), *references.FLAGS[6:])
    assert got == {2: ("next_non_reciprocal",), 3: ("prev_non_reciprocal",), 4: ("next_loop",), 5: ("next_to_error",), 7: ("next_non_reciprocal",)}


def test_amp_flags(spark):
    df = site(spark, [{"amphtml": u(2)}, {"canonical": u(1), "amp_document": True}, {"amphtml": u(4)}, {"amp_document": False}, {"amphtml": u(6)}, {"status_code": 404}, {"amphtml_targets": [], "amphtml": u(4)}])
    got = flags(references.relation_flags(df, []), *references.FLAGS[6:])
    assert got == {3: ("amp_non_reciprocal", "amp_target_missing_marker"), 5: ("amp_to_error",)}


def test_hreflang_flags(spark):
    link = lambda *ts: [{"hreflang": "de", "url": u(t), "valid": True} for t in ts]
    df = site(spark, [{"hreflang_links": link(1, 2)}, {"hreflang_links": link(1)}, {"hreflang_links": link(4)}, {"canonical": u(1)}, {"hreflang_links": link(99)}])
    got = flags(references.hreflang_flags(df, []), "hreflang_missing_return", "hreflang_non_canonical")
    assert got == {3: ("hreflang_missing_return", "hreflang_non_canonical")}


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=8))
@settings(max_examples=4, deadline=None)
def test_cycles(spark, pairs):
    nxt = dict(pairs)
    want = set()
    for k in nxt:
        at, steps = k, 0
        while at in nxt and steps <= len(nxt):
            at, steps = nxt[at], steps + 1
        if steps > len(nxt):
            want.add(k)
    df = spark.createDataFrame(list(nxt.items()), "id long, next long")
    assert {r["id"] for r in references.cycle_ids(df, []).collect()} == want


def test_duplicates_treat_spaces_and_case_alike(spark):
    df = site(spark, [{"title": "A  b"}, {"title": " a B "}, {"title": "c"}, {"title": "  "}, {"title": None}, {"title": "a b", "status_code": 404}])
    assert [r["id"] for r in audit.view(df, "TitleDuplicate", scope=[]).orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in audit.view(df, "TitleMissing", scope=[]).orderBy("id").collect()] == [4, 5]


def test_all_views_and_rules_are_there():
    assert len(audit.VIEWS) == 75 and len(audit.COUNTERS) + 2 == 58  # and the two of indexability
    assert len(audit.RULES) == 64


def test_views_match_their_predicates(spark):
    assert set(audit.predicates()) == set(audit.VIEWS)
    assert {v for v, _, _ in audit.RULES.values()} - {"_redirect_error"} <= set(audit.VIEWS)


def test_empty_crawl(spark):
    df = site(spark, [{}]).limit(0)
    assert audit.issues(df, scope=[]).count() == 0
    assert audit.summary(df, scope=[]).first()["total"] == 0
    assert links.sitemap_report(df, []).count() == 0


def test_thresholds_are_validated():
    with pytest.raises(ValueError):
        audit.Thresholds(title_min_chars=90)
    with pytest.raises(ValueError):
        audit.Thresholds(min_text_ratio_percent=101)


def test_grid_query_is_validated():
    for bad in ({"view": "Nope"}, {"rules": (grid.Rule("depth", "contains", "1"),)}, {"rules": (grid.Rule("depth", "equals", "inf"),)}, {"rules": (grid.Rule("x", "equals"),)}, {"rules": (grid.Rule("url", "isEmpty"),) * 21}):
        with pytest.raises(ValueError):
            grid.GridQuery(**bad)


def test_grid_search_reads_lists_and_is_literal(spark):
    df = site(spark, [{"rel_next_targets": ["https://x/100%_a"]}, {"title": "100 a"}, {"custom_extractions": [{"name": "n", "values": ["100%_A"]}]}])
    assert [r["id"] for r in df.where(grid.search("100%_a")).orderBy("id").collect()] == [1, 3]
    assert df.where(grid.segment("[", True)).count() == 0  # an invalid pattern finds nothing


def test_grid_search_reads_first_inlinks(spark):
    df = site(spark, [{"url": f"{SITE}/{i}", "final_url": f"{SITE}/{i}", "storage_key": f"{SITE}/{i}"} for i in range(1, 5)] + [{"structured_data_issues": [("warning", "No museum", "$")]}])
    rows = [(1, f"{SITE}/museum", f"{SITE}/1", "x", 1, 1), (2, "s", f"{SITE}/2", "The Museum", 1, 2), (3, "s", f"{SITE}/3", "first", 1, 3), (4, "s", f"{SITE}/3", "museum later", 2, 4)]
    edges = spark.createDataFrame(rows, "id long, source_url string, target_url string, anchor_text string, source_position int, discovery_order long")
    query = grid.GridQuery(search=" Museum ")
    assert [r["id"] for r in grid.page(df, query, edges, []).collect()] == [1, 2, 5]
    assert [r["id"] for r in grid.page(df, grid.GridQuery(search="Museum", sort="firstInlinkSourceUrl", descending=True), edges, []).collect()] == [2, 1, 5]
    assert grid.response(df, query, edges, [])[1].first()["total"] == 3
    with pytest.raises(ValueError):
        grid.page(df, query, scope=[])


def test_grid_search_query_equals_sql_with_first_inlinks(spark, sf):
    from compare import differences, views
    from siteloom.plans import registry

    inlinks = f"({registry.SQL['first_inlinks']})"
    sql = f"""
        SELECT crawl_id, id, final_url FROM ({registry.SQL["grid_search"]}) UNION
        SELECT r.crawl_id, r.id, r.final_url FROM (SELECT DISTINCT crawl_id, id, final_url FROM crawl_records WHERE id IS NOT NULL) r JOIN {inlinks} f ON f.crawl_id = r.crawl_id AND f.id = r.id
        WHERE lower(coalesce(f.first_inlink_source_url, '')) LIKE '%museum%' OR lower(coalesce(f.first_inlink_anchor_text, '')) LIKE '%museum%'
    """
    assert differences(registry.QUERIES["grid_search"](spark, sf), views(sf), sql) == ""


def test_grid_custom_sort(spark):
    df = site(spark, [{"custom_extractions": [{"name": "p", "values": ["b"]}]}, {}, {"custom_extractions": [{"name": "p", "values": ["A", "c"]}]}])
    assert [r["id"] for r in grid.page(df, grid.GridQuery(sort="custom:p:value"), scope=[]).collect()] == [2, 3, 1]


def test_crawl_path(spark):
    rows = [(1, "s", "a", 0), (2, "s", "b", 0), (3, "a", "c", 1), (4, "b", "d", 1), (5, "d", "t", 2), (6, "c", "e", 2), (7, "e", "t", 3)]
    df = spark.createDataFrame([(i, f"{SITE}/{x}", f"{SITE}/{y}", d, i, 1) for i, x, y, d in rows], "id long, source_url string, target_url string, source_depth long, discovery_order long, source_position long")
    assert [r["edge_id"] for r in graph.crawl_path(df, f"{SITE}/t#part").orderBy("step").collect()] == [2, 4, 5]
    assert graph.crawl_path(df, f"{SITE}/none").count() == 0
    assert graph.crawl_path(df, f"{SITE}/s").count() == 0


def test_graph_snapshot_adds_placeholders_within_the_cap(spark):
    records = site(spark, [{}, {}])
    edges = spark.createDataFrame([(1, u(1), u(7), "a", False), (2, u(8), u(2), "a", False)], "id long, source_url string, target_url string, link_type string, rel_nofollow boolean")
    nodes, kept = graph.graph_snapshot(records, edges, max_nodes=3)
    assert {r["url"] for r in nodes.collect()} == {u(1), u(2), u(7)} and [r["id"] for r in kept.collect()] == [1]


def test_clusters_equal_the_sequential_rule(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = []
    for i in range(80):
        x = r.choice(base)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        prints.append((i, x - (1 << 64) if x >> 63 else x))
    root = {}
    for i, x in prints:
        hit = next((j for j, y in prints[:i] if bin((x ^ y) & ((1 << 64) - 1)).count("1") <= 6), None)
        root[i] = i if hit is None else root[hit]
    df = spark.createDataFrame(prints, "i long, p long")
    assert {r["i"]: r["root"] for r in graph.fingerprint_clusters(df, "i", "p").collect()} == root


def test_compare_classes(spark):
    before = site(spark, [{"title": "a"}, {"response_hash": "x"}, {"title": "gone"}, {"content_hash": "1", "content_hash_context": "c"}])
    after = site(spark, [{"title": "b"}, {"response_hash": "y"}, {"content_hash": "2", "content_hash_context": "c", "url": u(4), "final_url": u(4), "storage_key": u(4)}])
    after = after.withColumn("url", F.coalesce("url", F.concat(F.lit(f"{SITE}/"), "id"))).withColumn("final_url", F.coalesce("final_url", "url")).withColumn("storage_key", F.coalesce("storage_key", "url"))
    got = {r["request_url"]: (r["change"], list(r["fields"]), r["content"]) for r in compare.compared(before, after).collect()}
    assert got == {u(1): ("changed", ["title"], "unavailable"), u(2): ("responseOnly", ["responseHash"], "unavailable"), u(3): ("removed", [], "notApplicable"), u(4): ("changed", ["content"], "changed")}


def test_report_states(spark):
    before, after = site(spark, [{"title": None}, {"title": "x"}, {"title": None}]), site(spark, [{"title": "now"}, {"title": None}])
    got = {(r["rule"], r["request_url"]): r["state"] for r in compare.compared_reports(before, after, ("title.missing",)).collect()}
    assert got == {("title.missing", u(1)): "resolved", ("title.missing", u(2)): "added", ("title.missing", u(3)): "notObserved"}
    assert compare.finding_statuses(compare.compared_reports(before, after, ("title.missing",))).first()["status"] == "mixedChanges"


# ---------------------------------------------------------------- URLs and text


@given(st.text(st.sampled_from("abAB/.?#&=%2e:@ ä"), max_size=24))
@settings(max_examples=300, deadline=None)
def test_resolving_is_idempotent_and_drops_fragments(href):
    got = U.resolve_href(href, "https://a.test/x/y?z=1")
    if got is not None:
        assert "#" not in got and got.startswith(("http://", "https://"))
        assert U.resolve_href(got, "https://other.test/") == got


def test_plain_expressions_agree_with_the_resolver(spark):
    urls = ["https://a.test", "http://a.test:80/x", "https://a.test:443", "https://a.test/?q=1", "https://a.test/a/b/?q#f", "http://a.test:8080/#x", "https://a.test/%41"]
    df = spark.createDataFrame([(x,) for x in urls], "u string")
    for r in df.select("u", U.is_plain("u").alias("ok"), U.plain_serialised("u").alias("s")).collect():
        assert r["ok"] and r["s"] == U.joined(U.parse(r["u"])), r
    odd = ["HTTPS://A.test/", "https://a.test/a b", "https://a.test/../x", "https://bücher.test/ä", "list:4:https://a.test/", None, ""]
    got = {r["u"]: r["s"] for r in spark.createDataFrame([(x,) for x in odd], "u string").select("u", U.serialised("u").alias("s")).collect()}
    assert got == {x: (None if not x else U.joined(U.parse(x))) for x in odd}


def test_aliases(spark):
    df = spark.createDataFrame([(1, " https://a.test/?q=1#f ", None)], "id int, a string, b string")
    assert sorted(r["alias"] for r in U.with_aliases(df, ["a", "b"]).collect()) == ["https://a.test/?q=1", "https://a.test/?q=1#f", "https://a.test?q=1"]


def test_query_normalisation_does_not_depend_on_order(spark):
    rows = [("https://a.test/p?b=2&a=1&utm_x=9#f",), ("https://a.test/p?a=1&b=2",)]
    got = {r[0] for r in spark.createDataFrame(rows, "u string").select(U.normalised_query("u", drop=["utm_.*"])).collect()}
    assert got == {"https://a.test/p?a=1&b=2"}


def test_text_keys(spark):
    df = spark.createDataFrame([("  A  b\t",), (None,), ("",)], "t string")
    assert [tuple(r) for r in df.select(T.text_key("t"), T.trimmed("t"), T.blank("t")).collect()] == [("a b", "A  b", False), (None, None, True), ("", "", True)]


def test_bounded_bytes_cut_at_characters(spark):
    df = spark.createDataFrame([("aäöü",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(T.bounded_bytes("t", 4)).collect()] == ["aä", "abc", None]


# ---------------------------------------------------------------- markup

DOC = """<!doctype html><html amp><head><title> A  title </title><title>B</title><meta name=description content="Desc"><meta name="robots" content="noindex"><link rel=canonical href="/x#y">
<link rel="alternate" hreflang="en-US" href="https://a.test/"><link rel=alternate hreflang="english" href="/e"><script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Product"},{"name":"x"}]}</script>
<script type="application/ld+json">{bad</script></head><body><h1>One</h1><p id=a>Hi<p id=a>there <b>bold</b><center>c</center><img src="http://i.test/a.png" alt=""><a href="../up/./y?q=1#f" rel="nofollow ugc">go</a>
<form action="http://z"></form><template><h1>no</h1></template></body></html>"""


def test_signals():
    s = H.signals(f"{SITE}/d/p.html", DOC)
    want = {"title": "A title", "title_count": 2, "meta_description": "Desc", "canonical": f"{SITE}/x", "h1_count": 1, "hreflang_count": 2, "hreflang_invalid_count": 1, "json_ld_count": 2, "json_ld_invalid_count": 1, "structured_data_error_count": 3, "images_missing_alt": 1, "mixed_content_count": 1, "insecure_form_count": 1, "deprecated_html_tag_count": 1, "duplicate_id_count": 1, "html_doctype": True, "amp_document": True, "viewport": False}
    assert {k: s[k] for k in want} == want
    assert s["anchors"][0]["target_url"] == f"{SITE}/up/y?q=1" and s["anchors"][0]["rel_nofollow"]


@given(st.text(st.sampled_from("<>/abp =\"'!-&;#x"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_markup_gives_signals(markup):
    assert H.signals(f"{SITE}/", markup)["h1_count"] >= 0


def test_page_signals_of_null_and_empty_markup(spark):
    df = spark.createDataFrame([(1, SITE, None), (2, SITE, ""), (3, None, DOC), (4, f"{SITE}/d/p", DOC)], "i int, u string, h string")
    got = {r["i"]: r["title"] for r in pages.page_signals(df, "i", "u", "h").collect()}
    assert got == {1: None, 2: None, 4: "A title"}


def test_robots_directives():
    assert H.has_directive("none", "noindex") and H.has_directive("a, NOINDEX;b", "noindex")
    assert not H.has_directive("googlebot: noindex, max-snippet:-1", "noindex") and not H.has_directive(None, "noindex")


def test_link_header():
    assert H.header_canonicals('<https://a.test/x>; rel="canonical", </y>; rel=next, </z>; rel="canonical"; anchor="#other"', f"{SITE}/p") == ["https://a.test/x"]


def test_robots_longest_rule_wins():
    r = pages.Robots("User-agent: *\nDisallow: /\n\nUser-agent: larkcrawler\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nCrawl-delay: 1.5\nSitemap: https://a.test/s.xml", "larkcrawler/2")
    assert [r.allowed(p) for p in ("/", "/a/x", "/a/b/c", "/q.pdf", "/q.pdf?x")] == [True, False, True, False, True]
    assert r.delay_ms == 1500 and r.sitemaps == ["https://a.test/s.xml"] and not pages.Robots("User-agent: *\nDisallow: /", "x").allowed("/")


def test_robots_batch_tests_every_file_with_every_address(spark, sf):
    from siteloom.plans.pages import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_kind = 'robots_txt' and text is not null and doc_id is not null").dropDuplicates(["doc_id"]).collect()
    urls = [r["final_url"] for r in spark.read.parquet(f"{sf}/crawl_records.parquet").where("id is not null").select("final_url").distinct().collect()]
    got = {r["verdict"]: r["n"] for r in QUERIES["robots_batch"](spark, sf).collect()}
    assert sum(got.values()) == len(docs) * len(urls)
    texts = ["User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$", "User-agent: larkcrawler\nDisallow: /a\nAllow: /a", "User-agent: x\nDisallow: /", "", "User-agent: *\nDisallow: /"]
    texts += [f"User-agent: *\nDisallow: /{i}" for i in range(40)]
    urls = [f"{SITE}/a", f"{SITE}/a/b", f"{SITE}/q.pdf", f"{SITE}/7?x=1", SITE, "nothing"]
    files = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for u in urls:
            p = U.parse(u)
            verdict = "invalid" if p is None else "allowed" if pages.Robots(t, "larkcrawler").allowed(p[3] + ("" if p[4] is None else f"?{p[4]}")) else "blocked"
            want[i, verdict] = want.get((i, verdict), 0) + 1
    rows = pages.robots_batches(files, spark.createDataFrame([(u,) for u in urls], "url string").repartition(3), "larkcrawler").collect()
    assert {(r["id"], r["verdict"]): r["n"] for r in rows} == want


def test_frontier_query_reaches_every_level(spark, tmp_path):
    from siteloom.plans.registry import QUERIES

    rows = [(i, f"{SITE}/{i}", f"{SITE}/{i + 1}", False, 0 if i == 0 else None) for i in range(24)] + [(24, f"{SITE}/24", f"{SITE}/3", False, None)]
    spark.createDataFrame(rows, "id long, source_url string, target_url string, rel_nofollow boolean, source_depth int").write.parquet(f"{tmp_path}/link_edges.parquet")
    assert {r["url"]: r["depth"] for r in QUERIES["frontier_bfs"](spark, str(tmp_path)).collect()} == {f"{SITE}/{i}": i for i in range(25)}


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = [("https://a.test/i.xml", f"<sitemapindex {ns}><sitemap><loc>/s.xml</loc></sitemap><sitemap><loc>/i.xml</loc></sitemap></sitemapindex>"), ("https://a.test/s.xml", f"<x:urlset xmlns:x='n'><x:url><x:loc> /p?a=1&amp;b=2 </x:loc></x:url><x:url><x:loc>/p?a=1&amp;b=2</x:loc></x:url></x:urlset>"), ("https://a.test/bad.xml", "<urlset><url>")]
    df = spark.createDataFrame(docs, "url string, xml string")
    got = pages.sitemap_tree(df, df.where("url like '%i.xml'").select("url")).collect()
    assert [tuple(r) for r in got] == [("https://a.test/p?a=1&b=2", 1)]
    assert pages.sitemap_entries(df).where("error is not null").count() == 1


def test_selectors_and_extraction():
    assert H.extract(DOC, "css", "body > p") == ["Hi", "there bold c go"] and H.extract(DOC, "css-attribute", "a[rel~=nofollow]", "href") == ["../up/./y?q=1#f"]
    assert H.extract(DOC, "regex", r"<title>(.*?)</title>") == ["A title", "B"] and H.extract(DOC, "css", "h1", all_matches=False) == ["One"]
    with pytest.raises(ValueError):
        H.compile_selector("a ~ b")
    assert H.search(DOC, "HI")[0] > 0 and H.search(DOC, "HI", case_sensitive=True)[0] == 0 and H.search(DOC, "") == (0, [])


# ---------------------------------------------------------------- files and streams


def test_workbook_archive_and_reports(spark, tmp_path):
    df = site(spark, [{"title": "=1+1"}, {"title": "b & <c>"}, {"status_code": 404}])
    files.write_workbook(str(tmp_path / "w.xlsx"), {"Rows": df.select("id", "title", "status_code", "hreflang_links"), "Empty": df.limit(0).select("id")})
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert "b &amp; &lt;c&gt;" in z.read("xl/worksheets/sheet1.xml").decode() and z.testzip() is None
    files.write_archive(str(tmp_path / "a"), {"records": df})
    back = files.read_archive(spark, str(tmp_path / "a"))["records"]
    assert back.exceptAll(df).count() == 0 and back.dtypes == df.dtypes
    files.write_html_report(str(tmp_path / "r.html"), df)
    assert "Broken URLs (1)" in (tmp_path / "r.html").read_text()
    assert files.write_sitemap(str(tmp_path / "s.xml"), df) == 2
    files.write_csv(df.select("id", "title"), str(tmp_path / "c"), guard=True, single=True)
    assert "'=1+1" in next((tmp_path / "c").glob("*.csv")).read_text()


def test_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string")
    new = spark.createDataFrame([(1, 2, None), (3, 2, "c"), (None, 9, "x")], "k int, o int, v string")
    assert sorted(tuple(r) for r in ingest.merged(old, new, "k", "o", ("v",)).collect()) == [(1, 2, "a"), (2, 1, "b"), (3, 2, "c")]
    assert sorted((r["k"], r["v"]) for r in ingest.merged(old, new, "k", "o").collect()) == [(1, None), (2, "b"), (3, "c")]


def test_metric_payloads(spark):
    df = spark.createDataFrame([('{"rows":[{"dimensionValues":[{"value":"a.test"},{"value":"/p"}],"metricValues":[{"value":"3"},{"value":"NaN"},{"value":"x"},{"value":"1.5"}]}]}',), ("broken",)], "payload string")
    assert [tuple(r) for r in metrics.analytics(df).collect()] == [("https://a.test/p", 3.0, 0.0, 0.0, 1.5)]
    vitals = spark.createDataFrame([('{"record":{"metrics":{"cumulative_layout_shift":{"percentiles":{"p75":"0.1"}}}}}',), ("{}",)], "payload string").select(metrics.field_vitals("payload").alias("v"))
    assert [(r["v"]["cls"], r["v"]["has_data"]) for r in vitals.collect()] == [(0.1, True), (None, False)]


def test_config_round_trip():
    c = metrics.CrawlConfig(start_url=SITE, max_urls=5)
    assert metrics.CrawlConfig.from_json(c.to_json()) == c
    with pytest.raises(ValueError):
        metrics.CrawlConfig.from_json('{"nope": 1}')


def test_list_seeds(spark):
    df = spark.createDataFrame([(1, " a "), (2, "b"), (3, "a"), (4, " ")], "p int, u string")
    assert sorted(tuple(r) for r in metrics.list_seeds(df, "u", "p").collect()) == [("list:1:a", "a", 1, 1), ("list:2:b", "b", 2, 1), ("list:3:a", "a", 3, 2)]


def _run_stream(spark, tmp_path, batches, schema, start):
    """Feeds the batches one file each, in order, and returns the folder of the table."""
    base = str(tmp_path)
    like = spark.createDataFrame([], schema)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        start(ingest.read_stream(spark, f"{base}/in", like), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return f"{base}/table"


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    schema = "k long, o long, v string"
    folder = _run_stream(spark, tmp_path, [[(i, 1, "a") for i in range(200)], [(7, 2, "b"), (7, 0, "late"), (None, 3, "x")], [(9, 2, "c")]], schema, lambda s, t, c: ingest.upsert_stream(s, t, c, "k", "o"))
    table = ingest.Buckets(spark, folder, "k")
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(got) == 200 and got[7] == "b" and got[9] == "c" and got[8] == "a"
    held = table.manifest()["buckets"]
    assert sorted(set(held.values())) == [0, 1, 2] and sum(v > 0 for v in held.values()) <= 2
    assert len(table.versions()) == 2  # the current one and the one before
    table.apply(spark.createDataFrame([(8, 9, "again")], schema), 2, lambda old, new: new)  # a batch that is replayed changes nothing
    assert {r["k"]: r["v"] for r in table.read().collect()} == got


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    from datetime import datetime as D

    schema = "ts timestamp, event_type string, value double"
    batches = [[(D(2024, 1, 1, 0, 5), "a", 1.0), (D(2024, 1, 1, 5, 0), "a", 1.0)], [(D(2024, 1, 1, 4, 55), "a", 1.0), (D(2024, 1, 1, 0, 6), "a", 1.0)]]
    folder = _run_stream(spark, tmp_path, batches, schema, lambda s, t, c: ingest.window_stream(s, t, c, late="10 minutes"))
    got = {r["start"].hour: r["events"] for r in ingest.Buckets(spark, folder, "window").read().collect()}
    assert got == {0: 1, 5: 1, 4: 1}  # 04:55 lies within ten minutes of 05:00, 00:06 does not


def test_a_pages_rows_are_replaced_as_a_whole(spark, tmp_path):
    schema = "source string, target string"
    folder = _run_stream(spark, tmp_path, [[("a", "1"), ("a", "2"), ("b", "3")], [("a", "9")]], schema, lambda s, t, c: ingest.replace_stream(s, t, c, "source"))
    assert sorted(map(tuple, ingest.Buckets(spark, folder, "source").read().select("source", "target").collect())) == [("a", "9"), ("b", "3")]


def test_counts_and_summaries_under_repeats_and_upserts(spark, tmp_path):
    schema = "id long, target string"
    folder = _run_stream(spark, tmp_path / "c", [[(1, "x"), (2, "x"), (1, "x"), (3, None)], [(2, "x"), (4, "y")]], schema, lambda s, t, c: ingest.count_stream(s, t, c, "target", "id"))
    assert sorted(map(tuple, ingest.Buckets(spark, folder, "target").read().select("target", "count").collect())) == [("x", 2), ("y", 1)]
    flags = {"all": F.lit(True), "big": F.col("v") > 5}
    folder = _run_stream(spark, tmp_path / "s", [[(1, 1, 9), (2, 1, 1)], [(1, 2, 3), (3, 1, 7)]], "k long, o long, v long", lambda s, t, c: ingest.summary_stream(s, t, c, "k", "o", flags))
    assert ingest.Buckets(spark, folder, "k").counts() == {"all": 3, "big": 1}


def test_xpath():
    from siteloom.functions.xpath import evaluate

    doc = H.parse('<html><body><div id=a class="x y"><p>One</p><p>Two <b>bold</b></p></div><div><p>Three</p><a href="/u">L</a></div><ul><li>1</li><li>2</li></ul></body></html>')[0]
    cases = {
        "//p": ["One", "Two bold", "Three"], "//div[@id='a']/p[2]": ["Two bold"], "//a/@href": ["/u"], "count(//li)": ["2"], "//li[last()]": ["2"], "//p[contains(., 'bold')]/b | //a": ["bold", "L"], "string(//p)": ["One"],
        "//div[not(@id)]/p/text()": ["Three"], "/html/body/ul/li[1]": ["1"], "//b/..": ["Two bold"], "//*[@href]": ["L"], "//none": [], "//p[1]": ["One", "Three"],
    }
    assert {e: evaluate(doc, e) for e in cases} == cases
    for bad in ("", "//[", "//p[~]"):
        with pytest.raises(ValueError):
            evaluate(doc, bad)


def test_directives_of_columns_and_values_agree(spark):
    values = {"noindex": True, "none": True, "max-image-preview: none": False, "googlebot: noindex, nofollow": False, "index;NOINDEX": True, "a: b: noindex": False, "": False, "noindexed": False, "max-snippet: -1 noindex": True}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["n"] for r in df.select("v", pages.robots_directive("v", "noindex").alias("n")).collect()}
    assert got == values == {v: H.has_directive(v, "noindex") for v in values}


def test_structured_data_walks_graphs_and_contexts():
    got = H.structured_data(['{"@context":"https://schema.org","@graph":{"@type":"Product"}}', "[1]", "{", '{"@context":"https://x.test","@graph":[{"@context":["http://schema.org"],"@type":"Offer","price":0}]}'])
    said = [(i["severity"], i["message"], i["path"]) for i in got["structured_data_issues"]]
    assert ("error", "Product is missing required field name", "script[1].@graph.name") in said
    assert ("error", "JSON-LD block 2 does not contain an object entity", "script[2]") in said
    assert said[2][1].startswith("JSON-LD block 3 is not valid JSON") and got["json_ld_invalid_count"] == 1
    assert [p for _, _, p in said[3:]] == ["script[4].@graph[0].priceCurrency", "script[4].@graph[0].availability"]


def test_messages_and_labels_are_the_fixed_ones(spark):
    df = conformed(spark.createDataFrame([(1, "https://x.test/a", 404, "text/html", True, "Oak"), (2, "https://x.test/b", 200, "text/html", True, "Oak")], "id long, final_url string, status_code int, content_type string, in_sitemap boolean, title string"))
    said = {(r["id"], r["rule"]): r["message"] for r in audit.issues(df, scope=[]).collect()}
    assert said[1, "response.client_error"] == "Client error response: 404" and said[2, "title.too_short"] == "Page title is shorter than 30 characters"
    assert said[2, "content.thin"] == "Page has 0 words, below the 200-word thin-content threshold" and said[2, "content.low_text_ratio"] == "Visible text is 0.0% of the HTML, below the 10% minimum"
    labels = {r["id"]: r["issues"].split("; ") for r in links.sitemap_report(df, []).collect()}
    assert {"4xx URL in sitemap", "Orphan URL in sitemap", "Non-indexable URL in sitemap"} <= set(labels[1]) and "4xx URL in sitemap" not in labels[2]


def test_fixed_exports(spark, tmp_path):
    from siteloom.sinks import exports

    df = conformed(spark.createDataFrame([(1, "u", 0.25, [("https://x.test/r", 301, "/a", None, None, None, None, 12)])], "id long, url string, text_to_code_ratio double, redirect_chain " + RECORD["redirect_chain"][0]))
    rows = exports.record_rows(df)
    assert rows.columns == exports.RECORD_COLUMNS and len(rows.columns) == 123
    got = rows.first().asDict()
    assert got["text_to_code_ratio"] == "0.2500" and got["status_code"] == "" and got["classification"] == "Internal" and got["hsts_header"] == "false" and got["custom_searches"] == "[]"
    hop = exports.redirect_rows(df)
    assert hop.columns == exports.REDIRECT_COLUMNS and tuple(hop.first())[3:8] == ("1", "https://x.test/r", "301", "/a", "")
    assert exports.write_exports(str(tmp_path), ["records", "redirects"], {"records": df}) == ["records", "redirects"]
    both = exports.comparison_export(df, df.withColumn("title", F.lit("=1+1")))
    assert both.columns == exports.COMPARISON_COLUMNS and both.first()["Current Title"] == "'=1+1"


def test_hosts_and_decisions(spark):
    urls = ["https://a.shop.co.uk/x", "https://shop.co.uk/y.css", "https://other.co.uk/", "http://10.0.0.1/z", "https://cdn.test/img/a.png", "https://cdn.test/js/a.js", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    kinds = {"html": True, "image": True, "other": False}
    got = {r["u"]: (r["d"], r["c"], r["m"]) for r in df.select("u", U.registrable_domain("u").alias("d"), U.on_cdn("u", ["https://cdn.test/img/"]).alias("c"), U.may_crawl("u", "https://www.shop.co.uk/", kinds, scope="domain", cdn_hosts=["cdn.test/img"]).alias("m")).collect()}
    assert got["https://a.shop.co.uk/x"] == ("shop.co.uk", False, True) and got["https://shop.co.uk/y.css"][2] is False and got["https://other.co.uk/"] == ("other.co.uk", False, False)
    assert got["http://10.0.0.1/z"][0] is None and got["https://cdn.test/img/a.png"][1:] == (True, True) and got["https://cdn.test/js/a.js"][1] is False
