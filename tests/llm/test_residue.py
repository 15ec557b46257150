"""Main bodies and residue: held-out accuracy, and the defined results of nulls, empties, repeats and cut markup."""

import pytest
from siteloom.llm import blocks, mainbody, residue

SF = "/root/testdata/sf0.01"
FURNITURE = ["Home", "About us", "Contact", "Accept all", "We use cookies to improve your visit.", "Sitemap", "Terms of use | Privacy"]
PARAGRAPH = "The route between the old bridge and the market is 44 kilometres long and mostly cheerful, as the council told us last year."


def page(body, furniture=True):
    tags = [("h1", body[0]), *[("p", b) for b in body[1:]]]
    html = "<html><head><title>T</title></head><body><nav>" + "".join(f"<a>{f}</a>" for f in FURNITURE[:3]) + "</nav><main>" + "".join(f"<{t}>{x}</{t}>" for t, x in tags) + "</main><footer>" + "".join(f"<span>{f}</span>" for f in FURNITURE[5:]) + "</footer></body></html>"
    return html, "\n".join(FURNITURE[:3] + [""] + body + FURNITURE[5:])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/page_captures.parquet"), spark.read.parquet(f"{SF}/crawl_records.parquet")


@pytest.fixture(scope="module")
def rows(tables):
    got = tables[0].select(*mainbody.COLUMNS).dropDuplicates(["capture_id"]).where("visible_text is not null").orderBy("capture_id").collect()
    return [(r["source_url"], r["raw_html"], r["rendered_html"], r["visible_text"]) for r in got]


def test_body_lines_on_held_out_pages(rows):
    model = mainbody.fit_rows(rows[::2])
    for with_markup, least in ((True, 0.995), (False, 0.97)):
        right = total = 0
        tested = [(p, y, r[0]) for r in rows[1::2] if (y := mainbody.labels(p := blocks.Page(r[3], r[1], r[2])))]
        found = model.decode([mainbody.features(p, url, with_markup) for p, _, url in tested])
        for (_, y, _), d in zip(tested, found):
            right += sum((a < mainbody.BODY) == (b < mainbody.BODY) for a, b in zip(y, d))
            total += len(y)
        assert total > 3000 and right / total > least


def test_viterbi_finds_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    k = len(mainbody.LABELS)
    model = mainbody.Crf(r.normal(size=(1 << mainbody.BITS, k)).astype("f4"), r.normal(size=(k, k)).astype("f4"), r.normal(size=k).astype("f4"))
    pages = [(np.array(i), np.array(v), n) for i, v, n in (([1, 2, 3, 4], [1.0] * 4, [1, 2, 1]), ([9], [0.5], [1]), ([], [], []))]
    score, _ = model.emissions(pages[:2])
    best = max(itertools.product(range(k), repeat=3), key=lambda y: model.first[y[0]] + sum(score[0, t, y[t]] for t in range(3)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
    assert tuple(model.decode(pages)[0]) == best and [len(x) for x in model.decode(pages)] == [3, 1, 0]


def test_weak_labels_hold_on_unseen_hosts(tables):
    got = residue.held_out(*tables)
    assert got["lines"] > 50 and got["recall"] > 0.8


def test_weak_labels_hold_on_unseen_wordings(tables):
    got = residue.held_out_phrases(*tables)
    assert got["wordings"] > 50 and got["recall"] > 0.7 and got["taken for residue"] < 0.02, got


def test_models_are_fitted_once(spark, tables):
    first = residue.fitted(*tables)
    assert residue.fitted(*tables) is first
    residue._fitted.clear()
    again = residue.fitted(*tables)  # from the shared folder
    assert again is not first and (again.field.weights == first.field.weights).all()


CASES = {
    1: (["Oak kettle", PARAGRAPH, PARAGRAPH.replace("44", "7")], None), 2: (["Oak kettle", "{{ item.price }}", "undefined"], "case"), 3: (["Oak kettle", PARAGRAPH, "Please enable JavaScript to view this page."], None),
    4: (["Oak kettle", "Lorem ipsum dolor sit amet."], "case"), 5: (["Oak kettle", "Veuillez activer JavaScript pour afficher ce contenu."], "case"), 6: (["Oak kettle", "Something broke on our side. Please come back in a few minutes."], "case"),
}


def test_captures(spark, tables):
    made = [(i, f"https://x.test/{i}", *page(body), None) for i, (body, _) in CASES.items()]
    made += [made[1], (7, "https://x.test/7", None, None, None), (8, "https://x.test/8", "<p>", "", None), (9, None, "<main><p>cut", " \n ", None), (None, "https://x.test/0", *page(CASES[2][0]), None)]
    df = spark.createDataFrame([(i, u, h, r, v, "extra") for i, u, h, v, r in made], "capture_id long, source_url string, raw_html string, rendered_html string, visible_text string, line_no string")
    captures, records = tables
    models, field = residue.train(captures, records), mainbody.train(captures)
    got = [r["capture_id"] for r in residue.residue_captures(df, field, models).collect()]
    assert sorted(got) == [i for i, (_, y) in CASES.items() if y]
    assert residue.residue_captures(df.limit(0), field, models).count() == 0


def test_statuses(spark, tables):
    models = residue.train(*tables)
    texts = {1: None, 2: "", 3: " ", 4: "OK", 5: "404", 6: "Internal Server Error", 7: "Connection reset", 8: "{{reason}}", 9: "undefined", 10: "Please enable JavaScript to continue", 11: "lorem ipsum dolor", 12: "Sorry, something went wrong on our side"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(8, "{{reason}}"), (None, "undefined")], "id long, status_text string")
    assert sorted(r["id"] for r in residue.residue_statuses(df, models).collect()) == [8, 9, 10, 11, 12]


def test_main_bodies(spark, tables):
    found = residue.main_bodies(*tables)
    assert found.columns == ["capture_id", "line_no"] and found.count() == found.distinct().count() > 1000


def test_without_labelled_pages(spark):
    """The made pages and examples give models whatever the sample holds."""
    text = "Home\nContact\n\nThe stone tower\nThe tower was built of stone and has stood by the river for more than three hundred years.\nVisitors climb the stairs on Sundays, and a keeper tells them its story for an hour.\n\nPrivacy\nBack to top"
    df = spark.createDataFrame([(1, "https://x.test/", None, None, text)], "capture_id long, source_url string, raw_html string, rendered_html string, visible_text string")
    records = spark.createDataFrame([], "id long, status_text string, status_code int")
    got = {r["line_no"] for r in residue.main_bodies(df, records).collect()}
    assert {5, 6} <= got and not got & {1, 2, 8, 9}
    assert residue.residue(df, records).count() == 0
    assert residue.main_bodies(df.limit(0), records).count() == 0 and residue.residue(df.limit(0), records).count() == 0


@pytest.mark.parametrize("markup", [None, "", "<", "<p", "<main><p>a<b>c", "<script>x", "<!-- x", "<p>&amp;lt;</p></p></main>"])
def test_any_markup_has_leaves(markup):
    found, _ = blocks.leaves(markup)
    assert all(b.text for b in found)


def test_wrapped_lines_find_their_leaf():
    found, _ = blocks.leaves(f"<main><h1>Head</h1><p>{PARAGRAPH}</p></main>")
    half = PARAGRAPH.index("44")
    assert blocks.matched(["Head", PARAGRAPH[: half - 1], PARAGRAPH[half:], "other"], found) == [0, 1, 1, -1]
