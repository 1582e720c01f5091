"""Page and audit operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from stemma.operators import audit, site


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def test_site_search(spark):
    pages = spark.createDataFrame([("a", "Alpha", "beta", ["x/y"], 1), ("b", "B", "alpha", ["x"], 2), ("c", "C", "c", ["alpha"], 0)], "slug string, title string, content string, tags array<string>, seq int")
    assert [r.slug for r in site.site_search(pages, "alpha").collect()] == ["a", "b", "c"]
    assert [r.slug for r in site.site_search(pages, "#x alpha").collect()] == ["b"]
    assert [r.slug for r in site.site_search(pages, "#x").collect()] == ["a", "b"]
    assert {(r.tag, r.n) for r in site.tag_pages(pages).collect()} == {("x", 2), ("x/y", 1), ("alpha", 1), ("index", 3)}


def test_texts(spark):
    assert one(spark, "Foo bar foo", lambda c: site.highlighted(c, "foo bar")) == "<mark>Foo bar</mark> <mark>foo</mark>"
    assert one(spark, " ".join([*"abc", "hit", *"def", "hit", "hit"]), lambda c: site.best_words(c, "hit", 3)) == "f hit hit"
    assert one(spark, "One. Two is longer. " + "x" * 200 + ".  Four.", lambda c: site.description(c, 30)) == "One. Two is longer."
    assert one(spark, "y" * 200, lambda c: site.description(c, 30)) == "y" * 200 and one(spark, "", site.description) == ""
    assert one(spark, "w " * 201, site.reading_minutes) == 2
    assert [tuple(x) for x in one(spark, "a [[T#H|L]] ![[img]] [[U]]", site.wiki_links)] == [("T", "H", "L"), ("U", "", None)]
    assert one(spark, "left\nhit right", lambda c: site.in_context(c, F.lit(5), F.lit(3), 3)) == "…ft⏎【hit】 ri…"


def test_pages(spark):
    pages = spark.createDataFrame([("k/a", "T", ["k/b", "zz", "k/a"], "see [[no]]", "2024-01-01", None, "true"), ("m/a", "T", ["k/b"], "", "2024-02-01", "TRUE", None), ("k/b", "B", [], "[[k/a]]", None, "false", "no")], "slug string, title string, links array<string>, content string, date string, draft string, publish string")
    assert {(r.dst, r.title) for r in site.backlinks(pages).collect()} == {("k/b", "T (k)"), ("k/b", "T (m)")}
    assert [tuple(r) for r in site.dead_links(pages).collect()] == [("k/a", "no")]
    assert {r.slug for r in site.published(pages).collect()} == {"k/a", "k/b"} and [r.slug for r in site.published(pages, True).collect()] == ["k/a"]
    assert {tuple(r) for r in site.folders(pages).collect()} == {("k", 2, "2024-01-01"), ("m", 1, "2024-02-01")}
    entries = spark.createDataFrame([("p", "10 b", False), ("p", "2 a", False), ("p", "z", False), ("p", "f", True)], "parent string, name string, is_folder boolean")
    assert [r.name for r in site.navigation(entries).orderBy("position").collect()] == ["f", "2 a", "10 b", "z"]
    books = spark.createDataFrame([("d1", "CN", "law"), ("d2", None, "law")], "domain string, country string, field string")
    assert [r.path for r in site.regrouped(books, ["country", "field"]).orderBy("domain").collect()] == ["CN/law/d1", "d2"]
    heads = spark.createDataFrame([("p", 2, 1), ("p", 3, 2), ("p", 4, 3)], "page string, depth int, at int")
    assert [(r.depth) for r in site.contents(heads, "page", "depth", "at").orderBy("at").collect()] == [0, 1]


def test_audits(spark):
    edges = spark.createDataFrame([(True, False, 0, None), (False, False, 3, 0.3), (False, False, 1, 0.7), (False, False, 1, None), (False, False, 4, 0.5)], "hub_src boolean, hub_dst boolean, strength int, cosine double")
    assert [r.advice for r in audit.classified(edges).collect()] == ["drop", "drop", "keep", "review", "keep"]
    v = spark.createDataFrame([("a", "b", "r", "bad", 1), ("b", "a", "r", "good", 2), ("a", "c", "r", "bad", 3), ("c", "a", "r", "bad", 4), ("x", "y", "q", "unsure", 5), ("a", "b", "r", "good", 6)], "center string, neighbour string, relation string, verdict string, seq int")
    assert [tuple(r) for r in audit.blacklist(v).collect()] == [("a", "c")] and [tuple(r) for r in audit.undecided(v).collect()] == [("x", "y")]
    assert {tuple(r) for r in audit.verdicts(v).collect()} == {("r", "good", 2), ("r", "bad", 2), ("q", "unsure", 1)}
    terms = spark.createDataFrame([("ab", 1, 0.0), ("abc", 3, 0.0), ("abcd", 8, 0.9), ("abcde", 50, 0.0), ("abcdef", 1, 1.0)], "name string, pages int, embedded double")
    assert {r.name: r.reasons for r in audit.ambiguous(terms).collect()} == {"ab": ["short"], "abc": ["three"], "abcd": ["embedded"], "abcde": ["common"]}
    texts = spark.createDataFrame([("xaay",), ("aaa",)], "text string")
    assert {tuple(r) for r in audit.neighbours_of_hits(texts, "aa").collect()} == {("left", "x", 1), ("left", "", 1), ("left", "a", 1), ("right", "y", 1), ("right", "a", 1), ("right", "", 1)}
    new = spark.createDataFrame([("n",), ("lone",)], "id string")
    e = spark.createDataFrame([("n", "f", 1.0), ("g", "n", 3.0)], "src string, dst string, weight double")
    at = {r.id: (r.x, r.y) for r in audit.placed(new, e, spark.createDataFrame([("f", 0.0, 0.0), ("g", 100.0, 0.0)], "id string, x double, y double")).collect()}
    assert abs(((at["n"][0] - 75) ** 2 + at["n"][1] ** 2) ** 0.5 - 12) < 0.1 and abs((at["lone"][0] ** 2 + at["lone"][1] ** 2) ** 0.5 - 1000) < 0.1
    r = audit.ranking_changes(spark.createDataFrame([("q", ["a", "b", "c", "d"])], "query string, ids array<string>"), spark.createDataFrame([("q", ["a", "b", "c", "e"])], "query string, ids array<string>")).first()
    assert (r.lost, r.added, r.same_top3) == (["d"], ["e"], True)
    audit.expectations({"two": (new, 2)})
    with pytest.raises(ValueError, match="two: 2 rows, not 3"):
        audit.expectations({"two": (new, 3)})
