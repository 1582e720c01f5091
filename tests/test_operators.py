"""Operators that the driver tables don't reach: lexicon, overlays, upserts, sources, sinks, streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from stemma.operators import catalog, graph, lexicon, retrieve, tables, tree
from stemma.sources import files, sinks
from stemma.streaming import changes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lexicon(spark):
    schema = "seq int, chunk string, domain string, name string, aliases array<string>, role string, confidence string, evidence string"
    records = spark.createDataFrame([
        (1, "a/1", "a", "Foo Bar", ["fb", "Baz"], "defined", "high", "a foo bar is"),
        (2, "b/1", "b", "foo-bar", [], "used", "high", "not there"),
        (3, "b/1", "b", "Baz", [], "defined", "mid", "a baz is"),
        (4, "a/1", "a", "Once", ["foobar"], "used", "low", "once"),
    ], schema)
    chunks = spark.createDataFrame([("a/1", "here a foo bar is once"), ("b/1", "a baz is")], "chunk string, text string")
    assert rows(lexicon.claims(records)) == [("baz", "Baz"), ("fb", "Foo Bar"), ("foobar", "Foo Bar"), ("once", "Once")]
    merged = {r.term: r for r in lexicon.merged(records, chunks).collect()}
    assert (merged["Foo Bar"].df, merged["Foo Bar"].domains, merged["Foo Bar"].defined_high, merged["Foo Bar"].definition) == (2, 2, True, "a foo bar is")
    tiers = {r.term: r.tier for r in lexicon.admitted(lexicon.merged(records, chunks), spark.createDataFrame([("Baz",)], "term string"), []).collect()}
    assert tiers == {"Foo Bar": "high", "Baz": "seed", "Once": None}
    notes = spark.createDataFrame([(1, "x", "keep"), (2, "x", "merge-into: y"), (3, "z", "drop"), (4, "z", "merge-into:x"), (5, "w", "merge-into:w"), (6, "v", "merge-into: ")], "seq int, term string, note string")
    assert rows(lexicon.decisions(notes)) == [("x", "merge", "y"), ("z", "drop", None)]


def test_overlay_and_order(spark):
    own = spark.createDataFrame([("p", k) for k in "abcd"], "parent string, key string")
    order = spark.createDataFrame([("p", ["c", "zz", "a", "c"])], "parent string, keys array<string>")
    assert [r.key for r in tree.overlay(own, order, "parent", "key", [F.col("key")]).orderBy("position").collect()] == ["c", "a", "b", "d"]


def test_upsert_and_coalesce(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 5, "same time"), (2, 6, "newer"), (3, 1, "added"), (4, 1, "")], "id int, at int, v string")
    assert rows(tables.upsert(old, new, ["id"], "at", F.col("v") != "")) == [(1, 5, "old"), (2, 6, "newer"), (3, 1, "added")]
    feed = spark.createDataFrame([("a", 1, "add"), ("a", 2, "delete"), ("b", 1, "change"), ("b", 2, "delete"), ("c", 1, "add")], "path string, seq int, change string")
    assert rows(changes.coalesced(feed, "path", ["seq"])) == [("b", 2, "delete"), ("c", 1, "add")]


def test_chains_leave_cycles_out(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    assert rows(graph.chains(merges)) == [("a", "d"), ("b", "d"), ("c", "d")]


def test_closure_budget_batch(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "q")], "src string, dst string")
    assert rows(graph.closed(edges, spark.createDataFrame([("a",), ("b",)], "id string")).select("src", "dst")) == [("a", "b")]
    costs = spark.createDataFrame([(1, 50), (2, 50), (3, 1)], "id int, cost int").withColumn("g", F.lit(0))
    assert [r.id for r in catalog.budget(costs, "cost", [F.col("id")], 60, ["g"]).collect()] == [1]
    assert [r.id for r in catalog.budget(costs, "cost", [F.col("id")], 10, ["g"]).collect()] == [1]
    assert catalog.budget(costs, "cost", [F.col("id")], 10, ["g"], base=5).count() == 0
    assert catalog.budget_cap() == 11000 and catalog.budget_cap(1) == 900


def test_ranking_prefers_titles_and_damps_contents(spark):
    corpus = spark.createDataFrame([(1, "alpha beta", "x", "d"), (2, "y", "about alpha beta here", "d"), (3, "z", "alpha beta\n" + "\n".join(f"chapter {i} ........ {i}" for i in range(25)), "d"), (4, "q", "none", "d")], "id int, title string, body string, domain string")
    got = [(r.id, r.via) for r in retrieve.top(retrieve.scored(corpus, "alpha beta"), 8).collect()]
    assert got[:3] == [(1, "title"), (2, "body"), (3, "body")]
    assert retrieve.scored(corpus, "x").count() == 4  # a query without bigrams has no floor


def test_sources(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    (d / "book__01.json").write_text(json.dumps({"terms": [{"name": "t", "role": "other", "confidence": "sure", "evidence": "e"}], "laws": ["l"]}))
    (d / "a.json").write_text(json.dumps({"chunk": "c/9", "terms": []}))
    (d / "bad.json").write_text("{not json")
    good, bad = files.read_extractions(spark, str(d))
    assert rows(good.select("chunk", F.size("terms"))) == [("book/01", 1), ("c/9", 0)] and rows(bad) == [("bad",)]
    assert rows(files.occurrences(good).select("chunk", "domain", "name", "role", "confidence")) == [("book/01", "book", "t", "used", "low")]
    (d / "n").mkdir()
    (d / "n" / "b.md").write_text('---\ntitle: "A: b"\nlaw_name: L\nbad line\n---\n# H\n')
    (d / "_preamble.md").write_text("no")
    md = files.read_markdown(spark, str(d))
    m = md.select(files.front_matter(F.col("text")).alias("m")).collect()
    assert len(m) == 1 and m[0].m["title"] == "A: b" and m[0].m["lawName"] == "L" and m[0].m["status"] == "" and set(m[0].m) == set(files.KEYS)
    t = spark.createDataFrame([("**第一条**（目的）\n**第2条**（范围）\n| a | b |\n|---|---|\n| 1 | 2 |",)], "t string")
    assert [tuple(x) for x in t.select(files.article_titles(F.col("t"))).first()[0]] == [("一", "目的"), ("2", "范围")]
    assert t.select(files.table_rows(F.col("t"))).first()[0] == [["a", "b"], ["1", "2"]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c', []), (2, "", ["x"])], "id int, s string, l array<string>")
    sinks.write_pack({"t": df}, str(tmp_path / "pack"))
    lines = [json.loads(x) for p in (tmp_path / "pack/t").glob("*.gz") for x in gzip.open(p, "rt", encoding="utf-8")]
    assert sorted(lines, key=str) == [{"id": 1, "s": 'a"b,c'}, {"id": 2, "l": ["x"]}]
    sinks.write_sheet(df.select("id", "s").coalesce(1), str(tmp_path / "sheet"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "sheet").glob("part*"))
    assert text == '﻿id,s\n1,"a""b,c"\n2,\n'
    assert rows(files.read_sheet(spark, str(tmp_path / "sheet")))[0] == ("1", 'a"b,c')
    pages = spark.createDataFrame([("a", "A", ["b", "zz"], [], "x", ["Old?", "a"]), ("b", "B", [], [], "y", [])], "slug string, title string, links array<string>, tags array<string>, content string, aliases array<string>")
    full, projected, dangling = sinks.content_index(pages)
    assert full.count() == 2 and rows(projected.select("slug", "links")) == [("a", ["b"]), ("b", [])] and rows(dangling) == [("a", "zz")]
    assert rows(sinks.redirects(pages)) == [("Old", "a")]
    sinks.write_tables({"pages": pages}, str(tmp_path / "tables"))
    sinks.write_entities(pages.select("slug", "title"), "slug", str(tmp_path / "entities"))
    assert spark.read.parquet(str(tmp_path / "tables/pages")).count() == 2 and (tmp_path / "entities/_entity=a").exists()


def test_similar_pairs_are_all_pairs(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.6}
    for block in (1000, 13):
        assert {(r.a, r.b) for r in tables.similar_pairs(df, "id", "v", 0.6, block).collect()} == want


def test_anchor_prefers_its_context(spark):
    df = spark.createDataFrame([("aa X bb X cc", "X", "bb ", " cc", 3), ("none", "X", "", "", 0)], "t string, e string, p string, s string, at int")
    got = [r[0] for r in df.select(changes.anchored(F.col("t"), F.col("e"), F.col("p"), F.col("s"), F.col("at"))).collect()]
    assert got[1] is None and got[0] == 8


def test_anchor_equals_a_search_of_all_places(spark):
    import random

    def best(text, exact, prefix, suffix, start, context):
        at = [i for i in range(len(text)) if exact and text.startswith(exact, i)]
        points = lambda i: 4 * text[:i].endswith(prefix[-context:]) + 4 * text.startswith(suffix[:context], i + len(exact)) - abs(i - start) / 1000
        return max(at, key=lambda i: (points(i), -i), default=None)

    r = random.Random(3)
    some = lambda most: "".join(r.choices("ab😀.", (5, 3, 1, 1), k=r.randint(0, most)))
    given = [(some(30) * r.choice([1, 1, 300]), some(2), some(10), some(10), r.randint(-3, 40) * r.choice([1, 1, 200])) for _ in range(600)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "id int, t string, e string, p string, s string, at int")
    for context in (2, 8):
        got = df.select("id", changes.anchored(F.col("t"), F.col("e"), F.col("p"), F.col("s"), F.col("at"), context).alias("found")).collect()
        assert {x.id: x.found for x in got} == {i: best(*g, context) for i, g in enumerate(given)}


@pytest.mark.parametrize("case", ["empty"])
def test_operators_on_empty_tables(spark, case):
    e = spark.createDataFrame([], "src string, dst string, type string, weight double, seq int")
    assert graph.dedupe(e).count() == graph.degree(e).count() == graph.chains(e).count() == 0
    t = spark.createDataFrame([], "k string, v string, n int")
    assert tables.majority(t, "k", "v").count() == tables.gaps(t, "k", "n").count() == tables.quantiles(t, "k", "n", [0.5]).count() == 0


def test_quotas_stars_and_taxonomies(spark):
    direct = spark.createDataFrame([("t", "b"), ("t", "a")], "src string, dst string")
    indirect = spark.createDataFrame([("t", "a", 9), ("t", "d", 3), ("t", "c", 3), ("t", "e", 1), ("u", "z", 2)], "src string, dst string, n int")
    assert rows(graph.mixed_quota(direct, indirect, 3)) == [("t", "a", 0.7), ("t", "b", 0.7), ("t", "c", 0.4), ("u", "z", 0.4)]
    members = spark.createDataFrame([("1", "x", "x"), ("2", "y", "x"), ("3", "z", "w")], "id string, label string, topic string")
    assert rows(graph.star(members)) == [("2", "1", "termrel", 0.8)]
    books = spark.createDataFrame([("CN", "p", "law", "B"), ("CN", "p", "law", "A"), ("CN", "p", None, "C"), ("US", "t", "act", "D")], "country string, field string, kind string, title string")
    got = {r.country: r.below for r in catalog.taxonomy(books, ("country", "field", "kind"), "title").collect()}
    assert got["CN"][0].below[0].leaves == ["A", "B"] and got["US"][0].field == "t"
    assert [r.sheet for r in catalog.sheets(books, [F.col("title")], 2, ["country"]).orderBy("country", "title").collect()] == [1, 1, 2, 1]


def test_cells(spark):
    df = spark.createDataFrame([("甲、乙（丙）/丁 1/2",), ("“a、b”／c（专利法）（第3条）(别名)",)], "t string")
    got = df.select(lexicon.variants(F.col("t")), lexicon.bracketed(F.col("t"))).collect()
    assert got[0][0] == ["甲", "乙", "丁 1/2"] and got[0][1] == ["丙"]
    assert got[1][0] == ["“a、b”", "c"] and got[1][1] == ["别名"]
