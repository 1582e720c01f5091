"""Packs, Markdown trees, site output, annotations and the plugin chain."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stemma.operators.tools import KnowledgeBase
from stemma.sources import pack, sinks, site


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def base(spark):
    make = lambda name, data: spark.createDataFrame(data, pack.SCHEMAS[name])
    return {
        "nodes": make("nodes", [("a", "A", "chapter", "d1", ["R"], "s"), ("b", "B", "section", "d2", [], ""), ("term-1", "T", "term", "terms", None, None)]),
        "bodies": make("bodies", [("a", "own a", ""), ("b", "own b", "full b")]),
        "edges": make("edges", [("a", "b", "xref", 0.6), ("a", "term-1", "termref", 1.0)]),
        "books": make("books", [("d1", "One", "o", None, None, None, "Law One", "L1", None, 3), ("d2", "Two", None, None, None, None, None, None, None, None)]),
        "articles": make("articles", [("Law One", 1, "a"), ("Law Two", 1, "b")]),
        "citations": make("citations", [("a", "Law One", 1, 2), ("b", "Law One", 1, 1)]),
        "terms": make("terms", [("term-1", "T", [], "d")]),
    }


def test_a_pack_is_read_as_it_was_written(spark, base, tmp_path):
    path = f"file://{tmp_path}/pack"
    sinks.write_pack(base, path)
    assert pack.locate(spark, [f"file://{tmp_path}/none", path]) == path
    with pytest.raises(FileNotFoundError, match="none"):
        pack.locate(spark, [f"file://{tmp_path}/none"])
    kb = pack.read_pack(spark, path)
    assert isinstance(kb, KnowledgeBase) and kb.laws == {"o": "Law One", "L1": "Law One", "Law One": "Law One"}
    assert rows(kb.edges) == rows(base["edges"]) and rows(kb.bodies) == [("a", "own a", None), ("b", "own b", "full b")]
    part = pack.read_pack(spark, path, ["d1"])
    assert rows(part.edges) == [("a", "term-1", "termref", 1.0)] and rows(part.articles.select("node_id")) == [("a",)]
    assert pack.known_domains("d2, x", kb.books) == (["d2"], ["x"]) and pack.known_domains("", kb.books) == (["d1", "d2"], [])
    assert pack.known_domains("x", kb.books) == (["d1", "d2"], ["x"])
    terms, others = pack.split_details(kb.nodes)
    assert (terms.count(), others.count()) == (1, 2)


def test_json_tables(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"id": "a", "own": "x\\ny"},\n {"id": "b"}]')
    assert rows(pack.read_table(spark, f"file://{tmp_path}/t.json", "id string, own string").na.fill("-")) == [("a", "x\ny"), ("b", "-")]


def test_chunks_and_domains(spark):
    files = spark.createDataFrame([("d/one.md", "1"), ("d/_index.md", "i"), ("e/_index.md", "i"), ("d/sub/b.md", "2b"), ("d/sub/a.md", "2a"), ("f/x.md", "x"), ("g/_index.md", ""), ("g/g.md", "")], "path string, text string")
    chunks = spark.createDataFrame([("d/one",), ("d/sub",), ("none",), ("d/sub",)], "chunk string")
    assert rows(pack.chunk_texts(chunks, files).na.fill("-")) == [("d/one", "1"), ("d/sub", "2a\n\n2b"), ("none", "-")]
    assert rows(pack.discover(files, ["z", "g"])) == [("d", 2), ("g", 1)] and rows(pack.discover(files, [])) == [("d", 1), ("g", 2)]


def test_titles_by_chapter(spark):
    text = "## 其他\n### 第1章\n**第一条**（甲）\n## 目录\n### 第2章 a\n**第一条**（乙）\n**第二条**（丙）\n### 第3章\n**第一条**（丁）\n"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(pack.grouped_titles(F.col("t"), "目录")).alias("x")).select("x.*")
    assert rows(got) == [("2:第一条", "乙"), ("2:第二条", "丙"), ("3:第一条", "丁")]


def test_pages_and_feed(spark, tmp_path):
    pages = spark.createDataFrame([("b/p", 'T "x"', ["t"], None, "text", [("法", 2, 1), ("法", 1, 5)], dt.datetime(2024, 1, 2), "d"), ("c", "U*", None, None, "", [], None, None)], "slug string, title string, tags array<string>, aliases array<string>, text string, citations array<struct<law:string,article:int,n:int>>, date timestamp, description string")
    got = dict(rows(site.rendered(pages)))
    assert got["b/p.md"] == '---\ntitle: "T \\"x\\""\ntags: ["t"]\naliases: []\n---\n\n# T "x"\n\ntext\n\n## 引用\n- 法第1条 ×5\n- 法第2条 ×1' and got["c.md"].endswith("# U\\*")
    for _ in range(2):
        site.write_site(pages, f"file://{tmp_path}/site")
    assert spark.read.json(f"file://{tmp_path}/site").count() == 2
    document = site.feed_document(pages, "https://x", "S", 5).first()[0]
    assert document.index("b/p") < document.index("/c<") and document.count("<item>") == 2


def test_annotations(spark):
    schema = "id string, slug string, kind string, colour string, start int, end int, exact string, note string, updated int"
    old = spark.createDataFrame([("a", "b/p", "note", "blue", 5, 9, "text", "n", 3), ("b", "b/p", "note", "blue", 1, 2, "x", None, 3)], schema)
    new = spark.createDataFrame([("a", "b/p", "note", "blue", 5, 9, "text", "old", 2), ("b", "b/p", "note", "pink", 1, 2, "x", "", 4), ("c", "b/p", "highlight", "green", 12, 13, "y", None, 1), ("d e", "b/p", "note", "blue", 1, 2, "x", None, 9), ("f", "b/p", "note", "blue", 2, 2, "x", None, 9), (None, "b/p", "note", "blue", 1, 2, "x", None, 9)], schema)
    kept, counts = site.merged_annotations(old, new)
    assert [(r.id, r.colour, r.updated) for r in kept.orderBy("id").collect()] == [("a", "blue", 3), ("b", "pink", 4), ("c", "green", 1)]
    assert counts == {"invalid": 3, "added": 1, "updated": 1, "dropped": 0}
    assert site.merged_annotations(old, new, 2)[1]["dropped"] == 1
    assert '"format":"annotations"' in site.annotation_export(kept, "2024").first()[0]
    headings = spark.createDataFrame([("b/p", 4, "One"), ("b/p", 10, "Two/3")], "slug string, at int, title string")
    assert rows(site.annotation_pages(kept, headings)) == [("b/One.md", "# One\n\n> text\n\nn"), ("b/Two-3.md", "# Two/3\n\n> y")]


def test_chunks_images_and_links(spark):
    nodes = spark.createDataFrame([("a", None, "x"), ("a-1", "a", "y"), ("a-2", "a", None)], "id string, parent string, own string")
    assert rows(site.resliced(nodes)) == [("a/1.md", "y"), ("a/2.md", "")]
    with pytest.raises(ValueError, match="unknown"):
        site.resliced(spark.createDataFrame([("a", "z", "x")], "id string, parent string, own string"))
    pages = spark.createDataFrame([("![a](i/1.png) ![](i/2.png)",)], "content string")
    assert rows(site.image_manifest(pages, spark.createDataFrame([("i/1.png",), ("i/3.png",)], "image string"))) == [("i/1.png", "copied"), ("i/2.png", "missing"), ("i/3.png", "orphan")]
    one = spark.createDataFrame([("依照专利法第2条和专利法第2条",)], "t string").select(site.linked_laws(F.col("t"), F.lit("专利法第2条"), F.lit("k"))).first()[0]
    assert one == "依照[[k|专利法第2条]]和专利法第2条"


def test_build_chain(spark):
    pages = spark.createDataFrame([("a", "x", "false"), ("b", "y", "true"), ("c", "z", None)], "slug string, text string, draft string")
    seen = []
    build = site.Build([lambda p: p.withColumn("text", F.upper("text"))], [lambda: F.col("draft").isNull() | (F.col("draft") != "true"), lambda: F.col("slug") != "q"], [lambda p: seen.append(("all", rows(p.select("slug", "text")))), lambda p: seen.append(("other", p.count()))], {0: lambda p, c: seen.append(("part", rows(p.select("slug")), c.count()))})
    build.run(pages)
    assert seen == [("all", [("a", "X"), ("c", "Z")]), ("other", 2)]
    seen.clear()
    build.rerun(pages, spark.createDataFrame([("c", "change"), ("b", "add"), ("gone", "delete")], "slug string, change string"))
    assert seen == [("part", [("c",)], 3), ("other", 2)]
    assert rows(site.pending(spark.createDataFrame([("x",), ("y",)], "chunk string"), spark.createDataFrame([("y",)], "chunk string"))) == [("x",)]
