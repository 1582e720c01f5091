"""The query interface on a hand-made base of two books."""

import pytest
from pyspark.sql import functions as F

from stemma.functions import law as L
from stemma.operators.tools import KnowledgeBase, clamp, fused


@pytest.fixture(scope="module")
def kb(spark):
    d = spark.createDataFrame
    nodes = d([
        ("pl", "专利法", "law", "pl", [], "law", ), ("pl-01", "第1条 · 目的", "article", "pl", ["专利法"], "aim"), ("pl-02", "第2条 · 发明", "article", "pl", ["专利法"], "invention"), ("pl-10", "第10条 · 转让", "article", "pl", ["专利法"], "transfer"),
        ("gl", "指南", "guide", "gl", [], "guide"), ("gl-1", "创造性", "section", "gl", ["指南"], "inventive step"), ("term-1", "创造性", "term", None, [], "step"),
    ], "id string, label string, level string, domain string, breadcrumb array<string>, summary string")
    bodies = d([("pl-01", "为了保护专利权人的合法权益", None), ("pl-02", "发明是指新的技术方案", "发明是指新的技术方案 全文"), ("pl-10", "专利申请权可以转让", None), ("gl-1", "发明的创造性依照专利法第2条判断", None)], "id string, own string, full string")
    edges = d([("pl", "pl-10", "hierarchy", 1.0), ("pl", "pl-01", "hierarchy", 1.0), ("pl", "pl-02", "hierarchy", 1.0), ("gl", "gl-1", "hierarchy", 1.0), ("gl-1", "pl-02", "lawref", 0.5), ("term-1", "gl-1", "termref", 1.0)], "src string, dst string, type string, weight double")
    books = d([("pl", "专利法", "专", "CN", "patent", "law", "专利法", "现行有效", 100), ("gl", "审查指南", "指", "CN", "patent", "guide", None, "已废止", 50)], "domain string, title string, short string, country string, field string, doc_type string, law_name string, status string, chars long")
    articles = d([("专利法", 1, "pl-01"), ("专利法", 2, "pl-02"), ("专利法", 10, "pl-10")], "law string, number int, node_id string")
    citations = d([("gl-1", "专利法", 2, 3)], "node_id string, law string, article int, n int")
    terms = d([("term-1", "创造性", ["inventive step"], "突出的实质性特点")], "id string, label string, aliases array<string>, definition string")
    return KnowledgeBase(nodes, bodies, edges, books, articles, citations, terms, {"专利法": "专利法"})


def test_search(kb):
    got = kb.search("专利法第2条").collect()
    assert got[0].id == "pl-02" and "law" in got[0].via and got[1].id == "gl-1"
    assert [r.id for r in kb.search("创造性", terms=True).collect()][:2] in (["term-1", "gl-1"], ["gl-1", "term-1"])
    assert "term-1" not in {r.id for r in kb.search("创造性", terms=False).collect()}
    assert {r.id for r in kb.search("创造性", ["gl"], limit=1).collect()} <= {"gl-1", "term-1"}


def test_reading_and_browsing(kb):
    r = kb.read_node("pl").first()
    assert r.children == ["pl-01", "pl-02", "pl-10"] and r.text == "" and not r.has_more
    assert kb.read_node("pl-02", "full").first().text.endswith("全文")
    r = kb.read_node("gl-1").first()
    assert [(c.law, c.article) for c in r.citations] == [("专利法", 2)] and r.path == "指南 › 创造性"
    assert [x.id for x in kb.browse(None).collect()] == ["gl", "gl-1", "pl", "pl-01", "pl-02", "pl-10"]
    assert [x.id for x in kb.browse("pl", 1, budget=8).collect()] == ["pl"]
    assert [x.id for x in kb.briefs(root="pl").collect()] == ["pl", "pl-01", "pl-02", "pl-10"]
    assert [(x.id, x.found) for x in kb.batch_read(["gl-1", "zz", "pl-01"]).orderBy("nth").collect()] == [("gl-1", True), ("zz", False), ("pl-01", True)]


def test_terms_and_laws(kb):
    assert kb.lookup_term("Inventive-Step").first().id == "term-1" and kb.lookup_term("none").count() == 0
    assert [r.name for r in kb.suggest_terms("step").collect()] == ["inventive step"]
    r = kb.find_law("专利法第二条").first()
    assert r.node_id == "pl-02" and [(c.n, c.id) for c in r.cited_by] == [(3, "gl-1")]
    assert [r.node_id for r in kb.find_law("第10条").collect()] == ["pl-10"]
    assert [(r.number, r.title) for r in kb.list_articles("专利法", 2).orderBy("number").collect()] == [(2, "发明"), (10, "转让")]
    got = kb.compare_articles(["专利法第10条", "刑法第1条", "专利法第99条"]).orderBy("nth").collect()
    assert [r.not_found for r in got] == [None, "unknown law", "no such article"]
    r = kb.citing_sections("专利法").first()
    assert (r.article, r.sections, r.books, r.total) == (2, 1, 1, 3)


def test_catalogue_and_neighbours(kb):
    assert [r.domain for r in kb.filter_books(has_law=True).collect()] == ["pl"] and kb.filter_books(text="指南").count() == 1
    assert {(r.facet, r.value, r.n) for r in kb.facets(kb.books).collect()} >= {("country", "CN", 2), ("doc_type", "law", 1)}
    assert kb.list_books(1, 5).first().total == 2 and kb.catalogue().where("depth = 0").first().chars == 150
    assert [(r.type, r.total) for r in kb.related("gl-1").collect()] == [("hierarchy", 1), ("lawref", 1), ("termref", 1)]
    assert {(r.domain, r.code, r.warning) for r in kb.effectivity().collect()} == {("pl", "in_force", None), ("gl", "repealed", "no longer in force")}
    assert fused(kb.books, ["title"], 100)[0] and not fused(kb.books, ["title"], 1)[0]
    assert clamp(float("nan"), 1, 5, 3) == 3 and clamp(99, 1, 5, 3) == 5 and clamp(None, 1, 5, 3) == 3


def test_named_articles_in_tools(kb):
    assert kb.asked("专利法第2条").domain == "pl" and kb.asked("专利法第99条").missing and kb.asked("刑法第1条") is None and kb.asked("第2条") is None
    got = {r.id: r.score for r in kb.search("专利法第2条", limit=30).collect()}
    assert got["pl-02"] >= 2400 and all(v < 300 for k, v in got.items() if k not in ("pl-02", "gl-1"))
    assert [kb.law_answer(q)[0] for q in ("专利法第2条", "专利法第99条", "刑法第1条", "第10条", "创造性")] == ["article", "no such article", "unknown law", "candidates", "nothing"]
    assert [r.node_id for r in kb.law_answer("第10条")[1].collect()] == ["pl-10"]


def test_more_forms_of_answers(kb):
    assert [(r.id, r.cites) for r in kb.occurrences("term-1").collect()] == [("gl-1", ["专利法第2条"])]
    assert {(r.domain, r.level, r.n) for r in kb.browse_summary().collect()} >= {("gl", "section", 1), ("pl", "article", 3)}
    assert [r.domain for r in kb.opened(["pl"]).closed_books(kb.books).collect()] == ["gl"]
    assert [(r.id, r.n) for r in kb.citing("专利法", 2).collect()] == [("gl-1", 3)] and kb.citing("专利法", 2, ["pl"]).count() == 0
    assert kb.resource("kb://node/pl-02").first().text.endswith("全文")
    with pytest.raises(ValueError, match="kb://x"):
        kb.resource("kb://x")
    assert [(r.container, r.entry) for r in kb.entry(["pl"]).collect()] == [("pl", "pl-01")]
    assert "country" not in kb.list_books(detail="brief").columns


def test_closed_domains_leave_nothing_behind(kb):
    own = kb.opened(["pl"])
    assert {r.id for r in own.nodes.collect()} == {"pl", "pl-01", "pl-02", "pl-10", "term-1"} and own.citations.count() == 0
    assert {(r.src, r.dst) for r in own.edges.collect()} == {("pl", "pl-01"), ("pl", "pl-02"), ("pl", "pl-10")}


def test_article_queries():
    laws, n = {"专利法": "专利法", "专利法实施细则": "细则"}, {"专利法": 82}
    assert L.parse_article_query("专利法实施细则第三条", laws, n).law == "细则"
    assert L.parse_article_query("《专利法》第99条", laws, n) == L.ArticleQuery("专利法", 99, True, True)
    assert L.parse_article_query("刑法第3条", laws, n, "专利法") is None and L.parse_article_query("no article", laws, n) is None
    assert L.parse_article_query("第3条", laws, n, "专利法") == L.ArticleQuery("专利法", 3, False, False)


def test_normalisers(spark):
    row = spark.createDataFrame([("办法", "2001年6月19日", "", "有效（" + "注" * 40 + "）", "v1.10.0", "1.9-beta")], "t string, e string, i string, s string, v string, w string")
    clean, note = L.status_note(F.col("s"))
    got = row.select(L.title_suffix(F.col("t"), F.col("e"), F.col("i")), clean, F.length(note), L.version_key(F.col("v")) > L.version_key(F.col("w")), L.efficacy({"a": F.col("i"), "b": F.col("t")})).first()
    assert got[0] == "（2001年施行）" and got[1] == "有效" and got[2] == 40 and got[3] and [tuple(x) for x in got[4]] == [("b", "办法")]
