"""Text functions and parsers on the expected values of the blueprint and on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from stemma.functions import cite, outline, python, text as T
from stemma.plans.knowledge import CITED, LAWS


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, value", [("一百四十九", 149), ("十一", 11), ("零", None), ("二〇", None), ("二十", 20), ("两", None), ("305", 305), ("0", None), ("三千零五", 3005)])
def test_numerals(spark, text, value):
    assert one(spark, text, T.cn_number) == value == cite.number(text)


def test_tokens_bigrams_and_cost(spark):
    assert one(spark, "hello world", T.tokens) == ["hello", "world"]
    assert one(spark, "A-b 专利 foo_bar, x!", T.tokens) == ["a-b", "专", "利", "foo_bar", "x"]
    assert T.bigrams("Aba ab") == ["ab", "ba", "aa"] and T.bigrams("x") == []
    assert one(spark, "专利 ab", T.estimate_tokens) == 3 and one(spark, "abcdef", T.estimate_tokens) == 2
    assert one(spark, "abc", lambda c: T.coverage(c, ["ab", "zz"])) == 0.5


def test_natural_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("a-10", "a-2", "a-2-1", "b-1", "a-1")], "t string")
    assert [r.t for r in rows.orderBy(T.natural_key(F.col("t"))).collect()] == ["a-1", "a-2", "a-2-1", "a-10", "b-1"]


def test_small_strings(spark):
    assert one(spark, "Foo · Bar-Baz_，", T.term_key) == "foobarbaz"
    assert one(spark, "第三章 总则", T.strip_ordinal) == "总则" and one(spark, "第三章", T.strip_ordinal) == "第三章"
    assert one(spark, "/a b&c?d#/", T.slug) == "a-b-and-cd"
    assert one(spark, "a/b/c", T.prefixes) == ["a", "a/b"]
    assert one(spark, "于2001年6月19日", T.first_year) == "2001" and one(spark, "3999", T.first_year) is None
    assert one(spark, "> # Head. More", T.lead_summary) == "Head." and len(one(spark, "x" * 90, T.lead_summary)) == 69
    assert one(spark, "foobar", T.fnv1a) == 0xBF9CF968 and one(spark, "", T.fnv1a) == 2166136261


def test_excerpts(spark):
    assert one(spark, "short  body", lambda c: T.excerpt(c, "body", 40)) == "short body"
    got = one(spark, "a" * 100 + " needle " + "b" * 100, lambda c: T.excerpt(c, "needle", 30))
    assert got.startswith("…") and got.endswith("…") and "needle" in got and len(got) == 32


@pytest.mark.parametrize("text, keys", [*CITED, ("专利法第2条、第3条、第19条至第26条", ",".join(f"专利法第{n}条" for n in (2, 3, *range(19, 27)))), ("违反原则第五条", ""), ("按照上述办法第八条", ""), ("", ""), ("专利法\n\n第五条", ""), ("专利法第五条。商标法第六条之二", "专利法第5条,商标法第6条之2")])
def test_citations(text, keys):
    assert ",".join(c.key for c in cite.Extractor(LAWS)(text)) == keys


def test_citation_texts_and_self_references():
    found = list(cite.Extractor(LAWS)("违反商标法第十条、第十一条的规定"))
    assert [c.raw for c in found] == ["第十条", "、第十一条"] and found[0].position == 5
    assert [c.key for c in cite.Extractor(LAWS, "专利法")("依照本法第三条第一款")] == ["专利法第3条第1款"]
    assert not list(cite.Extractor(LAWS)("依照本法第三条"))
    for word in ("本法", "本条例", "本办法", "本细则", "本规定", "本规则", "本解释", "本标准", "本规程", "本纲要", "本指引"):
        assert [c.key for c in cite.Extractor(LAWS, "商标法")(f"依照{word}第五条")] == ["商标法第5条"]
    assert [c.key for c in cite.Extractor({"公约实施细则": "x", "实施细则": "y"})("公约实施细则第1条")] == ["x第1条"]


@pytest.mark.parametrize("text, value", [("&amp;lt;", "&lt;"), ("&#xD800;", "&#xD800;"), ("A&B &unknownentity;", "A&B &unknownentity;"), ("&#20013;&#x4e2d;&quot;", '中中"'), ("&#0;", "&#0;")])
def test_entities(text, value):
    assert python.decode_entities(text) == value


def test_formulas_tables_and_json():
    assert python.latex_to_plain(r"Z \mathsf { n C l } _ { 2 }") == "ZnCl₂" and python.latex_to_plain(r"\frac {1}{2}") is None
    assert python.latex_to_plain(r"1 0 ^ { - 3 } \mu m") == "10⁻³μm"
    assert python.inline_math("a $x_1$ b $\\frac{1}{2}$") == "a x₁ b $\\frac{1}{2}$" and python.inline_math("5$ only") == "5$ only"
    assert python.table_to_pipes("<table><tr><th>a<th>b</tr><tr><td>1|2</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert python.table_to_pipes('<table><tr><td colspan="2">x</td></tr></table>') is None
    assert python.repair_json('{"a": "he said "yes" twice", "b": [1]}') == '{"a": "he said \\"yes\\" twice", "b": [1]}' and python.repair_json("{") is None
    assert python.repair_json('{"a": "one\ntwo "x"\r\n", "b": "c\\"d"}') == '{"a": "one\\ntwo \\"x\\"\\n\\n", "b": "c\\"d"}'
    assert python.nfkc_key("Ａ Ｂ①") == "ab1"


def test_outline():
    got = outline.nodes("d", "# A\none\n### B\ntwo\n## C\n# D\n")
    assert [(n["id"], n["parent"], n["level"], n["label"]) for n in got] == [("d-01", None, 1, "A"), ("d-01-01", "d-01", 2, "B"), ("d-01-02", "d-01", 2, "C"), ("d-02", None, 1, "D")]
    assert got[0]["own"] == "one" and got[0]["full"] == "one\n### B\ntwo\n## C" and got[1]["breadcrumb"] == ["A"]
    assert outline.nodes("d", "") == []


def test_numbered_headings_continue_what_is_there():
    text = "1 One\n1.1 A\ntext\n2024 year\n1.3 skipped\n1.2 B\n1.2.1 deep\n3 no\n2 Two\n5.1 amount of it"
    assert outline.numbered_headings(text) == "## 1 One\n### 1.1 A\ntext\n2024 year\n1.3 skipped\n### 1.2 B\n#### 1.2.1 deep\n3 no\n## 2 Two\n5.1 amount of it"


def test_law_nodes():
    text = "# 某法\n（1984年3月12日通过）\n\n（2020年修正）\n## 第一条 目的\n（本条说明）文\n## 第十二条\n文"
    assert outline.without_passing_note(text) == "# 某法\n\n## 第一条 目的\n（本条说明）文\n## 第十二条\n文"
    got = outline.law_nodes("某法", text, "（2020年施行）")
    assert [(n["level"], n["key"], n["title"], n["parent"]) for n in got] == [(1, "某法第1条", "第一条 目的（2020年施行）", None), (1, "某法第12条", "第十二条（2020年施行）", None)]


def test_linker():
    linker = outline.Linker([("ab", "1"), ("abc", "2"), ("b", "3"), ("x", "4"), ("x", "5"), (" ", "6")])
    assert linker.links("abcab b x [b](u) ab") == [(0, "abc", "2"), (3, "ab", "1"), (6, "b", "3")]
    assert linker.links("ab ab abc", own="1") == [(1, "b", "3"), (6, "abc", "2")] and linker.links("", None) == []
    assert linker.links("[[ab]] ![b](ab) a[[b]]") == [] and linker.links("ab[[c]] abc") == [(0, "ab", "1"), (8, "abc", "2")]
    assert linker.links("abc abc") == [(0, "abc", "2"), (5, "b", "3")]  # a place whose name is linked is given up, the next isn't
    assert outline.Linker([]).links("ab") == []


def test_linker_equals_a_search_of_all_places():
    import random

    r = random.Random(4)
    for _ in range(300):
        names = list({"".join(r.choice("abc") for _ in range(r.randint(1, 4))): None for _ in range(5)})
        text = "".join(r.choice("abc[]!()") for _ in range(40))
        closed = {i for m in outline.FORBIDDEN.finditer(text) for i in range(*m.span())}
        free, seen, want = 0, {names[0]}, []
        for i in range(len(text)):
            here = [n for n in names if text.startswith(n, i) and not closed & set(range(i, i + len(n)))]
            if here and i >= free and (n := max(here, key=len)) not in seen:
                want.append((i, n, n))
                seen.add(n)
                free = i + len(n)
        assert outline.Linker([(n, n) for n in names]).links(text, names[0]) == want


def test_udfs_keep_nulls(spark):
    rows = spark.createDataFrame([("&lt;",), (None,)], "t string").select(python.decode_entities_udf()("t").alias("t"), python.nfkc_key_udf()("t").alias("k"))
    assert [tuple(r) for r in rows.collect()] == [("<", "&lt;"), (None, None)]
