"""References, browsing and articles on small cases that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from stemma.operators import articles, browse, graph, linking, retrieve
from stemma.plans.linking import BOOKS


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_chains_of_any_length(spark):
    n = 70
    merges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 102), (102, 100), (103, 100)], "src int, dst int")
    assert rows(graph.chains(merges)) == [(i, n) for i in range(n)]
    assert graph.chains(merges.limit(0)).count() == 0


def test_contained_names_of_any_length(spark):
    long = "ab" * 40
    texts = spark.createDataFrame([(1, f"x {long} y"), (2, long[:79] + "c"), (3, "ab"), (4, "")], "id int, text string")
    names = spark.createDataFrame([(long, 1.0), ("ab", 1.0), ("zz", 1.0)], "name string, weight double")
    got = {(r.id, r["name"]) for r in retrieve.contained_names(texts, names, 5).collect()}
    assert got == {(1, long), (1, "ab"), (2, "ab"), (3, "ab")}


def test_cascade_passes_over_ambiguous_steps(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "id int, target string")
    second = spark.createDataFrame([(1, "d"), (2, "e")], "id int, target string")
    assert sorted(map(str, cascaded(asked, first, second))) == sorted(map(str, [(1, "d", 1), (2, "c", 0), (3, None, -1)]))


def cascaded(asked, *steps):
    return [tuple(r) for r in linking.cascade(asked, "k", list(steps)).collect()]


def test_truncated_codes(spark):
    nodes = spark.createDataFrame([("n1", "3", "Three"), ("n2", "3.2", "A"), ("n3", "3.2", "B")], "id string, code string, label string")
    refs = spark.createDataFrame([("r1", "3.2.1", None), ("r2", "3.2.1", "B"), ("r3", "4.1", None), ("r4", "3", None)], "ref string, code string, label string")
    assert rows(linking.truncated(refs, nodes)) == [("r1", "3", "n1"), ("r2", "3.2", "n3"), ("r4", "3", "n1")]


def test_articles_of_a_query():
    names = articles.registry(BOOKS, {"细则": "rules"})
    assert names[0].alias == "专利法实施细则" and next(n for n in names if n.alias == "细则").kind == "short"
    known = {("专利法", 26), ("专利法实施细则", 26)}
    default = next(n for n in names if n.law == "专利法")
    assert articles.parse("《专利法实施细则》第二十六条", names, known) == articles.Asked("专利法实施细则", "rules", 26, True, False)
    assert articles.parse("专利法 第 99 条", names, known).missing and articles.parse("第26条", names, known) is None
    assert articles.parse("第26条", names, known, default) == articles.Asked("专利法", "patent", 26, False, False)
    assert articles.parse("刑法第26条", names, known, default) is None and articles.parse("26", names, known, default) is None


def test_clashes(spark):
    data = spark.createDataFrame([("a", "第八条", "guide", 100.0, ["body"]), ("b", "第九条", "guide", 100.0, ["body"]), ("c", "其他", "mark", 100.0, ["body"]), ("d", "第九条", "mark", 100.0, ["law"]), ("e", "第九条 和第八条", "guide", 100.0, ["cited", "body"])], "id string, title string, domain string, score double, via array<string>")
    score = lambda asked: {r.id: r.score for r in articles.clashes(data, asked, ["patent", "mark"]).collect()}
    assert score(articles.Asked("专利法", "patent", 8, True, False)) == {"a": 100, "b": 25, "c": 25, "d": 100, "e": 100}
    assert score(articles.Asked("专利法", "patent", 8, False, False)) == {"a": 100, "b": 25, "c": 100, "d": 100, "e": 100}


def test_errors_name_what_is_unknown(spark):
    batch = spark.createDataFrame([("a", 1)], "k string, n int")
    assert rows(linking.decided(batch.select("k", F.lit("keep").alias("d")), batch, "k")) == [("a", 1, "keep")]
    with pytest.raises(ValueError, match="zz"):
        linking.decided(spark.createDataFrame([("zz", "keep")], "k string, d string"), batch, "k").count()
    aliases = spark.createDataFrame([("s", "x")], "slug string, alias string")
    assert rows(browse.allowed(aliases, ["x"])) == [("s", "x")]
    with pytest.raises(ValueError, match="y"):
        browse.allowed(aliases, ["x", "y"])


def test_small_browsing_functions(spark):
    one = spark.createDataFrame([("a/b/c", ["x", "y"])], "slug string, keys array<string>")
    got = one.select(browse.path_to_root(F.col("slug")), browse.in_reading_chain(F.col("slug")), browse.in_reading_chain(F.lit("tags/x")), F.array_join(browse.moved(F.col("keys"), "z", 9), ","), F.array_join(browse.breadcrumbs(F.col("keys"), F.lit("l"), True), ","), F.array_join(browse.near_misses(F.lit("电子 商务")), ",")).first()
    assert tuple(got) == ("../..", True, False, "x,y,z", "x,y,l", "电子商务,电子 的商务")


@pytest.mark.parametrize("group", [10**6, 10])
def test_running_sums_of_groups_of_any_size(spark, group):
    import random

    from stemma.operators import ranking

    r = random.Random(5)
    data = [(r.choice(["a", "a", "a", "b", None]), i, r.randint(1, 9)) for i in range(300)]
    got = ranking.running(spark.createDataFrame(data, "k string, i int, cost int"), ["k"], [F.col("i").desc()], {"spent": F.col("cost")}, group)
    want = []
    for k in {k for k, *_ in data}:
        spent = 0
        for nth, (_, i, cost) in enumerate(sorted((x for x in data if x[0] == k), key=lambda x: -x[1]), 1):
            want.append((k, i, cost, nth, spent := spent + cost))
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want)) and got.columns == ["k", "i", "cost", "nth", "spent"]


def test_hashed_pairs_find_most_links(spark):
    import numpy as np

    from stemma.operators import tables

    r = np.random.default_rng(6)
    base = r.normal(size=(60, 64))
    v = np.concatenate([base, *(base + 0.55 * r.normal(size=base.shape) for _ in range(4))])
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")
    exact = {(x.a, x.b) for x in tables.similar_pairs(df, "id", "v", 0.7).collect()}
    found = tables.hashed_pairs(df, "id", "v", 0.7, 64, bucket=20).collect()
    assert {(x.a, x.b) for x in found} <= exact and len(found) >= 0.9 * len(exact) > 100
