"""Resolving references to nodes: cascades of look-ups, code and number references, cross-references, typed edges of all kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.functions import text as T
from stemma.operators import graph


def longest_prefix(rows: DataFrame, key: str, mapping: DataFrame, id_: str) -> DataFrame:
    """id, value of the longest prefix that the mapping knows; rows without one are left out. mapping: prefix, value.

    Prefixes are looked up by equality, one for each length that the mapping has (a handful of numbers), not by a theta join.
    """
    sizes = [r[0] for r in mapping.select(F.length("prefix")).distinct().collect()]
    probes = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.left(F.col(key), F.lit(n)).alias("prefix")) for n in sorted(sizes)]))
    probed = rows.select(F.col(id_).alias("id"), F.length(F.col(key)).alias("size"), probes.alias("p")).where("p.n <= size").select("id", "p.n", "p.prefix")
    return probed.join(mapping, "prefix").groupBy("id").agg(F.max_by("value", F.struct("n", "value")).alias("value"))


def cascade(asked: DataFrame, id_: str, steps: list[DataFrame]) -> DataFrame:
    """id, target, step of the first step that gives an id exactly one target; null target and step -1 where none does.

    steps: frames of (id, target) in order of trust. A step that is ambiguous for an id is passed over.
    """
    sure = [s.groupBy("id").agg(F.min("target").alias("target"), F.count_distinct("target").alias("k")).where("k = 1").select("id", "target", F.lit(i).alias("step")) for i, s in enumerate(steps)]
    best = reduce(DataFrame.unionByName, sure).groupBy("id").agg(F.min_by(F.struct("target", "step"), "step").alias("b"))
    return asked.select(F.col(id_).alias("id")).distinct().join(best, "id", "left").select("id", "b.target", F.coalesce("b.step", F.lit(-1)).alias("step"))


def truncated(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref, code, node: 3.2.1, else 3.2, else 3; the longest code that exactly one node has, or one node of the quoted label.

    refs: ref, code, label (or null); nodes: id, code, label.
    """
    parts = F.split("code", r"\.")
    shorter = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), ".").alias("code")))
    probes = refs.select("ref", F.col("label").alias("quoted"), F.explode(shorter).alias("p")).select("ref", "quoted", "p.n", "p.code")
    one = lambda keys, name: nodes.groupBy(*keys).agg(F.min("id").alias(name), F.count("*").alias("k")).where("k = 1").drop("k")
    found = probes.join(one(["code"], "only"), "code", "left").join(one(["code", "label"], "named").withColumnRenamed("label", "quoted"), ["code", "quoted"], "left")
    return found.withColumn("node", F.coalesce("only", "named")).where("node IS NOT NULL").groupBy("ref").agg(F.max_by(F.struct("code", "node"), "n").alias("b")).select("ref", "b.code", "b.node")


def scoped(refs: DataFrame, nodes: DataFrame, scopes: list[str]) -> DataFrame:
    """ref, node, scope: the narrowest scope in which exactly one node has the number. refs: ref, number and the scopes; nodes: id, number and the scopes."""
    one = nodes.select(F.col("id").alias("node"), "number", *scopes)
    steps = []
    for k, scope in enumerate(scopes):
        unique = one.groupBy(scope, "number").agg(F.min("node").alias("node"), F.count("*").alias("k")).where("k = 1").drop("k")
        steps.append(refs.select("ref", "number", scope).join(unique, [scope, "number"]).select("ref", "node", F.lit(k).alias("scope")))
    return reduce(DataFrame.unionByName, steps).groupBy("ref").agg(F.min_by(F.struct("node", "scope"), "scope").alias("b")).select("ref", "b.node", "b.scope")


def own_citations(occurrences: DataFrame, citations: DataFrame, laws: DataFrame) -> DataFrame:
    """term, node, cites (in order): what the nodes where a term occurs cite of the term's own laws.

    occurrences: term, node; citations: node, law, cite; laws: term, law.
    """
    rows = occurrences.distinct().join(citations, "node").join(laws.distinct(), ["term", "law"], "left_semi")
    return rows.groupBy("term", "node").agg(F.array_sort(F.collect_set("cite")).alias("cites"))


def topic_peers(members: DataFrame, judged: DataFrame, per_domain: int = 2, most: int = 24) -> DataFrame:
    """id, peer, rank: members of a shared topic in other domains, of each domain the ``per_domain`` of highest degree, not judged yet.

    members: id, domain, topics (array), degree; judged: id, peer. The candidates of a topic are ranked before they are
    paired, so a topic gives at most per_domain for each domain to each member.
    """
    flat = members.select("id", "domain", "degree", F.explode(F.array_distinct("topics")).alias("topic"))
    best = graph.top_per_key(flat, ["topic", "domain"], [F.col("degree").desc(), F.col("id")], per_domain).select("topic", F.col("id").alias("peer"), F.col("domain").alias("peer_domain"), F.col("degree").alias("peer_degree"))
    pairs = flat.select("id", "domain", "topic").join(best, "topic").where("peer_domain <> domain").select("id", "peer", "peer_domain", "peer_degree").distinct()
    kept = graph.top_per_key(pairs, ["id", "peer_domain"], [F.col("peer_degree").desc(), F.col("peer")], per_domain).drop("rank").join(judged, ["id", "peer"], "left_anti")
    return graph.top_per_key(kept, "id", [F.col("peer_degree").desc(), F.col("peer")], most).select("id", "peer", "rank")


#: How a part, a chapter and a section are referred to in a text.
_NUMBER = "[0-9一二三四五六七八九十百]+"
PART = rf"(?:本部分|第({_NUMBER})部分)"
CHAPTER, SECTION = rf"第({_NUMBER})章", r"第?([0-9]+(?:\.[0-9]+)+)节?"


def cross_references(nodes: DataFrame) -> DataFrame:
    """src, part, chapter, code of the references in nodes' texts; a part that isn't named is the node's own. nodes: id, part, text."""
    places = F.regexp_extract_all("text", F.lit(rf"({PART}?{CHAPTER}(?:的?{SECTION})?)"), F.lit(1))
    flat = nodes.select(F.col("id").alias("src"), F.col("part").alias("own"), F.explode(places).alias("place"))
    number = lambda pattern: T.cn_number(F.nullif(F.regexp_extract("place", pattern, 1), F.lit("")))
    return flat.select("src", F.coalesce(number(rf"第({_NUMBER})部分"), F.col("own")).alias("part"), number(CHAPTER).alias("chapter"), F.nullif(F.regexp_extract("place", rf"章的?{SECTION}", 1), F.lit("")).alias("code")).distinct()


def reference_edges(refs: DataFrame, nodes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Edges of type xref: 0.6 to a section, or the section above it, 0.45 to a chapter; none where the hierarchy has one.

    refs: src, part, chapter, code; nodes: id, part, chapter, code (null for the chapter itself); hierarchy: src, dst.
    """
    keyed = refs.withColumn("ref", F.monotonically_increasing_id())
    parts = F.split("code", r"\.")
    shorter = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), ".").alias("code")))
    probes = keyed.where("code IS NOT NULL").select("ref", "src", "part", "chapter", F.explode(shorter).alias("p")).select("ref", "src", "part", "chapter", "p.n", "p.code")
    section = probes.join(nodes.where("code IS NOT NULL"), ["part", "chapter", "code"]).groupBy("src", "ref").agg(F.max_by("id", F.struct("n", "id")).alias("dst")).select("src", "ref", "dst", F.lit(0.6).alias("weight"))
    chapter = keyed.join(section.select("ref"), "ref", "left_anti").join(nodes.where("code IS NULL"), ["part", "chapter"]).select("src", "ref", F.col("id").alias("dst"), F.lit(0.45).alias("weight"))
    both = section.unionByName(chapter).where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    near = graph.both_ways(hierarchy).distinct()
    return both.join(near, ["src", "dst"], "left_anti").select("src", "dst", F.lit("xref").alias("type"), "weight")


def typed(rows: DataFrame, kind: str, weight: Column | float) -> DataFrame:
    return rows.select("src", "dst", F.lit(kind).alias("type"), (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight"))


def hierarchy_edges(nodes: DataFrame) -> DataFrame:
    """From parent to child, weight 1. nodes: id, parent."""
    return typed(nodes.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst")), "hierarchy", 1.0)


def term_edges(evidence: DataFrame, degree: DataFrame, most: int = 30) -> DataFrame:
    """Edges of type termref: 1 to where a term is defined, 0.6 to where it is used; of each term the ``most`` best.

    evidence: term, node, defined; degree: id, degree.
    """
    rows = evidence.groupBy(F.col("term").alias("src"), F.col("node").alias("dst")).agg(F.max(F.when(F.col("defined"), 1.0).otherwise(0.6)).alias("weight"))
    ranked = rows.join(degree.withColumnRenamed("id", "dst"), "dst", "left")
    kept = graph.top_per_key(ranked, "src", [F.col("weight").desc(), F.coalesce("degree", F.lit(0)).desc(), F.col("dst")], most)
    return typed(kept, "termref", F.col("weight"))


#: Types of edges in the order in which the first of a pair wins.
ORDER = ("hierarchy", "xref", "colaw", "lawref", "termref", "termlaw", "termrel", "termco")


def all_edges(builders: list[DataFrame], nodes: DataFrame, black: DataFrame | None = None) -> DataFrame:
    """The union of typed edges: loops, dangling and blacklisted ones dropped, one edge for each pair and type."""
    rows = reduce(DataFrame.unionByName, builders)
    rows = graph.closed(rows.withColumn("seq", F.struct(F.array_position(F.array(*map(F.lit, ORDER)), F.col("type")), (-F.col("weight")), "src", "dst")), nodes)
    if black is not None:
        rows = rows.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(black, ["a", "b"], "left_anti").drop("a", "b")
    return graph.dedupe(rows)


def best_evidence(rows: DataFrame) -> DataFrame:
    """One row a term and node: defined before used, then by confidence, then the longest. rows: term, node, role, confidence, text."""
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "mid", 1).otherwise(2)
    order = F.struct((F.col("role") != "defined").alias("used"), rank.alias("rank"), (-F.length("text")).alias("size"), "text")
    best = rows.groupBy("term", "node").agg(F.min_by(F.struct("role", "confidence", "text"), order).alias("b"))
    return best.select("term", "node", "b.role", "b.confidence", "b.text")


def best_definition(rows: DataFrame) -> DataFrame:
    """term, chunk, text: by confidence, then in the term's main field, then at its preferred node, then the longest, then by chunk.

    rows: term, chunk, text, confidence, field, main_field, node, preferred.
    """
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "mid", 1).otherwise(2)
    other = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(True))
    order = F.struct(rank.alias("rank"), other("field", "main_field").alias("away"), other("node", "preferred").alias("elsewhere"), (-F.length("text")).alias("size"), "chunk")
    return rows.groupBy("term").agg(F.min_by(F.struct("chunk", "text"), order).alias("b")).select("term", "b.chunk", "b.text")


def polluters(edges: DataFrame, bad: DataFrame, most: int = 25) -> DataFrame:
    """id, bad, degree, share of the nodes with most bad edges. edges: src, dst; bad: src, dst."""
    count = lambda e, name: graph.degree(e).withColumnRenamed("degree", name)
    rows = count(bad, "bad").join(count(edges, "degree"), "id", "left")
    return rows.withColumn("share", F.round(F.col("bad") / F.col("degree"), 4)).orderBy(F.col("bad").desc(), F.col("share").desc(), "id").limit(most)


def decided(decisions: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch with its decisions; a decision on what isn't in the batch is an error."""
    unknown = decisions.join(batch, key, "left_anti").select(key).limit(10).collect()
    if unknown:
        raise ValueError(f"decisions on unknown rows: {', '.join(str(r[0]) for r in unknown)}")
    return batch.join(decisions, key, "left")


def without(edges: DataFrame, black: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that aren't blacklisted (a < b), and the degrees that are left."""
    kept = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(black.select("a", "b"), ["a", "b"], "left_anti").drop("a", "b")
    return kept, graph.degree(kept)


def faulty(edges: DataFrame) -> DataFrame:
    """a, b, type, n, fault: loops, and pairs that occur more than once."""
    rows = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type").agg(F.count("*").alias("n"))
    return rows.withColumn("fault", F.when(F.col("a") == F.col("b"), "loop").when(F.col("n") > 1, "repeated")).where("fault IS NOT NULL")


def carried_over(new: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """new with fields of the previous run where it has none of its own."""
    before = old.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    rows = new.join(before, key, "left")
    return rows.select(*[c for c in new.columns if c not in fields], *[F.coalesce(F.col(f), F.col(f"_{f}")).alias(f) for f in fields])


def review_sheets(edges: DataFrame, judged: DataFrame, size: int = 20) -> DataFrame:
    """center, sheet, neighbours still without a verdict, in sheets of ``size``. edges: src, dst; judged: a, b."""
    both = graph.both_ways(edges).distinct().withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(judged.select("a", "b"), ["a", "b"], "left_anti")
    nth = F.row_number().over(W.partitionBy("src").orderBy(T.natural_key(F.col("dst")))) - 1
    rows = both.select(F.col("src").alias("center"), F.col("dst"), nth.alias("nth")).withColumn("sheet", (F.floor(F.col("nth") / size) + 1).cast("int"))
    return rows.groupBy("center", "sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "dst"))), lambda x: x.dst).alias("neighbours"))


def remapped(rows: DataFrame, id_: str, mapping: DataFrame) -> DataFrame:
    """rows with new ids; ids that the mapping lacks stay. mapping: old, new (several new ids of an old one make copies)."""
    return rows.join(mapping, F.col(id_) == F.col("old"), "left").withColumn(id_, F.coalesce("new", id_)).drop("old", "new")
