"""The pipeline's stages take effect, keep columns and clean documents, and work on odd tables."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from stemma.llm import packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["th", "er", "an", "on", "re", "in"]) for _ in range(r.randint(1, 4)))
    vocabulary = [word() for _ in range(800)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    bench = [(i, text(30)) for i in range(5)]
    clean = [text(r.randint(60, 300)) for _ in range(400)]
    toxic = [t[:-1] + " you idiot moron idiot scum." for t in (text(100) for _ in range(100))]
    junk = ["%%% ".join(r.choice(vocabulary) for _ in range(100)) for _ in range(10)]
    leaks = [f"{text(50)} {b} {text(40)}" for _, b in bench]
    copies = [clean[0]] * 4 + [clean[1].replace(" ", "  ", 3)]
    texts = [*clean, *toxic, *junk, *leaks, *copies, None, "", "short"]
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(400 <= i < 500)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), SCHEMA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.collect()}
    clean, toxic, junk, leaks, copies, odd = set(range(400)), set(range(400, 500)), set(range(500, 510)), set(range(510, 515)), set(range(515, 520)), set(range(520, 523))
    assert not kept["quality"] & (junk | odd) and len(clean - kept["quality"]) <= 4
    assert len(toxic & kept["toxicity"]) <= 5 and len(clean & kept["toxicity"]) >= 390
    assert not kept["near_duplicates"] & copies and kept["toxicity"] & clean == kept["near_duplicates"] & clean
    assert not kept["decontamination"] & leaks and kept["near_duplicates"] & clean == kept["decontamination"] & clean
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == kept["decontamination"]
    encode, texts = packing.encoder(queries.vocabulary()), {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in by_doc.items():
        ids = np.array([*encode(texts[i]), packing.END], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == packing.cuts(len(ids), 1024)[:-1] and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_bin.values():
        assert sum(n for _, n in own) <= 1024 and all(o == sum(n for _, n in sorted(own)[:k]) for k, (o, _) in enumerate(sorted(own)))


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_on_null_ids_and_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    rows = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "n_chars", "1 AS kept", "'k' AS key", "array(1) AS bands")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns and 55 <= out.count() <= 60
    packed = corpus_pipeline.packing(spark, rows.withColumns({"piece": rows["n_chars"], "sequence_id": rows["text"]}), sf_dir).collect()
    assert {r.doc_id for r in packed} == {None} and sum(r.piece == 0 for r in packed) == 60


def test_stages_on_repeated_and_very_long_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(10**5)}" for _ in range(250_000))
    rows = docs.unionByName(docs).unionByName(spark.createDataFrame([(900, long, "en", "s", len(long))], SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        out = [x.doc_id for x in stage(spark, rows, sf_dir).collect()]
        want = 1 if name == "near_duplicates" else 2
        assert 900 in out or name == "quality"
        assert sum(out.count(i) == want for i in range(40)) >= 38 or name == "packing" and set(out) == {*range(40), 900}


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names if n not in queries._BASES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert {"op1_decontaminate", "op6_warc", "op10_hosts", *queries._BASES} == set(queries.oracle_sql())
    assert set(queries.oracle_sql()) <= set(names)
