"""Every query with SQL gives the SQL's rows on the smallest tables; the flagship query runs; the package stands alone."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from stemma.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_anchors_move_with_the_edit(spark):
    rows = registry.queries()["anchor_after_edit"](spark, SF).collect()
    assert rows and all(r.kept for r in rows)


def test_anchors_are_sought_in_whole_texts(spark, tmp_path):
    texts = ["x " * 2000 + "the end of it", "the first is too early", "a" * 40 + "the", "b " * 30 + "the one and the other", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["anchor_after_edit"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.kept) for r in rows) == [(0, 4000, True), (2, 40, True), (3, 60, True)]


def test_anchors_in_repeated_texts_equal_the_sql(spark, tmp_path):
    stems = ["the ", "Sthe. ", "Thernthe ", "Ththes ", "é the\n", "the", "New.\nthe", "New.\n", "w.\nthe ", "\nthe"]
    texts = [" " * n + stem * 30 + end for stem in stems for n in (0, 3, 39) for end in ("", "the", " the end")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["anchor_after_edit"](spark, str(tmp_path)).select("doc_id", "start", "found", "kept").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()["anchor_after_edit"]).fetchall()
    assert len(want) > 80 and sorted(tuple(r) for r in got) == sorted(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    (copy / "stemma").mkdir(parents=True)
    os.symlink(f"{root}/__spark_entry__.py", copy / "__spark_entry__.py")
    for name in os.listdir(f"{root}/stemma"):
        if name != "llm":
            os.symlink(f"{root}/stemma/{name}", copy / "stemma" / name)
    code = f"import sys; sys.path[:0] = [{str(copy)!r}]; import importlib.util as u; s = u.spec_from_file_location('e', {str(copy / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, cwd=tmp_path)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == len(registry.queries()), out.stderr


def test_the_rest_passes_without_the_training_data_operators(tmp_path):
    """All other tests are collected in a copy without both folders and the pipeline; those of the smallest file run there."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "*.json"))
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)}, cwd=copy)
    found = run("--collect-only", "tests")
    assert found.returncode == 0, found.stdout
    passed = run("tests/test_site.py")
    assert passed.returncode == 0, passed.stdout
