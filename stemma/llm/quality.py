"""Quality rules: robust multivariate outliers among text statistics.

Each text gives seven statistics, transformed so that prose is roughly normal in them. For every language and source, every
language, and all rows, location and scatter are those of the minimum-covariance-determinant estimate over ``NEAREST`` of the
rows. Three deterministic starts (median deviations, spatial signs and hyperbolic tangents of the standardised rows) take two
concentration steps each; the one of least determinant goes on until its determinant falls no more, and the least ever seen
is kept. A concentration step takes the rows of the least distances; distances are sorted into bins of an eighth of an octave
and the bin at the border counts with the share of it that is needed. Scatters are made consistent by the median distance,
never smaller, and have the squares of ``FLOOR`` added on the diagonal, the resolution below which a statistic tells nothing.

A group's estimate weighs as its rows against ``SHRINK`` rows of its language's, and a language's likewise against that of
all rows: small groups lean on what they are part of, without a bound at which this changes. A row is rejected if its squared
Mahalanobis distance passes the ``CUTOFF`` quantile of the chi-squared distribution.

Scale: one scan of the texts; then only seven numbers a row. Concentration steps are groupBy sums over (group, bin) with
partial aggregation, so a source that holds a third of the rows is no single task; the number of groups isn't bounded by
the driver.

Defined cases: a null text has no words and fails the base rule, as all texts under 50 words; null lang or source is a
group of its own; repeated rows are judged each, equal rows and equal distances alike; texts have any length; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stemma.llm import _text
from stemma.llm._spark import batch_of, cut_columnar

#: Statistics: their resolution.
FLOOR = {"log_words": 0.7, "log_word_chars": 0.06, "log_symbols": 0.28, "dup_lines": 0.09, "repeat_words": 0.08, "upper": 0.03, "punctuation": 0.03}
P = len(FLOOR)
NEAREST = 0.75
CUTOFF = 1 - 1e-6
SHRINK = 50.0
#: Least fall of the determinant's logarithm that counts.
FALL = 1e-3
#: Groups whose parameters are broadcast (some 500 bytes a start); beyond, rows and parameters are joined by group and salt.
BROADCAST_GROUPS = 10_000
SALTS = 32
MIN_WORDS = 50


def chi2(q: float, p: int = P) -> float:
    """Quantile by Wilson and Hilferty."""
    z = NormalDist().inv_cdf(q)
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


_CLASS = np.zeros(256, np.uint8)  # 1: capital, 2: other ASCII punctuation, 3: symbol
_CLASS[65:91] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_CLASS[list(b"#*$%&|<>")] = 3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STATS = pa.schema([*((b, pa.int64()) for b in BASE), *((f, pa.float64()) for f in FLOOR)])


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = _text.buffers(texts)
    h, _, _, ranges = _text.words(data, offsets, _text.SPACED)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    kind = _CLASS[data]
    n_words, word_chars = np.diff(ranges), per((_text.SPACED[data] != 0) & ((data & 0xC0) != 0x80))
    symbols, upper, other = per(kind == 3), per(kind == 1), per(kind == 2)
    g, ok = _text.grams(h, ranges, 3)
    repeated = np.zeros(len(h), bool)
    at = np.flatnonzero(ok)
    if len(at):
        doc = np.searchsorted(ranges, at, "right") - 1
        key = _text.mix(g[at] + _text.mix(doc.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = at[order[np.append(same, False) | np.append(False, same)]]
        for i in range(3):
            repeated[twice + i] = True
    n_repeat = np.diff(np.concatenate([[0], np.cumsum(repeated)])[ranges])
    lines, dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    n = np.maximum(n_words, 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": n_repeat,
        "log_words": np.log(n), "log_word_chars": np.log(np.maximum(word_chars, 1) / n), "log_symbols": np.log1p(20 * symbols / n), "dup_lines": dup / np.maximum(lines, 1),
        "repeat_words": n_repeat / n, "upper": upper / np.maximum(word_chars, 1), "punctuation": other / np.maximum(word_chars, 1),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(0)
        for a, b in _text.chunks(texts):
            found = statistics(texts.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([*(pa.array(found[f.name], f.type) for f in _STATS), *(c.slice(a, b - a) for c in batch.columns[1:])], names=[*_STATS.names, *names[1:]])


_SYMMETRIC = [(i, j) for i in range(P) for j in range(i, P)]
_SQUARES = np.diag(np.array(list(FLOOR.values())) ** 2)


def _matrix(values: list[float]) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(_SYMMETRIC, values):
        out[i, j] = out[j, i] = v
    return out


_FOUND_SQL = "grp string, start int, n double, mu array<double>, scatter array<double>, inverse array<double>, size double"


def _found(rows: list[tuple[str, int, float, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Group, start, rows, location, scatter without the floor."""
    full = [c + _SQUARES for *_, c in rows]
    lists = lambda xs: pa.array([np.asarray(x).ravel().tolist() for x in xs], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([float(r[2]) for r in rows], pa.float64()), lists(r[3] for r in rows), lists(r[4] for r in rows), lists(np.linalg.inv(c) for c in full), pa.array([float(np.linalg.slogdet(c)[1]) for c in full], pa.float64())], names=["grp", "start", "n", "mu", "scatter", "inverse", "size"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Medians, deviations and sums over standardised rows -> three estimates a group."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spread = np.array(r["spread"])
            sign, tanh = (_matrix([r[f"{k}{i}_{j}"] for i, j in _SYMMETRIC]) / max(r["n"], 1) for k in ("g", "t"))
            shapes = np.eye(P), sign * P, tanh / max(np.trace(tanh) / P, 1e-9)
            rows += [(r["grp"], k, r["n"], np.array(r["mu"]), shape * np.outer(spread, spread)) for k, shape in enumerate(shapes)]
        yield _found(rows)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group, start, count, sums and sums of products -> location and scatter."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            mu = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
            rows.append((r["grp"], r["start"], r["total"], mu, _matrix([r[f"s{i}_{j}"] for i, j in _SYMMETRIC]) / r["n"] - np.outer(mu, mu)))
        yield _found(rows)


def _distance() -> Column:
    d = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FLOOR)]
    terms = [d[i] * d[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return reduce(Column.__add__, terms)


def _with(rows: DataFrame, groups: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """rows with their group's columns, without bringing a group's rows together. groups: one row a key; n: how many."""
    if n <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), key, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*FLOOR), F.lit(SALTS)))
    return dealt.join(groups.withColumn("_salt", F.expr(f"explode(sequence(0L, {SALTS - 1}L))")), [key, "_salt"], how).drop("_salt")


def _concentrated(vectors: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The estimate of each group's and start's nearest rows."""
    names = list(FLOOR)
    far = _with(vectors, found.select("grp", "start", "mu", "inverse"), "grp", n)
    far = far.select("grp", "start", *names, F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * 8).alias("bin"))
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in _SYMMETRIC]
    binned = far.groupBy("grp", "start", "bin").agg(F.count("*").alias("k"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(names)], *products)
    own = W.partitionBy("grp", "start")
    ranked = binned.withColumns({"total": F.sum("k").over(own), "upto": F.sum("k").over(own.orderBy("bin"))})
    share = F.least(F.lit(1.0), (F.ceil(F.col("total") * NEAREST) - F.col("upto") + F.col("k")) / F.col("k"))
    sums = [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in _SYMMETRIC]
    near = ranked.withColumn("share", share).where("share > 0").groupBy("grp", "start").agg(F.first("total").alias("total"), F.sum(F.col("k") * F.col("share")).alias("n"), *[F.sum(F.col(x) * F.col("share")).alias(x) for x in sums])
    return cut_columnar(near.mapInArrow(_estimates, _FOUND_SQL))


def estimate(vectors: DataFrame) -> DataFrame:
    """grp, n (rows), mu and scatter (consistent, with the floor) by minimum covariance determinant.

    vectors: grp and the statistics.
    """
    names, floor = list(FLOOR), list(FLOOR.values())
    n = vectors.select("grp").distinct().count()
    centre = vectors.groupBy("grp").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"m{i}") for i, f in enumerate(names)])
    spread = _with(vectors, centre, "grp", n).groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 1000).alias(f"v{i}") for i, f in enumerate(names)])
    deviation = F.array(*[F.sqrt(F.pow(1.4826 * F.col(f"v{i}"), 2) + floor[i] ** 2) for i in range(P)])
    spread = cut_columnar(spread.select("grp", F.array(*[F.col(f"m{i}") for i in range(P)]).alias("mu"), deviation.alias("spread")))
    z = [f"z{i}" for i in range(P)]
    rows = _with(vectors, spread, "grp", n).select("grp", "mu", "spread", *[((F.col(f) - F.col("mu")[i]) / F.col("spread")[i]).alias(z[i]) for i, f in enumerate(names)])
    length = F.greatest(reduce(Column.__add__, [F.col(x) * F.col(x) for x in z]), F.lit(1e-12))
    signs = [F.sum(F.col(z[i]) * F.col(z[j]) / length).alias(f"g{i}_{j}") for i, j in _SYMMETRIC]
    tanhs = [F.sum(F.tanh(z[i]) * F.tanh(z[j])).alias(f"t{i}_{j}") for i, j in _SYMMETRIC]
    sums = rows.groupBy("grp").agg(F.count("*").alias("n"), F.first("mu").alias("mu"), F.first("spread").alias("spread"), *signs, *tanhs)
    found = cut_columnar(sums.mapInArrow(_starts, _FOUND_SQL))
    for _ in range(2):
        found = _concentrated(vectors, found, n)
    fields = ["size", "start", "n", "mu", "scatter", "inverse"]
    best = cut_columnar(found.groupBy("grp").agg(F.min(F.struct(*fields)).alias("best")).select("grp", *[F.col(f"best.{f}").alias(f) for f in fields]))
    while True:
        new = _concentrated(vectors, best, n).select("grp", F.struct(*fields).alias("new"))
        falls = F.col("new.size") < F.col("size") - FALL
        step = best.join(new, "grp").withColumn("falls", falls)
        best = cut_columnar(step.select("grp", "falls", *[F.when(F.col("falls"), F.col(f"new.{f}")).otherwise(F.col(f)).alias(f) for f in fields]))
        if not best.where("falls").limit(1).count():
            break
    fine = _with(vectors, best.select("grp", "mu", "inverse"), "grp", n).groupBy("grp", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-9))) * 64).alias("bin")).agg(F.count("*").alias("k"))
    own = W.partitionBy("grp")
    ranked = fine.withColumns({"total": F.sum("k").over(own), "upto": F.sum("k").over(own.orderBy("bin"))})
    middle = ranked.where("upto * 2 >= total").groupBy("grp").agg(F.min("bin").alias("bin"))
    scale = F.greatest(F.pow(2.0, (F.col("bin") + 0.5) / 64) / chi2(0.5), F.lit(1.0))
    full = F.zip_with("scatter", F.array(*[F.lit(float(x)) for x in _SQUARES.ravel()]), lambda a, b: a + b)
    return best.join(middle, "grp").select("grp", "n", "mu", F.transform(full, lambda x: x * scale).alias("scatter"))


_SHRUNK_SQL = "grp string, mu array<double>, inverse array<double>"


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimates of a group, its language and all rows -> the group's location and inverse scatter."""
    for batch in batches:
        mu, inverse = [], []
        for r in batch.to_pylist():
            m, s = np.array(r["mu_all"]), np.array(r["scatter_all"])
            for level in ("lang", "own"):
                w = r[f"n_{level}"] / (r[f"n_{level}"] + SHRINK)
                m, s = (w * np.array(r[f"{k}_{level}"]) + (1 - w) * old for k, old in (("mu", m), ("scatter", s)))
            mu.append(m.tolist())
            inverse.append(np.linalg.inv(s.reshape(P, P)).ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mu, pa.list_(pa.float64())), pa.array(inverse, pa.list_(pa.float64()))], names=["grp", "mu", "inverse"])


def parameters(fine: DataFrame) -> DataFrame:
    """grp (language and source as JSON), mu, inverse; fine: lang, source and the statistics of the rows to learn from."""
    own, lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    levels = F.array(F.lit("all"), F.concat(F.lit("lang"), lang), F.concat(F.lit("own"), own))
    found = cut_columnar(estimate(cut_columnar(fine.select(F.explode(levels).alias("grp"), *FLOOR))))
    groups = fine.select("lang", "source").distinct().select(own.alias("grp"), lang.alias("lang"))
    of = lambda level: found.where(F.col("grp").startswith(level)).select(F.expr(f"substring(grp, {len(level) + 1})").alias(f"key_{level}"), *[F.col(c).alias(f"{c}_{level}") for c in ("n", "mu", "scatter")])
    joined = groups.join(of("own"), F.col("grp") == F.col("key_own")).join(of("lang"), F.col("lang") == F.col("key_lang")).join(F.broadcast(of("all")), F.col("key_all") == "")
    return joined.select("grp", *[f"{c}_{level}" for level in ("own", "lang", "all") for c in ("n", "mu", "scatter")]).mapInArrow(_shrunk, _SHRUNK_SQL)


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance, kept and, as kept_NAME, the columns named in keep, for every row."""
    carried = [F.col(c).alias(f"kept_{c}") for c in keep]
    own = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *carried)
    fields = [*(f"{b} long" for b in BASE), *(f"{f} double" for f in FLOOR), *(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[1:])]
    rows = cut_columnar(own.mapInArrow(_measure, ", ".join(fields)).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    found = cut_columnar(parameters(rows.where("NOT base_failed")))
    judged = _with(rows.withColumn("grp", F.to_json(F.struct("lang", "source"))), found, "grp", found.count(), "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2(CUTOFF), F.lit(True))
    return judged.select("doc_id", *BASE, "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), kept.alias("kept"), *[F.col(f"kept_{c}") for c in keep])
