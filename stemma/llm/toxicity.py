"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, its word pairs and its pairs with one word between; all have the
value 1, so a long text isn't diluted. Training is per-coordinate FTRL-proximal with L1, several passes in a fixed
order; most weights end at exactly zero and the rest are broadcast (at most 2 ** bits of them).

The fit uses a bounded sample of labelled rows: of each class, the ``sample`` rows whose hashed id is smallest. Sampling the
classes alike shifts the intercept, which is moved back to the prior measured over all labelled rows. Scores are then
calibrated (a slope and an intercept by Newton's method) on a fifth of the sample that a first fit doesn't see; the second
fit uses the whole sample.

Scale: labels are counted by one aggregate; the sample's ids are broadcast (2 * sample longs). The rows of one id are brought
down to one text before the training task, which so reads 2 * sample rows at most whatever the input and however often its
ids are repeated. Scoring is one scan without a shuffle.

Defined cases: null and wordless texts have the score of the intercept; labels of null doc_id or value don't count; with no
label of either class every score is the share of toxic labels, 0 where there are none; of several labels of a document
the largest counts, of several texts the least; repeated rows are scored each; texts are read whole whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from stemma.llm import _text
from stemma.llm._spark import batch_of, cut

BITS = 20
SAMPLE = 6000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Params:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    passes: int = 3


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and hashed feature of every word, pair and skip pair; repeats included."""
    h, _, _, ranges = _text.words(*_text.buffers(texts), _text.ALNUM)
    doc = np.repeat(np.arange(len(texts)), np.diff(ranges))
    parts = [(doc, _text.mix(h))]
    for gap, seed in ((1, 0x1B873593), (2, 0xCC9E2D51)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append((doc[gap:][same], _text.mix(_text.mix(h[:-gap][same] + np.uint64(seed)) + h[gap:][same])))
    return np.concatenate([d for d, _ in parts]), (np.concatenate([g for _, g in parts]) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(doc: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc << BITS | f)
    return both >> BITS, both & ((1 << BITS) - 1)


def fit(examples: list[tuple[np.ndarray, int]], params: Params, bits: int = BITS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (features, label); weights and intercept."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    rate = lambda k: (params.beta + np.sqrt(k)) / params.alpha
    for _ in range(params.passes):
        for f, y in examples:
            own, seen = z[f], n[f]
            w = np.where(np.abs(own) <= params.l1, 0.0, (np.sign(own) * params.l1 - own) / (rate(seen) + params.l2))
            w0 = -z0 / (rate(n0) + params.l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -30, 30))) - y
            z[f] = own + g - (rate(seen + g * g) - rate(seen)) * w
            n[f] = seen + g * g
            z0 += g - (rate(n0 + g * g) - rate(n0)) * w0
            n0 += g * g
    w = np.where(np.abs(z) <= params.l1, 0.0, (np.sign(z) * params.l1 - z) / (rate(n) + params.l2))
    return w, float(-z0 / (rate(n0) + params.l2))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through held-back margins; a small ridge keeps them finite."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b])
        v = p * (1 - p)
        hess = np.array([[(v * margin * margin).sum() + 0.1, (v * margin).sum()], [(v * margin).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if 0 < a < 20 else (1.0, 0.0)  # a separable held-back part says nothing of the slope


_MODEL = pa.schema([("f", pa.int64()), ("w", pa.float64())])


def _train(params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            texts = batch.column(2)
            for a, b in _text.chunks(texts):
                doc, f = distinct(*features(texts.slice(a, b - a)))
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                rows += [(o, y, f[i:j].astype(np.int32)) for o, y, i, j in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), cuts[:-1], cuts[1:])]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        examples = [(f, y) for _, y, f in rows]
        back, front = examples[::5], [x for i, x in enumerate(examples) if i % 5]
        w, w0 = fit(front, params)
        margin = np.array([w[f].sum() + w0 for f, _ in back])
        slope, shift = calibrate(margin, np.array([y for _, y in back], float))
        w, w0 = fit(examples, params)
        at = np.flatnonzero(w)
        yield batch_of(_MODEL, {"f": np.append(at, -1), "w": np.append(w[at] * slope, w0 * slope + shift)})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, params: Params = Params()) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Both hold only what may be learnt from."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((bad + 1e-9) / (good + 1e-9))) if bad + good else -40.0)
    if not bad or not good:
        return none
    turn = F.xxhash64("doc_id")
    ids = own.where("toxic = 1").orderBy(turn).limit(sample).unionByName(own.where("toxic = 0").orderBy(turn).limit(sample))
    ids = cut(ids.select("doc_id", "toxic", turn.alias("turn")))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(ids), "doc_id").groupBy("turn", "toxic").agg(F.min("text").alias("text"))
    found = rows.repartition(1).mapInArrow(_train(params), "f long, w double").toPandas()
    if not len(found):
        return none
    shift = np.log(bad / good) - np.log(min(bad, sample) / min(good, sample))
    f, w = found["f"].to_numpy(), found["w"].to_numpy()
    return Model(f[f >= 0], w[f >= 0], float(w[f < 0][0] + shift))


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        weight = model.dense()
        for batch in batches:
            for a, b in _text.chunks(batch.column(1)):
                doc, f = features(batch.column(1).slice(a, b - a))
                on = weight[f] != 0
                doc, f = distinct(doc[on], f[on])
                margin = np.bincount(doc, weight[f], b - a) + model.intercept
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(margin, -700, 700)))), *(c.slice(a, b - a) for c in batch.columns[2:])], names=["doc_id", "score", *batch.schema.names[2:]])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and, as kept_NAME, the columns named in keep, for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[2:])] if keep else []
    return own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), ", ".join(["doc_id long", "score double", *fields]))
