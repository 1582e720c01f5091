"""Language-model scores by a hidden Markov model, next to a unigram base score.

Tokens are the words of a text (A-Z lower-cased) and one end token. The model's emissions are factored: the ``EMITTED`` most
frequent training words are symbols of their own; any other word is the symbol of its class, which its last bytes name, times
its smoothed share of the class, counted over all training tokens. So every state's emissions sum to one over all words,
unknown ones included, and no token is left out of a count or a score. Baum-Welch trains start, transition and emission
probabilities on whole training texts until a step raises the likelihood by less than ``TOLERANCE`` of it; scores come from
the scaled forward recursion over the whole sequence. States start from ``STATES`` training texts, drawn by hashed ids in
proportion to their length.

Expectations are those of the whole text: a text is cut into segments only to be computed side by side. The product of each
segment's moves and emissions (a matrix of states) is taken first; what comes before and after a segment is carried over the
cuts by these products, and the moves across cuts are counted.

Scale: words are counted by 64-bit hashes with map-side combine. The ``HEAD`` most frequent words' counts are broadcast (a
bound on words, not on the corpus); the other, rare words of each text are joined with the counts by a shuffle, which so
holds no hot key. Symbols are encoded once (two bytes a token). An expectation step gives one block of states * symbols
sums a partition, summed in a tree. A task holds some ``TOGETHER`` tokens, or one longer text.

Defined cases: null and wordless texts are the end token alone; repeated rows are scored each, and trained on each; an id
that is null is in fold 0; texts have any length; without training texts every count is 0 and all symbols are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from stemma.llm import _text
from stemma.llm._spark import batch_of, cut_columnar

STATES = 8
EMITTED = 1 << 15
CLASSES = 256
HEAD = 1 << 19
#: Tokens that are computed in a row, and in a task at a time.
SEGMENT = 1024
TOGETHER = 2_000_000
TOLERANCE = 5e-3
END = np.uint64(0x656E64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, and each text's range; an end token closes each text."""
    data, offsets = _text.buffers(texts)
    h, s, e, ranges = _text.words(data, offsets, _text.SPACED_LOWER)
    low = _text.SPACED_LOWER[data].astype(np.uint64)
    tail = np.zeros(len(h), np.uint64)
    for back in (1, 2, 3):
        at = e - back
        tail = tail * np.uint64(256) + np.where(at >= s, low[np.maximum(at, 0)] if len(low) else 0, 0).astype(np.uint64)
    kind = (_text.mix(tail) % np.uint64(CLASSES)).astype(np.int64)
    ends = ranges[1:]
    return np.insert(h, ends, END), np.insert(kind, ends, 0), ranges + np.arange(len(ranges))


_COUNT = pa.schema([("h", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a run of texts; many rows of one word in one partition only if its words don't fit."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
        one, first, back = np.unique(h, return_index=True, return_inverse=True)
        return one, kind[first], np.bincount(back, n).astype(np.int64)

    def out(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, kind, n = found
        for a in range(0, len(h), 100_000):
            yield batch_of(_COUNT, {"h": h[a : a + 100_000].view(np.int64), "kind": kind[a : a + 100_000].astype(np.int32), "n": n[a : a + 100_000]})

    size = 0
    for batch in batches:
        for a, b in _text.chunks(batch.column(0)):
            h, kind, _ = tokens(batch.column(0).slice(a, b - a))
            one, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((one, kind[first], n))
            size += len(one)
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield from out(held[0])
                    held, size = [], 0
    if held:
        yield from out(merged())


@dataclass
class Vocabulary:
    """The most frequent words and what the rest adds up to."""

    total: int
    distinct: int
    #: By hash: count and symbol (-1: its class's).
    head: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    #: By class, without the words that are symbols: tokens and distinct words.
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def base_room(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def unigram(self) -> np.ndarray:
        """Training tokens of each symbol."""
        own = self.symbol >= 0
        return np.append(np.bincount(self.symbol[own], self.count[own], EMITTED), self.class_total)

    @property
    def class_room(self) -> np.ndarray:
        return self.class_total + 0.5 * (self.class_distinct + 1)


def vocabulary(counts: DataFrame, most: int = HEAD) -> Vocabulary:
    """counts: h, kind, n. Words at least as frequent as the least bound that leaves ``most`` of them."""
    size = F.floor(F.log2("n") * 8)
    bins = {r["b"]: r["k"] for r in counts.groupBy(size.alias("b")).agg(F.count("*").alias("k")).collect()}  # at most 8 * 64
    bound, left = 1 << 20, most
    for b in sorted(bins, reverse=True):
        if bins[b] > left:
            break
        bound, left = b, left - bins[b]
    rows = counts.where(size >= bound).select("h", "n", "kind").toArrow().sort_by([("n", "descending"), ("h", "ascending")])  # without a Python object a row
    by_kind = {r["kind"]: (r["t"], r["d"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("t"), F.count("*").alias("d")).collect()}  # at most CLASSES
    class_total, class_distinct = (np.array([by_kind.get(k, (0, 0))[i] for k in range(CLASSES)], np.int64) for i in (0, 1))
    total, distinct = int(class_total.sum()), int(class_distinct.sum())
    h, n, kind = (rows[c].to_numpy() for c in ("h", "n", "kind"))
    h, kind = h.view(np.uint64), kind.astype(np.int64)
    symbol = np.full(len(h), -1, np.int32)
    symbol[:EMITTED] = np.arange(min(EMITTED, len(h)))
    class_total -= np.bincount(kind[:EMITTED], n[:EMITTED], CLASSES).astype(np.int64)
    class_distinct -= np.bincount(kind[:EMITTED], minlength=CLASSES)
    order = np.argsort(h)
    return Vocabulary(total, distinct, h[order], n[order], symbol[order], class_total, class_distinct)


_CODED = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("share", pa.float64()), ("rare", pa.list_(pa.int64())), ("rare_n", pa.list_(pa.int64())), ("rare_kind", pa.list_(pa.int64()))])
_CODED_SQL = "id long, doc_id long, held_out boolean, symbols binary, n_tokens long, n_known long, base double, share double, rare array<long>, rare_n array<long>, rare_kind array<long>"


def _encode(shared: Broadcast):
    """Symbols of each text, what its frequent words add to the scores, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        log_base = np.log10((v.count + 0.5) / v.base_room)
        room = v.class_room
        for batch in batches:
            for a, b in _text.chunks(batch.column(3)):
                h, kind, ranges = tokens(batch.column(3).slice(a, b - a))
                n = np.diff(ranges)
                doc = np.repeat(np.arange(b - a), n)
                at = np.searchsorted(v.head, h)
                at[at == len(v.head)] = 0
                known = v.head[at] == h if len(v.head) else np.zeros(len(h), bool)
                symbol = np.where(known, v.symbol[at] if len(v.head) else -1, -1)
                own_class = symbol < 0
                symbol = np.where(own_class, EMITTED + kind, symbol).astype("<u2")
                base = np.where(known, log_base[at] if len(v.head) else 0, 0)
                share = np.where(known & own_class, np.log10((v.count[at] + 0.5) / room[kind]) if len(v.head) else 0, 0)
                per = lambda x: np.bincount(doc, x, b - a)
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], doc[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order)))
                cuts = np.searchsorted(doc[order[first]], np.arange(b - a + 1))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64()))
                raw = symbol.tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array([raw[2 * i : 2 * j] for i, j in zip(ranges, ranges[1:])], pa.binary()), pa.array(n, pa.int64()), pa.array(per(known).astype(np.int64)), pa.array(per(base)), pa.array(per(share)), lists(h[order[first]].view(np.int64)), lists(times), lists(kind[order[first]])], schema=_CODED)

    return run


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state


def initial(unigram: np.ndarray, seeds: list[np.ndarray], states: int = STATES, stay: float = 0.99) -> Hmm:
    """States that keep to themselves, each halfway between all texts and one seed text; where seeds are few, a shifted mixture.

    seeds: symbol counts.
    """
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    r = np.random.default_rng(7)
    own = [x / x.sum() for x in seeds[:states]]
    own += [u / u.sum() for u in (unigram * (r.random(len(unigram)) + 0.5) for _ in range(states - len(own)))]
    move = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(move, stay if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, np.stack([0.5 * x + 0.5 * unigram for x in own], 1))


def transfer(model: Hmm, symbols: np.ndarray, mask: np.ndarray, is_first: np.ndarray) -> np.ndarray:
    """Each padded segment's product of moves and emissions, up to a factor: (segment, state before it, state at its end)."""
    k, states = symbols.shape[1], len(model.start)
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    emit /= emit.max(1, keepdims=True)
    now = np.where(is_first[:, None, None], np.eye(states, dtype=np.float32), move) * emit[symbols[0]][:, None, :]
    whole = mask.all(1)
    for t in range(1, len(symbols)):
        step = (now.reshape(-1, states) @ move).reshape(k, states, states)
        step *= emit[symbols[t]][:, None, :]
        now = step if whole[t] else np.where(mask[t][:, None, None], step, now)
        if t % 4 == 0:
            now /= now.sum((1, 2), keepdims=True)
    return now / now.sum((1, 2), keepdims=True)


def expect(model: Hmm, symbols: np.ndarray, mask: np.ndarray, is_first: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of padded segments (time, segment), and their log10 likelihood given what is before.

    before: probabilities of the states at the end of the segment before, for those that aren't first; after: of what follows
    given the state at the segment's end, up to a factor. In single precision within a segment, sums in double.
    """
    t_most, k = symbols.shape
    states, exact = len(model.start), np.float32
    move, back = model.move.astype(exact), np.ascontiguousarray(model.move.T, exact)
    e = model.emit.astype(exact)[symbols]
    e[~mask] = 1.0
    alpha, scale = np.empty((t_most, k, states), exact), np.empty((t_most, k, 1), exact)
    one = np.ones((states, 1), exact)
    now = (np.where(is_first[:, None], model.start, before @ model.move) * e[0]).astype(exact)
    for t in range(t_most):
        if t:
            np.matmul(alpha[t - 1], move, out=now)
            now *= e[t]
        np.matmul(now, one, out=scale[t])
        np.divide(now, scale[t], out=alpha[t])
    last = alpha[mask.sum(0) - 1, np.arange(k)]
    after = (after / (last * after).sum(1, keepdims=True)).astype(exact)
    e /= scale  # from here on each emission over its scale
    beta, ahead = np.empty_like(alpha), np.zeros_like(alpha)
    beta[-1] = after
    whole = mask.all(1)
    for t in range(t_most - 2, -1, -1):
        np.multiply(e[t + 1], beta[t + 1], out=ahead[t])
        np.matmul(ahead[t], back, out=beta[t])
        if not whole[t + 1]:
            ended = ~mask[t + 1]
            ahead[t][ended], beta[t][ended] = 0, after[ended]
    moves = (alpha[:-1].reshape(-1, states).T @ ahead[:-1].reshape(-1, states)).astype(float)
    moves += before[~is_first].T @ (e[0] * beta[0])[~is_first]
    beta *= alpha
    beta *= mask[:, :, None]
    flat, weight = symbols.ravel(), beta.reshape(-1, states)
    emits = np.stack([np.bincount(flat, weight[:, s], len(model.emit)) for s in range(states)], 1)
    return beta[0][is_first].sum(0, dtype=float), moves * model.move, emits, float(np.log10(scale[:, :, 0].astype(float))[mask].sum())


def _padded(segments: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of segments of like length, their symbols (time, segment) and which of these are theirs."""
    order = np.argsort([-len(x) for x in segments], kind="stable")
    for at in range(0, len(order), size):
        own = order[at : at + size]
        n = np.array([len(segments[i]) for i in own])
        out = np.zeros((n[0], len(own)), np.int64)
        for j, i in enumerate(own):
            out[: n[j], j] = segments[i]
        yield own, out, np.arange(n[0])[:, None] < n


def expect_texts(model: Hmm, texts: list[np.ndarray], size: int = 256) -> np.ndarray:
    """Expected starts, moves, emissions and the log10 likelihood of whole texts, in one row."""
    k = len(model.start)
    segments = [x[a : a + SEGMENT] for x in texts for a in range(0, len(x), SEGMENT)]
    text = np.repeat(np.arange(len(texts)), [-(-len(x) // SEGMENT) for x in texts])
    is_first = np.ones(len(text), bool)
    is_first[1:] = text[1:] != text[:-1]
    before, after = np.zeros((len(text), k)), np.ones((len(text), k))
    cut = np.flatnonzero(~is_first)  # with the segment before each, what has a neighbour
    joined = np.unique(np.concatenate([cut, cut - 1]))
    if len(joined):
        product = np.empty((len(text), k, k))
        for own, symbols, mask in _padded([segments[i] for i in joined], size):
            product[joined[own]] = transfer(model, symbols, mask, is_first[joined[own]])
        for i in cut.tolist():
            v = (model.start if is_first[i - 1] else before[i - 1]) @ product[i - 1]
            before[i] = v / v.sum()
        for i in cut[::-1].tolist():
            v = product[i] @ after[i]
            after[i - 1] = v / v.sum()
    total = np.zeros(k + k * k + model.emit.size + 1)
    for own, symbols, mask in _padded(segments, size):
        starts, moves, emits, likely = expect(model, symbols, mask, is_first[own], before[own], after[own])
        total += np.concatenate([starts, moves.ravel(), emits.ravel(), [likely]])
    return total


def maximise(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, floor: float = 0.01) -> Hmm:
    """New probabilities; a small count for each keeps unseen events possible."""
    starts, moves = starts + 1.0, moves + 1.0
    emits = emits + floor
    return Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


_SUMS = pa.schema([("sums", pa.binary())])


def _expect(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value
        k = len(model.start)
        total = np.zeros(k + k * k + model.emit.size + 1)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_py(), "<u2"))
                size += len(held[-1])
                if size >= TOGETHER:
                    total += expect_texts(model, held)
                    held, size = [], 0
        if held:
            total += expect_texts(model, held)
        yield batch_of(_SUMS, {"sums": [total.tobytes()]})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            own = np.frombuffer(x.as_py())
            total = own.copy() if total is None else total + own
    if total is not None:
        yield batch_of(_SUMS, {"sums": [total.tobytes()]})


def train(symbols: DataFrame, model: Hmm, tolerance: float = TOLERANCE) -> tuple[Hmm, list[float]]:
    """Baum-Welch over a column of encoded texts; the model and the log10 likelihood before each step."""
    k, seen = len(model.start), []
    while len(seen) < 2 or seen[-1] - seen[-2] >= tolerance * abs(seen[-1]):
        shared = symbols.sparkSession.sparkContext.broadcast(model)
        sums = symbols.mapInArrow(_expect(shared), "sums binary").repartition(32).mapInArrow(_add, "sums binary")
        rows = sums.repartition(1).mapInArrow(_add, "sums binary").collect()  # one row
        total = sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(k + k * k + model.emit.size + 1))
        seen.append(float(total[-1]))
        model = maximise(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : -1].reshape(-1, k))
        shared.unpersist()
        if not total[-1]:  # no texts
            break
    return model, seen


_TALLY = pa.schema([("turn", pa.float64()), ("id", pa.int64()), ("symbol", pa.int32()), ("n", pa.int64())])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            symbol, n = np.unique(np.frombuffer(row["symbols"], "<u2"), return_counts=True)
            yield batch_of(_TALLY, {"turn": [row["turn"]] * len(n), "id": [row["id"]] * len(n), "symbol": symbol.astype(np.int32), "n": n})


def seeds_of(learnt: DataFrame, states: int = STATES) -> list[np.ndarray]:
    """Symbol counts of some texts; learnt: id, doc_id, n_tokens, symbols. At most states * symbols rows reach the driver."""
    u = (F.pmod(F.xxhash64("doc_id", "id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = learnt.select("id", "symbols", (-F.log(u) / F.col("n_tokens")).alias("turn")).orderBy("turn", "id").limit(states)
    out: dict[tuple, np.ndarray] = {}
    for r in drawn.mapInArrow(_tally, "turn double, id long, symbol int, n long").collect():
        out.setdefault((r["turn"], r["id"]), np.zeros(EMITTED + CLASSES))[r["symbol"]] = r["n"]
    return [out[k] for k in sorted(out)]


def likelihood(model: Hmm, texts: list[np.ndarray], together: int = 1024) -> np.ndarray:
    """log10 probability of each symbol sequence by the scaled forward recursion."""
    out = np.zeros(len(texts))
    order = np.argsort([-len(x) for x in texts], kind="stable")
    for a in range(0, len(order), together):
        own = order[a : a + together]
        n = np.array([len(texts[i]) for i in own])
        flat = np.concatenate([texts[i] for i in own]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        live = len(own)
        now = model.start * model.emit[flat[first]]
        product, score = np.ones(len(own)), np.zeros(len(own))
        for t in range(int(n[0]) if len(n) else 0):
            while live and n[live - 1] <= t:
                live -= 1
            if t:
                now = (now[:live] @ model.move) * model.emit[flat[first[:live] + t]]
            scale = now.sum(1)
            now = now / scale[:, None]
            product[:live] *= scale
            if t % 16 == 15:
                score += np.log10(product)
                product[:] = 1.0
        out[own] = score + np.log10(product)
    return out


_SCORED = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _score(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_py(), "<u2") for x in batch.column("symbols")]
            score = likelihood(shared.value, texts) + batch.column("share").to_numpy()
            yield batch_of(_SCORED, {f.name: score if f.name == "score" else batch.column(f.name) for f in _SCORED})

    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; trains on rows not held out.

    docs: doc_id, text; held_out: a boolean column over docs.
    """
    spark = docs.sparkSession
    own = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = own.where("NOT held_out").select("text").mapInArrow(_count, "h long, kind int, n long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    counts = cut_columnar(counts)
    v = vocabulary(counts)
    coded = cut_columnar(own.mapInArrow(_encode(spark.sparkContext.broadcast(v)), _CODED_SQL))
    learnt = coded.where("NOT held_out")
    model, _ = train(learnt.select("symbols"), initial(v.unigram(), seeds_of(learnt)))
    shared = spark.sparkContext.broadcast(model)
    frequent = coded.drop("rare", "rare_n", "rare_kind").mapInArrow(_score(shared), "id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = coded.select("id", F.explode(F.arrays_zip("rare", "rare_n", "rare_kind")).alias("r")).select("id", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("times"), F.col("r.rare_kind").alias("kind"))
    rare = rare.join(counts.select("h", "n"), "h", "left")
    room = F.array(*[F.lit(float(x)) for x in v.class_room])
    c = F.coalesce("n", F.lit(0)) + 0.5
    rare = rare.groupBy("id").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(c / v.base_room)).alias("rare_base"),
        F.sum(F.col("times") * F.log10(c / F.element_at(room, F.col("kind").cast("int") + 1))).alias("rare_share"),
    )
    zero = F.lit(0.0)
    return frequent.join(rare, "id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("rare_share", zero)).alias("score"),
    )
