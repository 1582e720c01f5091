"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is the set of its five-word shingles (a text of one to four words is one shingle), each of weight one however often
it occurs, as links are defined by sets. Each shingle is a Poisson process whose rate is its weight; arrivals fall on
uniformly random registers, a register keeps the shingle that arrives first, and a process ends once its next arrival comes
after the latest register. Two texts agree in a register with the probability Jaccard similarity of their weighted sets,
which is the Jaccard similarity at equal weights.

Equal texts are one node, known by 128 bits of hash. Registers are banded: texts of similarity 0.8 share no bucket with
probability 1.5e-5, less above. A link is a Jaccard similarity of 0.8 or more of two whole texts' sets of shingles.

First round: within a bucket, members are compared by one-bit sketches with leaders: the member nearest to the bucket's
majority sketch first, then members that were near to fewer than two leaders and very near to none. A leader is paired with
the near members that still lack one and with the two nearest others, so a bucket of n texts gives at most 4 * n candidates;
in buckets of up to eight members all near pairs are candidates. Candidates are verified on both whole texts and closed to
classes. Second round, the exact way for what leaders left out: in every larger bucket whose members are in different classes,
all members that are near to one of another class meet with their whole sets of shingles, and the exact similarity of every
such pair is counted in place, by an index of the bucket's shingles. No row is made for a pair that is no link, and one link
of each two classes is enough. Near is a sketch distance that a pair of similarity 0.8 exceeds with probability 2.8e-7.

Scale: no group is collected into one row. Texts of the same input batch with the same shingles are linked before the shuffle
and only the first goes on, which has the same bands; texts that differ all go on. In the first round a bucket streams through
its task in blocks; memory is one block and the leaders so far. In the second round buckets of more than ``ROUND`` members or
``CELL`` shingles are dealt in blocks, and every two blocks meet in a task of their own. Texts are hashed once, shuffled once
and only if they are in a candidate pair or large bucket. Components run by label propagation with hooking and pointer
jumping over the links, a checkpoint a round.

Defined cases: null and wordless texts are classes of their own; repeated rows and copies share a class; the class id is
the smallest doc_id in it (null where all are null); texts have any length; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stemma.llm import _text
from stemma.llm._spark import batch_of, cut, cut_columnar

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 5
_M = BANDS * ROWS
#: Registers of which a sketch keeps one bit each.
_BITS = 128
#: Estimated similarity of near texts (5.7 standard deviations below 0.8), and of texts that need no other leader.
NEAR = 0.5
VERY_NEAR = 0.92
LEADERS = 2
SMALL = 8
BLOCK = 50_000
#: Second round: members and shingles of a block.
ROUND = 8_000
CELL = 4_000_000


def shingles(h: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle, by text and hash."""
    n_words = np.diff(ranges)
    g, ok = _text.grams(h, ranges, SHINGLE)
    at = np.flatnonzero(ok)
    doc = np.searchsorted(ranges, at, "right") - 1
    g = g[at]
    for n in range(1, SHINGLE):  # short texts
        few = np.flatnonzero(n_words == n)
        if len(few):
            own, _ = _text.grams(h, ranges, n)
            doc, g = np.concatenate([doc, few]), np.concatenate([g, own[ranges[few]]])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], g[first], np.diff(np.append(first, len(g)))


def registers(doc: np.ndarray, g: np.ndarray, weight: np.ndarray, n_docs: int, m: int = _M) -> np.ndarray:
    """ProbMinHash: for each text, the shingle hash that first arrived at each register. weight: counts."""
    first = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, np.uint64)
    time = np.zeros(len(g))
    doc = doc.astype(np.int64)
    state = g.copy()
    w = 1 + np.log10(weight)
    scale = 2.0**-53
    while len(g):
        state = _text.mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * scale) / w
        at = doc * m + (_text.mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(time < first[at])
        order = better[np.argsort(-time[better])]  # the earliest is written last
        first[at[order]] = time[order]
        owner[at[order]] = g[order]
        go = time < first.reshape(n_docs, m).max(1)[doc]
        doc, g, w, time, state = doc[go], g[go], w[go], time[go], state[go]
    return owner.reshape(n_docs, m)


_SIGNED = pa.schema([("key", pa.int64()), ("bands", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64()), ("led_by", pa.list_(pa.int64()))])
_SIGNED_SQL = "key long, bands array<long>, s0 long, s1 long, led_by array<long>"


def sign(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a text has words; the others' bands, sketches and 64 bits of their sets of shingles."""
    h, _, _, ranges = _text.words(*_text.buffers(texts), _text.ALNUM)
    doc, g, _ = shingles(h, ranges)
    own = registers(doc, g, np.ones(len(g)), len(texts))
    whole = np.zeros(len(texts), np.uint64)
    np.add.at(whole, doc, _text.mix(g))
    bands = np.zeros((len(texts), BANDS), np.uint64)
    for k in range(ROWS):
        bands = _text.mix(bands + own[:, k::ROWS] + np.uint64(k + 1))
    bands = _text.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    sketch = np.packbits((_text.mix(own[:, :_BITS]) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    full = np.diff(ranges) > 0
    return full, bands[full], sketch[full], whole[full]


def _far(similarity: float) -> int:
    """Differing bits of two sketches at this similarity."""
    return int((1 - similarity) / 2 * _BITS)


def _distance(sketch: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count((sketch ^ one).view(np.uint64)).sum(1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        order, fresh = np.unique(keys, return_index=True)  # copies within the batch
        if len(fresh) < len(keys):
            keys, texts = keys[np.sort(fresh)], texts.take(pa.array(np.sort(fresh)))
        parts = [(keys[a:b], *sign(texts.slice(a, b - a))) for a, b in _text.chunks(texts, 1 << 20)]
        if not parts:
            continue
        keys = np.concatenate([p[0][p[1]] for p in parts])
        bands, sketch = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        _, first, same = np.unique(np.concatenate([p[4] for p in parts]), return_index=True, return_inverse=True)
        leader = first[same]  # the first text of the batch with the same shingles, so of the same bands
        led = leader != np.arange(len(keys))
        rows = [b[:0] if gone else b for b, gone in zip(bands, led)]
        led_by = [[int(keys[i])] if gone else [] for i, gone in zip(leader, led)]
        for a in range(0, len(keys), 2000):
            yield batch_of(_SIGNED, {"key": keys[a : a + 2000], "bands": rows[a : a + 2000], "s0": sketch[a : a + 2000, 0], "s1": sketch[a : a + 2000, 1], "led_by": led_by[a : a + 2000]})


class Bucket:
    """Leaders of one bucket, block after block."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.sketch = np.zeros((0, _BITS // 64), np.int64)

    def pairs(self, keys: np.ndarray, sketch: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates among the block's members and earlier leaders; alone: no other block."""
        most = len(keys) if alone and len(keys) <= SMALL else LEADERS
        bits = np.unpackbits(sketch.view(np.uint8), axis=1, bitorder="little")
        middle = np.packbits(bits.mean(0) > 0.5, bitorder="little").view(np.int64)
        order = np.argsort(_text.mix(keys.view(np.uint64)), kind="stable")  # the same members lead in every band
        first = order == order[np.argmin(_distance(sketch[order], middle))]
        order = np.concatenate([order[first], order[~first]])
        keys, sketch = keys[order], sketch[order]
        times, done = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for one, s in zip(self.keys.tolist(), self.sketch):
            d = _distance(sketch, s)
            near = (d <= _far(NEAR)) & (times < most)
            if near.any():
                yield np.full(int(near.sum()), one), keys[near]
                times += near
                done |= d <= _far(VERY_NEAR)
        chosen = []
        for i in range(len(keys)):
            if done[i] or times[i] >= most:
                continue
            chosen.append(i)
            d = _distance(sketch[i + 1 :], sketch[i]) if most > LEADERS else _distance(sketch, sketch[i])
            near = d <= _far(NEAR)
            if most > LEADERS:
                if near.any():
                    yield np.full(int(near.sum()), keys[i]), keys[i + 1 :][near]
                continue
            near[i] = False
            if near.any():
                to = near & (times < most)
                close = np.flatnonzero(near & ~to)
                to[close[np.argsort(d[close], kind="stable")[:most]]] = True  # and the nearest of those that have enough
                yield np.full(int(to.sum()), keys[i]), keys[to]
                times += to
                done |= d <= _far(VERY_NEAR)
        self.keys, self.sketch = np.append(self.keys, keys[chosen]), np.concatenate([self.sketch, sketch[chosen]])


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _found(batches: Iterator[pa.RecordBatch], large: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """batches: band, key, sketch words, sorted by band. The rows of buckets of more than SMALL members are put into large."""
    held: list[np.ndarray] = []  # of the last bucket seen
    n_held, bucket = 0, None

    def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal held, n_held, bucket
        if held and (n_held > 1 or bucket):
            rows = np.concatenate(held)
            alone = bucket is None
            if not alone or len(rows) > SMALL:
                large.append(rows)
            yield from (bucket or Bucket()).pairs(rows[:, 1], np.ascontiguousarray(rows[:, 2:]), alone)
        held, n_held, bucket = [], 0, None

    def taken(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal held, n_held, bucket
        cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        starts, stops = np.append(0, cuts), np.append(cuts, len(rows))
        if held and held[-1][-1, 0] != rows[0, 0]:
            yield from close()
        first, last = rows[: stops[0]], rows[starts[-1] :]
        held.append(first)
        n_held += len(first)
        if len(starts) > 1:
            yield from close()
            sizes = (stops - starts)[1:-1]
            inner = starts[1:-1]
            two = inner[sizes == 2]
            d = np.bitwise_count((rows[two, 2:] ^ rows[two + 1, 2:]).view(np.uint64)).sum(1) <= _far(NEAR)
            yield rows[two[d], 1], rows[two[d] + 1, 1]
            for a, n in zip(inner[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = Bucket()
                if n > SMALL:
                    large.append(rows[a : a + n])
                for at in range(a, a + n, BLOCK):
                    part = rows[at : min(a + n, at + BLOCK)]
                    yield from own.pairs(part[:, 1], np.ascontiguousarray(part[:, 2:]), n <= BLOCK)
            held, n_held = [last], len(last)
        if n_held >= BLOCK:
            bucket = bucket or Bucket()
            rows = np.concatenate(held)
            large.append(rows)
            yield from bucket.pairs(rows[:, 1], np.ascontiguousarray(rows[:, 2:]), False)
            held, n_held = [rows[-1:]], 0

    def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *found, strict=True))
        return batch_of(_PAIR, {"a": np.minimum(a, b), "b": np.maximum(a, b)})

    for batch in batches:
        if batch.num_rows:
            yield out(taken(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)))
    yield out(close())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _found(batches, [])


_ROUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("band", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])
_ROUND_SQL = "a long, b long, band long, s0 long, s1 long"


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates a, b, and the members a of large buckets with band and sketch and without b."""
    large: list[np.ndarray] = []
    for pairs in _found(batches, large):
        n = pairs.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([*pairs.columns, *[pa.nulls(n, pa.int64())] * 3], schema=_ROUND)
        for rows in large:
            band, key, s0, s1 = (pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4))
            yield pa.RecordBatch.from_arrays([key, pa.nulls(len(rows), pa.int64()), band, s0, s1], schema=_ROUND)
        large.clear()


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal values in the first ``width`` columns; rows are sorted by these."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            own = tuple(key[lo].tolist())
            if held and own != last:
                yield held
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = own
    if held:
        yield held


def _column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])


def _others(head: np.ndarray, block: np.ndarray, x: int, y: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member and those of other classes that it is to be compared with, every pair once; between two blocks, only across."""
    _, group, size = np.unique(head, return_inverse=True, return_counts=True)
    order = np.lexsort((group, size[group]))
    stops = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(group))
    for at, i in enumerate(order[: stops[-2] if len(stops) > 1 else 0].tolist()):
        after = order[stops[np.searchsorted(stops, at, "right")] :]
        yield i, after if x == y else after[block[after] != block[i]]


_PLACE = [("band", pa.int64()), ("x", pa.int32()), ("y", pa.int32())]
_INVOLVED = pa.schema([*_PLACE, ("key", pa.int64()), ("head", pa.int64()), ("block", pa.int32())])
_INVOLVED_SQL = "band long, x int, y int, key long, head long, block int"


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a bucket, or of two blocks of it, that are near to one of another class."""
    for parts in _groups(batches, 3):
        key, head, block = (_column(parts, c) for c in ("key", "head", "block"))
        sketch = np.stack([_column(parts, "s0"), _column(parts, "s1")], 1)
        x, y = parts[0].column("x")[0].as_py(), parts[0].column("y")[0].as_py()
        on = np.zeros(len(key), bool)
        for i, after in _others(head, block, x, y):
            near = _distance(sketch[after], sketch[i]) <= _far(NEAR)
            on[after[near]] = True
            on[i] |= near.any()
        n = int(on.sum())
        if n:
            place = {k: parts[0].column(k).slice(0, 1).take(pa.array(np.zeros(n, np.int64))) for k in ("band", "x", "y")}
            yield batch_of(_INVOLVED, place | {"key": key[on], "head": head[on], "block": block[on]})


_SETS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in _text.chunks(batch.column(1), 1 << 20):
            own = batch.column(1).slice(lo, hi - lo)
            h, _, _, ranges = _text.words(*_text.buffers(own), _text.ALNUM)
            doc, g, _ = shingles(h, ranges)
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield batch_of(_SETS, {"key": batch.column(0).slice(lo, hi - lo), "n": np.diff(cuts), "shingles": [g[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]})


_BETWEEN = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("head_a", pa.int64()), ("head_b", pa.int64())])
_BETWEEN_SQL = "a long, b long, head_a long, head_b long"


def between(key: np.ndarray, head: np.ndarray, block: np.ndarray, sets: list[np.ndarray], x: int = 0, y: int = 0) -> list[tuple[int, int, int, int]]:
    """One link for every two classes that have one here: keys and heads, by exact similarity."""
    size = np.array([len(v) for v in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, name, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[name] > 1
    name, owner = name[shared], owner[shared]
    by_name = np.argsort(name, kind="stable")
    posted = owner[by_name]  # members of a shingle stand together
    start = np.searchsorted(name[by_name], np.arange(len(times) + 1))
    first = np.searchsorted(owner, np.arange(len(sets) + 1))
    out, seen = [], set()
    for i, after in _others(head, block, x, y):
        if not len(after):
            continue
        own = name[first[i] : first[i + 1]]
        n = start[own + 1] - start[own]
        if not len(n):
            continue
        upto = np.cumsum(n)
        at = np.arange(upto[-1]) + np.repeat(start[own] - (upto - n), n)
        common = np.bincount(posted[at], minlength=len(sets))[after]
        for j in after[common >= SIMILARITY * (size[i] + size[after] - common)].tolist():
            ends = int(min(head[i], head[j])), int(max(head[i], head[j]))
            if ends not in seen:
                seen.add(ends)
                out.append((int(key[i]), int(key[j]), int(head[i]), int(head[j])))
    return out


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _groups(batches, 3):
        sets = [np.frombuffer(v, np.uint64) for p in parts for v in p.column("shingles").to_pylist()]
        x, y = parts[0].column("x")[0].as_py(), parts[0].column("y")[0].as_py()
        found = between(*(_column(parts, c) for c in ("key", "head", "block")), sets, x, y)
        if found:
            yield batch_of(_BETWEEN, dict(zip(_BETWEEN.names, zip(*found))))


def similar(x: pa.Array, y: pa.Array) -> np.ndarray:
    """The Jaccard similarity of each pair of texts' sets of shingles."""
    out = np.zeros(len(x))
    both = []
    for column in (x, y):
        h, _, _, ranges = _text.words(*_text.buffers(column), _text.ALNUM)
        doc, g, _ = shingles(h, ranges)
        both.append((np.searchsorted(doc, np.arange(len(x) + 1)), g))
    (ra, ga), (rb, gb) = both
    for i in range(len(x)):
        a, b = ga[ra[i] : ra[i + 1]], gb[rb[i] : rb[i + 1]]
        common = len(np.intersect1d(a, b, assume_unique=True))
        if common:
            out[i] = common / (len(a) + len(b) - common)
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        size = np.diff(_text.buffers(x)[1]) + np.diff(_text.buffers(y)[1])
        at = np.flatnonzero(np.diff(np.cumsum(size) >> 20)) + 1
        for lo, hi in zip(np.append(0, at), np.append(at, batch.num_rows)):
            if hi > lo:
                lo, hi = int(lo), int(hi)
                yield batch_of(_LINK, {"a": batch.column(0).slice(lo, hi - lo), "b": batch.column(1).slice(lo, hi - lo), "similarity": similar(x.slice(lo, hi - lo), y.slice(lo, hi - lo))})


def components(links: DataFrame) -> DataFrame:
    """node, head (the smallest node joined to it) for every node of a link. Labels only fall, so the rounds end."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    heads = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("head")))
    while True:
        near = both.join(heads.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("head").alias("low"))
        low = heads.join(near, "node").select("node", "head", F.least("head", "low").alias("low"))
        hooked = low.groupBy(F.col("head").alias("node")).agg(F.min("low").alias("found"))
        top = heads.select(F.col("node").alias("low"), F.col("head").alias("top"))
        step = low.join(top, "low", "left").join(hooked, "node", "left").select("node", F.col("head").alias("old"), F.least("low", "top", "found").alias("head"))
        step = cut(step)
        heads = step.select("node", "head")
        if not step.where("head < old").limit(1).count():
            return heads


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _check(text: Column) -> Column:
    """Other 64 bits, which tell apart texts of one key."""
    return F.xxhash64(F.lit(0x7E57), text)


def _candidate_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of the first round; band, key and sketch words of the members of large buckets."""
    signed = cut_columnar(texts.select("key", "text").mapInArrow(_sign, _SIGNED_SQL))
    local = signed.select(F.col("key").alias("x"), F.explode("led_by").alias("y"))
    rows = signed.select(F.explode("bands").alias("band"), "key", "s0", "s1")
    shared = cut_columnar(rows.repartition("band").sortWithinPartitions("band", "key").mapInArrow(_first_round, _ROUND_SQL))
    pairs = local.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(shared.where("b IS NOT NULL").select("a", "b")).where("a < b").distinct()
    return cut(pairs), shared.where("b IS NULL").select("band", F.col("a").alias("key"), "s0", "s1")


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of a band with their block and a copy for each two blocks x <= y that meet; sizes: band, blocks."""
    own = rows.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    return own.withColumn("cell", F.explode(pair)).select("band", "cell.x", "cell.y", *[c for c in rows.columns if c != "band"], "block")


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")


def _blocks(n: Column, most: int) -> Column:
    return F.greatest(F.ceil(n / most), F.lit(1)).cast("int")


def _left_out(large: DataFrame, heads: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links between classes within large buckets; large: band, key, sketch words; heads: node, head; wanted: key, text."""
    headed = large.join(heads.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("head", "key").alias("head"), "s0", "s1")
    headed = cut_columnar(headed)
    mixed = headed.groupBy("band").agg(F.count("*").alias("n"), F.min("head").alias("lo"), F.max("head").alias("hi")).where("lo < hi")
    near = _together(_dealt(headed, mixed.select("band", _blocks(F.col("n"), ROUND).alias("blocks")))).mapInArrow(_involved, _INVOLVED_SQL)
    near = cut_columnar(near.select("band", "key", "head").distinct())
    sets = cut_columnar(wanted.join(near.select("key").distinct(), "key").select("key", "text").mapInArrow(_sets, "key long, n long, shingles binary"))
    sizes = near.join(sets.select("key", "n"), "key").groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    dealt = _dealt(near, sizes.select("band", F.greatest(_blocks(F.col("k"), ROUND), _blocks(F.col("n"), CELL)).alias("blocks")))
    return _together(dealt.join(sets.drop("n"), "key").select("band", "x", "y", "key", "head", "block", "shingles")).mapInArrow(_between, _BETWEEN_SQL)


def heads_of(texts: DataFrame, lowest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, head of the first round's classes; node (such a head, or a text alone), head of those that the second round joins.

    texts: doc_id, key, text, where rows of one key have one text; lowest: key, lowest (its smallest doc_id). Texts are
    fetched by doc_id and key, so that copies of one text don't meet in one task.
    """
    pairs, large = _candidate_pairs(texts)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key")).distinct()
    ends = ends.join(lowest, "key").select("key", F.coalesce("lowest", F.lit(0)).alias("row"))
    found = texts.withColumn("row", F.coalesce("doc_id", F.lit(0))).join(ends, ["key", "row"], "left_semi")
    wanted = cut_columnar(found.groupBy("key").agg(F.min("text").alias("text")))
    one, two = (wanted.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    first = components(full.mapInArrow(_verify, "a long, b long, similarity double").where(F.col("similarity") >= SIMILARITY))
    if not large.limit(1).count():
        return first, first.limit(0)
    return first, components(_left_out(large, first, wanted).select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def _identified(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own with a key for each distinct text, and lowest (key, its smallest doc_id)."""

    def counted(rows: DataFrame) -> DataFrame:
        return cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("lowest"), F.min("check").alias("lo"), F.max("check").alias("hi")))

    lowest = counted(own)
    clashes = [r["key"] for r in lowest.where("lo <> hi").select("key").collect()]  # of n texts some n * n / 2 ** 65
    if clashes:
        own = own.withColumn("key", F.when(F.col("key").isin(clashes), F.xxhash64("check", "key")).otherwise(F.col("key")))
        lowest = counted(own)
    return own, lowest.select("key", "lowest")


def classes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id, class_key (null where wordless) and, as kept_NAME, the columns named in keep, for every row.

    docs: doc_id, text; others are ignored.
    """
    carried = [c for c in keep if c != "text" or docs.schema["text"].dataType.typeName() != "string"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{c}") for c in carried])
    worded = F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    own = cut_columnar(own.withColumns({"key": F.when(worded, _key(F.col("text"))), "check": _check(F.col("text"))}))
    own, lowest = _identified(own)
    first, second = heads_of(own.where("key IS NOT NULL").select("doc_id", "key", "text"), lowest)
    member = lowest.join(first.withColumnRenamed("node", "key"), "key", "left").select("key", "lowest", F.coalesce("head", "key").alias("node"))
    member = cut(member.join(second, "node", "left").select("key", "lowest", F.coalesce("head", "node").alias("class_key")))
    of_class = cut(member.groupBy("class_key").agg(F.min("lowest").alias("class_id")))  # cut, so that a hot class's join can be split
    table = cut_columnar(member.join(of_class, "class_key").select(F.col("key").alias("table_key"), "class_id", "class_key"))
    out = own.join(table, F.col("key") == F.col("table_key"), "left")
    kept = [F.col("text" if c == "text" and c not in carried else f"kept_{c}").alias(f"kept_{c}") for c in keep]
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_key", *kept)


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of docs, with all columns: of each class the one of the smallest doc_id; wordless texts all stay."""
    columns = docs.columns
    found = classes(docs, tuple(columns))
    heads = found.where(F.col("class_id").eqNullSafe(F.col("doc_id")))
    kept = heads.select(*[F.col(f"kept_{c}").alias(c) for c in columns], "class_key")
    copies = heads.where("class_key IS NOT NULL").groupBy("class_key").count().where("count > 1").limit(1).count()
    if copies:  # rows of one doc_id, or of none
        kept = kept.where("class_key IS NULL").unionByName(kept.where("class_key IS NOT NULL").dropDuplicates(["class_key"]))
    return kept.select(*columns)
