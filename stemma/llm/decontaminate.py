"""Benchmark decontamination by winnowing.

Every ten-word window of a benchmark item is fingerprinted by the smallest of its six 5-gram hashes (the rightmost on
ties). A document keeps the smallest 5-gram hash of each run of six, so any shared span of ten words shares a
fingerprint. Joined fingerprints are extended to the ten-word window around them, which is compared word by word.
Items of one to nine words are one window; their fingerprint is the hash of the whole item.

Scale: windows are made and counted in tasks; equal windows are one row with its items. Up to ``INDEX`` of them are broadcast
(some 100 bytes each) and the documents are scanned once, without a shuffle. Beyond, the documents are scanned once as well:
a bitmap of fixed size (``BITS`` bits, made in tasks) of the benchmark's fingerprints is broadcast, and the windows of
documents whose fingerprint is in it are joined with the benchmark's by a shuffle, by hash and all words; equal texts are
joined once. So neither the driver's memory nor the number of scans grows with the benchmark.

Defined cases: a null text has no words; an item without words never occurs; items of null id count in n_hit but not
in n_items; repeated items count once; repeated documents are each returned; texts have any length; an empty benchmark hits
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from stemma.llm import _text
from stemma.llm._spark import batch_of, cut_columnar

WINDOW = 10
GRAM = 5
RUN = WINDOW - GRAM + 1
#: Windows that are broadcast, and bits of the bitmap of fingerprints where there are more.
INDEX = 500_000
BITS = 1 << 28
_SEGMENT = 1 << 18


@dataclass
class Block:
    """Windows of some items. by_length: words in a window -> (sorted fingerprints, sorted window hashes, window words, window rows)."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: Window row -> its items are owners[start[row] : start[row + 1]].
    start: np.ndarray
    owners: np.ndarray
    ids: list


def _min_of_runs(g: np.ndarray) -> np.ndarray:
    """Position of the smallest hash, rightmost on ties, in each run of RUN."""
    n = len(g) - RUN + 1
    best = np.arange(RUN - 1, RUN - 1 + n)
    low = g[RUN - 1 : RUN - 1 + n].copy()
    for back in range(RUN - 2, -1, -1):
        other = g[back : back + n]
        less = other < low
        low[less] = other[less]
        best[less] = np.flatnonzero(less) + back
    return best


_WINDOW = pa.schema([("n", pa.int32()), ("full", pa.int64()), ("print", pa.int64()), ("words", pa.binary()), ("item", pa.string())])
_WINDOW_SQL = "n int, full long, print long, words binary, item string"


def prints_of(h: np.ndarray, ranges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and fingerprint of every window of n words."""
    g, ok = _text.grams(h, ranges, n)
    at = np.flatnonzero(ok)
    if n < WINDOW:
        return at, g[at], g[at]
    short, _ = _text.grams(h, ranges, GRAM)
    return at, g[at], short[_min_of_runs(short)[at]] if len(at) else g[at]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items; each of an item's windows once."""
    for batch in batches:
        items = batch.column(0).to_pylist()
        for a, b in _text.chunks(batch.column(1)):
            h, _, _, ranges = _text.words(*_text.buffers(batch.column(1).slice(a, b - a)), _text.ALNUM)
            size = np.diff(ranges)
            for n in np.unique(np.minimum(size, WINDOW)).tolist():
                if not n:
                    continue
                at, full, prints = prints_of(h, ranges, n)
                doc = np.searchsorted(ranges, at, "right") - 1
                own = (size[doc] == n) | (n == WINDOW)
                at, full, prints, doc = at[own], full[own], prints[own], doc[own]
                _, once = np.unique(np.stack([doc, full.view(np.int64)], 1), axis=0, return_index=True)
                for lo in range(0, len(once), 100_000):
                    k = once[lo : lo + 100_000]
                    words = h[at[k][:, None] + np.arange(n)]
                    yield batch_of(_WINDOW, {"n": np.full(len(k), n), "full": full[k].view(np.int64), "print": prints[k].view(np.int64), "words": [w.tobytes() for w in words], "item": [items[a + i] for i in doc[k].tolist()]})


def windows(benchmark: DataFrame) -> DataFrame:
    """n, full, print, words, items: the different windows of a benchmark with the ids (as strings) of their items."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return cut_columnar(own.mapInArrow(_windows, _WINDOW_SQL).groupBy("n", "full", "words").agg(F.first("print").alias("print"), F.array_sort(F.collect_set("item")).alias("items")))


def block_of(found: pa.Table) -> Block:
    """The index of a table of windows."""
    n, start, owners = found.column("n").to_numpy(), [0], []
    known: dict[str, int] = {}
    for items in found.column("items").to_pylist():
        owners += [known.setdefault(x, len(known)) for x in items]
        start.append(len(owners))
    full, prints = (found.column(c).to_numpy().view(np.uint64) for c in ("full", "print"))
    words = found.column("words").to_pylist()
    by_length = {}
    for size in np.unique(n).tolist():
        row = np.flatnonzero(n == size)
        row = row[np.argsort(full[row])]
        by_length[size] = (np.unique(prints[row]), full[row], np.frombuffer(b"".join(words[i] for i in row), np.uint64).reshape(-1, size), row)
    return Block(by_length, np.array(start), np.array(owners, np.int64), list(known))


def hits(block: Block, h: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and window row of every occurrence."""
    out = []
    for n, (prints, full, w, row) in block.by_length.items():
        g, ok = _text.grams(h, ranges, n)
        if not len(g):
            continue
        if n == WINDOW:
            short, _ = _text.grams(h, ranges, GRAM)
            chosen = np.unique(_min_of_runs(short)[ok])
            chosen = chosen[np.isin(short[chosen], prints)]
            at = np.unique((chosen[:, None] - np.arange(RUN)).ravel())
            at = at[(at >= 0) & (at < len(g))]
            at = at[ok[at]]
        else:
            at = np.flatnonzero(ok & np.isin(g, prints))
        place = np.searchsorted(full, g[at])
        place[place == len(full)] = 0
        same = full[place] == g[at] if len(full) else np.zeros(0, bool)
        at, place = at[same], place[same]
        same = (h[at[:, None] + np.arange(n)] == w[place]).all(1)
        out.append((at[same], np.full(int(same.sum()), n), row[place[same]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _covered(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(first + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])
_OUT_SQL = "doc_id long, n_words long, n_hit long, items array<string>, spans array<long>"


def _scan(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        names = np.array(block.ids, object)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for a, b in _text.chunks(texts):
                own = texts.slice(a, b - a)
                h, _, _, ranges = _text.words(*_text.buffers(own), _text.ALNUM)
                first, length, row = hits(block, h, ranges)
                on = _covered(first, length, len(h))
                n_hit = np.diff(np.concatenate([[0], np.cumsum(on)])[ranges])
                items: list[list[str]] = [[] for _ in range(b - a)]
                spans: list[list[int]] = [[] for _ in range(b - a)]
                if len(first):
                    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
                    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    doc = np.searchsorted(ranges, first, "right") - 1
                    pairs = np.unique(np.stack([doc, row], 1), axis=0)
                    for d, r in pairs.tolist():
                        items[d] += names[block.owners[block.start[r] : block.start[r + 1]]].tolist()
                    for d in np.unique(doc).tolist():
                        items[d] = sorted(set(items[d]))
                        lo, hi = ranges[d], ranges[d + 1]
                        k = np.flatnonzero((stops > lo) & (starts < hi))
                        spans[d] = [int(y) for i in k for y in (max(starts[i], lo) - lo, min(stops[i], hi) - lo)]
                yield batch_of(_OUT, {"doc_id": doc_ids.slice(a, b - a), "n_words": np.diff(ranges), "n_hit": n_hit, "items": items, "spans": spans})

    return run


_PLACE = pa.struct([("at", pa.int64()), ("n", pa.int32()), ("full", pa.int64()), ("words", pa.binary())])
_MARKED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("text_key", pa.binary()), ("places", pa.list_(_PLACE))])
_MARKED_SQL = "doc_id long, n_words long, text_key binary, places array<struct<at:long,n:int,full:long,words:binary>>"


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """Bits that the fingerprints' highest bits name; made a segment at a time in tasks, of fixed size on the driver."""
    shift = 64 - (bits.bit_length() - 1)
    bit = F.shiftrightunsigned("print", shift)
    rows = found.select(F.floor(bit / _SEGMENT).alias("segment"), (bit % _SEGMENT).cast("int").alias("bit")).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for x in np.unique(segment).tolist():
                own.setdefault(x, np.zeros(_SEGMENT, bool))[at[segment == x]] = True
        for x, mask in own.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([x], pa.int64()), "bits": pa.array([np.packbits(mask).tobytes()], pa.binary())})

    out = np.zeros(max(bits, _SEGMENT) // 8, np.uint8)
    for r in rows.repartition("segment").mapInArrow(packed, "segment long, bits binary").toLocalIterator():
        a = r["segment"] * (_SEGMENT // 8)
        out[a : a + _SEGMENT // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _mark(shared: Broadcast, lengths: list[int], bits: int):
    """Places of a text whose fingerprint may be the benchmark's; texts with any have a key."""
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b in _text.chunks(batch.column(1)):
                own = batch.column(1).slice(a, b - a)
                h, _, _, ranges = _text.words(*_text.buffers(own), _text.ALNUM)
                places: list[list[dict]] = [[] for _ in range(b - a)]
                for n in lengths:
                    at, full, prints = prints_of(h, ranges, n)
                    bit = (prints >> shift).astype(np.int64)
                    maybe = np.flatnonzero(known[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
                    at, full = at[maybe], full[maybe].view(np.int64)
                    doc = np.searchsorted(ranges, at, "right") - 1
                    words = h[at[:, None] + np.arange(n)]
                    for d, p, f, w in zip(doc.tolist(), (at - ranges[doc]).tolist(), full.tolist(), words):
                        places[d].append({"at": p, "n": n, "full": f, "words": w.tobytes()})
                raw = own.cast(pa.binary()).to_pylist()
                keys = [hashlib.sha256(x or b"").digest() if p else None for x, p in zip(raw, places)]
                yield batch_of(_MARKED, {"doc_id": batch.column(0).slice(a, b - a), "n_words": np.diff(ranges), "text_key": keys, "places": places})

    return run


_UNITED = pa.schema([("text_key", pa.binary()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])
_UNITED_SQL = "text_key binary, n_hit long, items array<string>, spans array<long>"


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_key, hits (start, words), items of a text -> words hit, items and spans."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _UNITED}
        for x in batch.to_pylist():
            first, size = (np.array([p[k] for p in x["hits"]], np.int64) for k in ("at", "n"))
            on = _covered(first, size, int((first + size).max()))
            edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
            spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()
            for name, v in (("text_key", x["text_key"]), ("n_hit", int(on.sum())), ("items", x["items"]), ("spans", spans)):
                out[name].append(v)
        yield batch_of(_UNITED, out)


def _joined(docs: DataFrame, found: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_words, text_key of every document (null if it can't be hit), and the hits of the keys that are."""
    lengths = [r["n"] for r in found.select("n").distinct().collect()]
    known = docs.sparkSession.sparkContext.broadcast(bitmap(found, bits))
    marked = cut_columnar(docs.mapInArrow(_mark(known, sorted(lengths), bits), _MARKED_SQL))
    places = marked.where("text_key IS NOT NULL").dropDuplicates(["text_key"]).select("text_key", F.explode("places").alias("p")).select("text_key", "p.at", "p.n", "p.full", "p.words")
    hit = cut_columnar(places.join(found.select("n", "full", "words", "items"), ["n", "full", "words"]).select("text_key", "at", "n", "items"))
    items = hit.select("text_key", F.explode("items").alias("item")).groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = hit.groupBy("text_key").agg(F.collect_set(F.struct("at", "n")).alias("hits")).join(items, "text_key", "left")  # of one text
    united = hits.select("text_key", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(_unite, _UNITED_SQL)
    return marked.select("doc_id", "n_words", "text_key"), cut_columnar(united)


def decontaminate(docs: DataFrame, benchmark: DataFrame, index: int = INDEX, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids as strings), spans (first, last+1 word of each hit run).

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = windows(benchmark)
    if found.count() <= index:
        return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block_of(found.toArrow()))), _OUT_SQL)
    marked, united = _joined(docs, found, bits)
    none = F.array().cast("array<string>"), F.array().cast("array<long>")
    clean = marked.where("text_key IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none[0].alias("items"), none[1].alias("spans"))
    hit = marked.where("text_key IS NOT NULL").join(united, "text_key", "left")
    return clean.unionByName(hit.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans")))


def _without(shared: Broadcast, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.chunks(batch.column(at)):
                h, _, _, ranges = _text.words(*_text.buffers(batch.column(at).slice(a, b - a)), _text.ALNUM)
                first, _, _ = hits(shared.value, h, ranges)
                clean = np.ones(b - a, bool)
                clean[np.searchsorted(ranges, first, "right") - 1] = False
                yield batch.slice(a, b - a).filter(pa.array(clean))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, index: int = INDEX, bits: int = BITS) -> DataFrame:
    """The rows of docs, with all columns, in which no window of the benchmark occurs."""
    found = windows(benchmark)
    if found.count() <= index:
        shared = docs.sparkSession.sparkContext.broadcast(block_of(found.toArrow()))
        return docs.mapInArrow(_without(shared, docs.columns.index("text")), docs.schema)
    _, united = _joined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), found, bits)
    own = docs.withColumn("_hit", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    return own.join(united.select(F.col("text_key").alias("_hit")), "_hit", "left_anti").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The columns that are compared by value."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
