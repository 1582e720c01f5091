"""Best-fit packing by minimum bin slack.

Documents are tokenised, those over the capacity are cut, and the pieces are packed by length alone: for each bin the
longest length left is fixed and a subset-sum bitset over the lengths left finds the fullest bin that contains it; the
combination is removed as often as the counts allow. A combination uses up one length at least down to less than its
multiplicity, so there are at most capacity * H(capacity) of them (about 7,700 for 1024) whatever the number of pieces.
Pieces get their rank within their length and from it their bin and offset.

Scale: the driver sees one count per length. A piece that fills a sequence is one, without rank or shuffle. The others' ranks
come from windows over (length, salt) and from the totals of the salts before; the salt is a running number and there is one
for each ``RANKED`` pieces, so neither a frequent length nor null or repeated ids meet in one task. It is written with the
piece, so a retried task reads the same.

Defined cases: a null or empty text is the end token alone; an added token's string within a text is that token; repeated
rows, null and repeated ids are packed each; a text of any length is cut into pieces; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from stemma.llm._spark import batch_of, cut_columnar

CAPACITY = 1024
END = 2
#: Pieces of a salt, whose ranks within their length one task gives.
RANKED = 500_000

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


@dataclass(frozen=True)
class Vocabulary:
    """The same byte-level BPE twice: ranks, which encode fast, and the tokenizer's json, which names the added tokens."""

    ranks_path: str
    json_path: str
    pattern: str


def encoder(vocabulary: Vocabulary) -> Callable[[str], list[int]]:
    """Ids as the tokenizer of the json gives them without special tokens at the ends: a text is split at its added tokens."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary.ranks_path, "rb"))}
    ordinary = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    with open(vocabulary.json_path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that take white space or word bounds into account aren't supported")
    ids = {t["content"]: t["id"] for t in added}
    if not ids:
        return ordinary
    split = re.compile("(" + "|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True)) + ")").split

    def encode(text: str) -> list[int]:
        parts = split(text)
        if len(parts) == 1:
            return ordinary(text)
        return [i for k, part in enumerate(parts) for i in ([ids[part]] if k % 2 else ordinary(part))]

    return encode


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens, and n: full pieces, but the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [0, *range(first, n + 1, capacity)]


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, where asked for, ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _PIECE}
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                at = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    raw = ids[a:b].tobytes()
                    for name, v in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(raw)), ("ids", raw if keep_ids else None)):
                        out[name].append(v)
                held += len(ids)
                if held > 2_000_000:
                    yield batch_of(_PIECE, out)
                    out, held = {f.name: [] for f in _PIECE}, 0
            yield batch_of(_PIECE, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE_SQL)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, times) of the fullest bin with the longest length in it; longer lengths are preferred on ties."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    first, room = lengths[0], capacity - lengths[0]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        left = min(counts[n] - (n == first), room // n)
        times = 0
        before = reach
        grown = reach
        while times < left:
            more = (grown | grown << n) & mask
            if more == grown:
                break
            grown, times = more, times + 1
        reach = grown
        steps.append((n, before))
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {first: 1}
    for n, before in reversed(steps):
        while not before >> at & 1:
            at -= n
            used[n] = used.get(n, 0) + 1
    return sorted(used.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, combination) until every piece is placed."""
    left, out = dict(counts), []
    while any(left.values()):
        use = fullest(left, capacity)
        times = min(left[n] // k for n, k in use)
        for n, k in use:
            left[n] -= times * k
        out.append((times, use))
    return out


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces in a bin, first bin, offset of the first), by rank."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    bins = 0
    for times, use in found:
        offset = 0
        for n, k in use:
            out.setdefault(n, []).append((rank.get(n, 0), k, bins, offset))
            rank[n] = rank.get(n, 0) + times * k
            offset += n * k
        bins += times
    return {n: np.array(v, np.int64) for n, v in out.items()}


def _place(shared: Broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                t = table[n]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in list(schema)[:-2]), pa.array(sequence), pa.array(offset)], schema=schema)

    return run


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset. docs: doc_id, text; other columns are ignored."""
    spark = docs.sparkSession
    kept = [f for f in _PIECE if f.name != "ids" or keep_ids]
    names = [f.name for f in kept]
    number = F.monotonically_increasing_id()
    cut_pieces = cut_columnar(pieces(docs, vocabulary, capacity, keep_ids).select(*names).withColumn("number", number))
    whole, rest = cut_pieces.where(F.col("length") == capacity), cut_pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity
    table = spark.sparkContext.broadcast(slots(patterns(counts, capacity)))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(1 + sum(counts.values()) // RANKED)))
    totals = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    base = totals.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = salted.withColumn("nth", F.row_number().over(W.partitionBy("length", "salt").orderBy("number"))).join(base, ["length", "salt"])
    ranked = ranked.select(*names, (F.col("base") + F.col("nth") - 1).alias("rank"))
    schema = pa.schema([*kept, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    sql = ", ".join(["doc_id long, piece int, start long, length long, ids_crc32 long", *["ids binary"] * keep_ids, "sequence_id long, offset long"])
    alone = whole.select(*names, (-F.col("number") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(_place(table, schema), sql).unionByName(alone)
