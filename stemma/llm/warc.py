"""WARC archives: writing, normalising whole-file gzip streams, and reading by an offset index.

Pages become WARC records in monolithic archives, each one gzip stream over all its records. The normaliser inflates such a
stream once, record by record, writes every record as a gzip member of its own, and writes a sidecar of offsets next to
the new archive. Records with equal payloads are known by digest: the one with the largest page_id stays a response, the
others become revisit records without payload. Records are then read by offset, each member alone.

Scale: archives are rolled at ``ROLL`` payload bytes or ``RECORDS`` records, whichever comes first, so no archive's index or
list of revisits outgrows a task. Payloads are never shuffled, a stream is inflated ``CHUNK`` bytes at a time and a task holds
one record. The choice of responses is a groupBy on the digest with partial aggregation and a join of short rows that adaptive
execution can split. Archives are dealt to as many tasks as there are archives (``TASKS`` at most, which then take several
each): adaptive execution would merge them by the size of their names. Archives lie in the shared folder; a task writes under a name of its own attempt and publishes by rename,
and rows name only published files, so retried tasks leave at worst files that nothing refers to.

Defined cases: a null html is an empty payload and has a record like any other; of records of one page_id and payload, the
first written is the response and the others refer to their own page_id; a null page_id is smaller than any other and
refers_to is null where the response's page_id is; a null url is written as an empty one; a payload of any length is one
record; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from stemma.llm._spark import batch_of, cut
from stemma.sources.shared import shared_dir

ROLL = 32 << 20
RECORDS = 50_000
CHUNK = 1 << 18
TASKS = 20_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str, payload: bytes, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": " ".join(url.split()), "X-Page-ID": "" if page_id is None else str(page_id), **more, "Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


class Inflated:
    """Records of a gzip stream, of one member or many, inflated once."""

    def __init__(self, source: io.RawIOBase):
        self.source, self.held, self.inflate = source, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            raw = raw or self.source.read(CHUNK)
            if not raw:  # what the last call held back
                self.held += (rest := b"" if self.inflate.eof else self.inflate.flush())
                return bool(rest)
            out = self.inflate.decompress(raw, CHUNK)
            if out:
                self.held += out
                return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held:
                        raise ValueError("the archive ends within a record's header")
                    return
            first, *lines = bytes(self.held[:end]).decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
            size = end + 4 + int(head["Content-Length"])
            while len(self.held) < size + 4:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            payload = bytes(self.held[end + 4 : size])
            del self.held[: size + 4]
            yield head, payload


class Published:
    """A file that is seen under its name only once it is whole."""

    def __init__(self, folder: str, suffix: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.path = f"{base}/{self.name}"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.tmp", compression=None)
        self.size = 0

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def close(self) -> None:
        self.out.close()
        self.fs.move(f"{self.path}.tmp", self.path)


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


_WRITTEN = pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string())])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, pack, rows, held = None, None, [], 0

        def close() -> pa.RecordBatch:
            file.write(pack.flush())
            file.close()
            return batch_of(_WRITTEN, {"archive": [file.name] * len(rows), "ordinal": range(len(rows)), "page_id": [r[0] for r in rows], "digest": [r[1] for r in rows]})

        for batch in batches:
            for page_id, url, html in zip(*(c for c in batch.columns), strict=True):
                payload = (html.as_py() or "").encode()
                if file is None:
                    file, pack, rows, held = Published(folder, ".warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31), [], 0
                digest = digest_of(payload)
                file.write(pack.compress(record("response", page_id.as_py(), url.as_py() or "", payload, {"WARC-Payload-Digest": f"sha1:{digest}"})))
                rows.append((page_id.as_py(), digest))
                held += len(payload)
                if held >= ROLL or len(rows) >= RECORDS:
                    yield close()
                    file = None
        if file is not None:
            yield close()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """archive, ordinal, page_id, digest of every record, once all archives are written."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(own.mapInArrow(_write(_uri(folder)), "archive string, ordinal long, page_id long, digest string"))


def decide(written: DataFrame) -> DataFrame:
    """archive and its revisits: (ordinal, refers_to); of equal digests the largest page_id, then the first written, is the response."""
    place = F.struct(F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("id"))
    best = written.groupBy("digest").agg(F.max(place).alias("best"))
    tied = written.join(best, "digest").withColumn("is_best", place == F.col("best"))
    first = tied.where("is_best").groupBy("digest").agg(F.min(F.struct("archive", "ordinal")).alias("first"))
    other = tied.join(first, "digest").where(F.struct("archive", "ordinal") != F.col("first"))
    refers = F.when(F.col("best.known"), F.col("best.id"))
    revisits = other.groupBy("archive").agg(F.collect_list(F.struct("ordinal", refers.alias("refers_to"))).alias("revisits"))  # an archive's records
    return written.select("archive").distinct().join(revisits, "archive", "left")


_INDEXED = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                revisits = {r["ordinal"]: r["refers_to"] for r in row["revisits"] or ()}
                out, index = Published(folder, ".members.warc.gz"), []
                with fs.open_input_stream(f"{base}/{row['archive']}", compression=None) as source:
                    for k, (head, payload) in enumerate(Inflated(source)):
                        page_id = int(head["X-Page-ID"]) if head["X-Page-ID"] else None
                        more = {"WARC-Payload-Digest": head["WARC-Payload-Digest"], "X-Payload-Bytes": str(len(payload))}
                        kind = "revisit" if k in revisits else "response"
                        if kind == "revisit":
                            more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": "" if revisits[k] is None else str(revisits[k])}
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(record(kind, page_id, head["WARC-Target-URI"], b"" if k in revisits else payload, more)) + pack.flush()
                        index.append((out.size, len(member)))
                        out.write(member)
                out.close()
                sidecar = Published(folder, ".index.jsonl")
                sidecar.write("".join(json.dumps({"archive": out.name, "offset": a, "length": n}) + "\n" for a, n in index).encode())
                sidecar.close()
                yield batch_of(_INDEXED, {"archive": [out.name] * len(index), "offset": [a for a, _ in index], "length": [n for _, n in index]})

    return run


def normalise(decided: DataFrame, folder: str, archives: int) -> DataFrame:
    """archive, offset, length of every record of the rewritten archives; decided: archive, revisits; archives: how many."""
    return cut(decided.repartition(min(max(archives, 1), TASKS), "archive").mapInArrow(_normalise(_uri(folder)), "archive string, offset long, length long"))


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        opened: dict[str, object] = {}
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _READ}
            for row in batch.to_pylist():
                if row["archive"] not in opened:
                    for file in opened.values():
                        file.close()
                    opened = {row["archive"]: fs.open_input_file(f"{base}/{row['archive']}")}
                file = opened[row["archive"]]
                file.seek(row["offset"])
                (head, payload), *rest = Inflated(io.BytesIO(file.read(row["length"])))
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if rest or head["WARC-Type"] == "response" and digest_of(payload) != digest:
                    raise ValueError(f"{row} isn't one whole record")
                out["page_id"].append(int(head["X-Page-ID"]) if head["X-Page-ID"] else None)
                out["payload_bytes"].append(int(head["X-Payload-Bytes"]))
                out["payload_digest"].append(digest)
                out["record_type"].append(head["WARC-Type"])
                out["refers_to"].append(int(x) if (x := head.get("X-Refers-To-Page-ID")) else None)
            yield batch_of(_READ, out)
        for file in opened.values():
            file.close()

    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every indexed record."""
    return index.mapInArrow(_read(_uri(folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back; the folder must be shared by all executors."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    written = write(pages, folder)
    return read(normalise(decide(written), folder, written.select("archive").distinct().count()), folder)
