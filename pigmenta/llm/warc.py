"""Deterministic sharded WARC writer, and a reader of what it wrote.

Pages are cut into ranges of (id, payload hash) at quantiles of a sample that the hash
picks, weighed by payload and headers, so the shards are the same in every run and pages
without payload or without id spread like others. Each shard is sorted and written as
several archives, which roll over by compressed size; headers, record ids and digests are regenerated from the page.
A file is written under a temporary name and renamed when it is whole; the manifest,
written last, names the files of a complete run, and the reader reads no others. A task
that is lost and run again, or run twice, writes the same bytes under the same name.

Of equal payloads the page with the largest id is stored, the others refer to it. Which
payloads are equal is found on digests alone, with partial aggregation; the pages
themselves are moved once, to their range, where the answers meet them. So a payload on
a third of all pages costs narrow rows only.

Defined cases: a null html is an empty payload, a null url the URN of the page; null ids are below
all others and written first; of rows with equal id and payload, one is the response (if
it is the largest) and the others refer to it; an empty table writes an empty manifest;
extra columns are not looked at. A page of any size is held once, not copied to others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path
from .textbatch import slices

DATE = "1970-01-01T00:00:00Z"
#: Uncompressed bytes of a shard, unless there are ``MAX_SHARDS``; compressed bytes of a file.
SHARD_BYTES = 64 << 20
ROLL_BYTES = 4 << 20
MAX_SHARDS = 16_384
#: Bytes that headers add to a payload, about, and rows of the sample for each shard.
HEAD_BYTES = 900
_SAMPLE = 32
_NO_ID = -(1 << 63)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # that of URLs, RFC 4122


def base32_sha1(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, body: bytes, winner: tuple[int | None] | None) -> bytes:
    """One WARC record; ``winner`` holds the page that a revisit refers to."""
    digest = base32_sha1(body)
    uri = _clean(url) if url else f"urn:page:{page_id}"
    fields = [("WARC-Type", "response" if winner is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest) if winner is None or winner[0] != page_id else f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'again:{page_id}:{digest}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-X-Payload-Length", str(len(body)))]
    if page_id is not None:
        fields.append(("WARC-X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if winner is None else http
    if winner is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(winner[0], digest))]
        if winner[0] is not None:
            fields.append(("WARC-X-Refers-To-Page", str(winner[0])))
    fields += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(fields) + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: deterministic sharded writer\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'file:{name}')}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return _head(fields) + body + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """One gzip member without a time or a name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Archive:
    """Writes the files of one shard."""

    def __init__(self, uri: str, shard: int, roll: int, level: int) -> None:
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(uri)
        self.shard, self.roll, self.level = shard, roll, level
        self.number, self.out = 0, None

    def _open(self) -> None:
        self.name = f"part-{self.shard:07d}-{self.number:05d}.warc.gz"
        self.temporary = f"{self.folder}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.size, self.records, self.digest, self.first = 0, 0, hashlib.sha256(), None
        self._put(_info(self.name))

    def _put(self, data: bytes) -> None:
        packed = _member(data, self.level)
        self.out.write(packed)
        self.size += len(packed)
        self.digest.update(packed)

    def add(self, page_id: int | None, data: bytes) -> Iterator[dict]:
        if self.out is None:
            self._open()
            self.first = page_id
        self._put(data)
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        row = {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.size, "first_id": self.first, "last_id": self.last, "sha256": self.digest.hexdigest()}
        self.out, self.number = None, self.number + 1
        return row


_MANIFEST = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())])
_MANIFEST_DDL = "file string, shard long, records long, bytes long, first_id long, last_id long, sha256 string"


def cut_points(sizes: DataFrame, target: int, most: int = MAX_SHARDS) -> list[tuple[int, int]]:
    """(id, hash) at which a new shard begins, from (id, hash, bytes); null ids come first.

    The sample takes rows by their hash, ``_SAMPLE`` a shard or all there are, so it has a
    bounded size whatever the input, and shards are equal within some tenths.
    """
    rows, total = sizes.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    shards = min(most, -(-(total or 0) // target))
    if shards <= 1:
        return []
    mean = max(1, total // rows)
    scale = 1 << 30
    # a row is taken by its weight, a heavy one always; then all those taken weigh alike
    chance = F.lit(float(shards * _SAMPLE) / total) * F.greatest(F.col("bytes"), F.lit(mean // 4))
    drawn = F.pmod(F.xxhash64("hash", "id"), F.lit(scale)) < F.least(F.lit(1.0), chance) * scale
    taken = sizes.where(drawn).select(F.coalesce("id", F.lit(_NO_ID)).alias("id"), "hash", F.greatest(F.lit(1.0), chance).alias("w")).toArrow()
    ids, hashes, weight = (taken.column(i).to_numpy() for i in range(3))
    order = np.lexsort((hashes, ids))
    ids, hashes, upto = ids[order], hashes[order], np.cumsum(weight[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards) if len(upto) else np.zeros(0, np.int64)
    return sorted({(int(ids[i]), int(hashes[i])) for i in at})


def shards_of(ids: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Shard of each (id, hash): the number of cuts that are not above it."""
    low, high = np.searchsorted(cuts[0], ids, "left"), np.searchsorted(cuts[0], ids, "right")
    out = low.copy()
    for i in np.unique(ids[low < high]).tolist():  # ids at which a shard begins
        rows = np.flatnonzero(ids == i)
        a, b = low[rows[0]], high[rows[0]]
        out[rows] = a + np.searchsorted(cuts[1][a:b], hashes[rows], "right")
    return out


def write_archives(pages: DataFrame, uri: str, id_column: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Write ``pages`` below ``uri`` and return the manifest, one row a file.

    ``uri`` is a folder all executors share, of any file system that pyarrow opens.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    source = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("html")).withColumn("hash", F.xxhash64("html"))
    narrow = materialize(source.select("id", "hash", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size")), "digests")
    weights = narrow.select("id", "hash", (F.col("size") + HEAD_BYTES).alias("bytes"))
    cuts = np.array(cut_points(weights, shard_bytes), dtype=np.int64).reshape(-1, 2).T
    shards = cuts.shape[1] + 1
    bounds = spark.sparkContext.broadcast(cuts)  # two numbers a shard

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            found = shards_of(ids, batch.column(1).to_numpy(zero_copy_only=False), bounds.value)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *batch.columns], names=["shard", *batch.schema.names])

    same = narrow.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "winner")
    answers = narrow.select("id", "hash", "digest").join(same, "digest").distinct()
    rows = answers.select("id", "hash", F.lit(0).alias("what"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "winner").unionByName(
        source.select("id", "hash", F.lit(1).alias("what"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("winner"))
    )
    placed = rows.mapInArrow(shard_of, "shard int, id long, hash long, what int, url string, html string, digest string, winner long") if shards > 1 else rows.select(F.lit(0).alias("shard"), *rows.columns)
    # ties of one id are ordered by their payload and address, so that files do not depend on the shuffle
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "hash", "what", "html", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, manifest, now = None, [], object()
        winners: dict[str, int | None] = {}
        stored: set[str] = set()
        for batch in slices(batches):
            shard, ids, hashes, what, urls, bodies, digests, won = (batch.column(i) for i in range(8))
            for i in range(batch.num_rows):
                page, place = ids[i].as_py(), hashes[i].as_py()
                if archive is None or archive.shard != shard[i].as_py():
                    if archive is not None and archive.out is not None:
                        manifest.append(archive.close())
                    archive, now = _Archive(uri, shard[i].as_py(), roll_bytes, level), object()
                if (page, place) != now:
                    now, winners, stored = (page, place), {}, set()
                if what[i].as_py() == 0:
                    winners[digests[i].as_py()] = won[i].as_py()
                    continue
                body = bodies[i].as_buffer().to_pybytes()
                digest = hashlib.sha1(body).hexdigest()
                refers = None
                if digest in winners:
                    if winners[digest] != page or digest in stored:
                        refers = (winners[digest],)
                    stored.add(digest)
                manifest += archive.add(page, record(page, urls[i].as_py(), body, refers))
            if manifest:
                yield pa.RecordBatch.from_pylist(manifest, schema=_MANIFEST)
                manifest = []
        if archive is not None and archive.out is not None:
            manifest.append(archive.close())
        yield pa.RecordBatch.from_pylist(manifest, schema=_MANIFEST)

    path = f"{uri}/manifest"
    ordered.mapInArrow(write, _MANIFEST_DDL).write.parquet(path)
    return spark.read.schema(_MANIFEST_DDL).parquet(path)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a compressed archive, streaming."""
    unpacker, data = zlib.decompressobj(31), bytearray()
    rest = b""
    while True:
        chunk = rest or stream.read(1 << 18)
        rest = b""
        if not chunk:
            break
        data += unpacker.decompress(chunk)
        if unpacker.eof:  # one member is one record
            rest = unpacker.unused_data
            unpacker = zlib.decompressobj(31)
            split = data.index(b"\r\n\r\n")
            fields = _fields(bytes(data[:split]))
            yield fields, bytes(data[split + 4 : split + 4 + int(fields["Content-Length"])])
            data = bytearray()
    if data:
        raise ValueError("the archive ends within a record")


_READ_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, uri: str, payload: bool = False) -> DataFrame:
    """One row per page record of the files that the manifest below ``uri`` names.

    Digests of responses are computed again from the stored payload and must agree with
    the record's. With ``payload`` the html comes too (null for revisits).
    """
    manifest = spark.read.schema(_MANIFEST_DDL).parquet(f"{uri}/manifest")
    n = manifest.count()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("html", pa.string())] if payload else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        body = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                        if body is not None and base32_sha1(body) != digest:
                            raise ValueError(f"{name}: the digest of page {fields.get('WARC-X-Page-ID')} does not agree")
                        page, refers = fields.get("WARC-X-Page-ID"), fields.get("WARC-X-Refers-To-Page")
                        row = {"page_id": None if page is None else int(page), "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["WARC-X-Payload-Length"]) if body is None else len(body), "payload_digest": digest, "record_type": kind, "refers_to": None if refers is None else int(refers)}
                        if payload:
                            row["html"] = None if body is None else body.decode()
                            size += len(body or b"")
                        held.append(row)
                        if len(held) >= 2000 or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return manifest.select("file").repartition(max(1, min(n, 10_000)), "file").mapInArrow(read, _READ_DDL + (", html string" if payload else ""))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    uri = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read_archives(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
