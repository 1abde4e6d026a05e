"""Archives: exact round trip, the same bytes in every run, and what revisits refer to."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from pigmenta.llm.warc import cut_points, read_archives, records, shards_of, write_archives

from . import brute

SCHEMA = "page_id long, url string, html string, shard int, hash string"


def make_rows(seed=1, n=300):
    rng = random.Random(seed)
    bodies = ["", None, "<p>é😀\r\n\r\n</p>", "WARC/1.1\r\n\r\n"] + ["<html>" + "x" * rng.randrange(3000) + str(i) for i in range(60)]
    rows = [(i * rng.choice([1, 3]), f"http://h{i % 9}/p {i}\r\nX: y" if i % 5 else None, rng.choice(bodies), i, "d") for i in range(n)]
    return [*rows, (rows[5][0], "http://again/", rows[5][2], 0, "d"), (rows[5][0], "http://again/", rows[5][2], 0, "d"), (None, None, "null id", 0, None), (None, "u", "null id", 0, None), (10**12, None, "far", 0, None), (10**12 + 1, None, "far", 0, None)]


def files_of(uri):
    folder = Path(uri.removeprefix("file://"))
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.glob("*.warc.gz")}


@pytest.mark.parametrize("least,shard,roll", [(0, 1 << 30, 1 << 30), (0, 20_000, 4_000), (50, 5_000, 1 << 20)])
def test_round_trip(spark, tmp_path, least, shard, roll):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    uri = f"file://{tmp_path}/a"
    manifest = write_archives(df.repartition(5), uri, min_revisit_bytes=least, shard_bytes=shard, roll_bytes=roll).collect()
    found = read_archives(spark, uri, payload=True).collect()
    assert len(found) == len(rows) == sum(m["records"] for m in manifest)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found) == Counter((i, len((h or "").encode()), brute.digest(h)) for i, _, h, _, _ in rows)
    groups = defaultdict(list)
    for r in found:
        groups[r["payload_digest"]].append(r)
    for group in groups.values():
        stored = [r for r in group if r["record_type"] == "response"]
        assert all(r["refers_to"] is None for r in stored)
        if group[0]["payload_bytes"] < least:
            assert len(stored) == len(group)
            continue
        ids = [r["page_id"] for r in group if r["page_id"] is not None]
        assert len(stored) == 1 and stored[0]["page_id"] == max(ids, default=None)
        assert all(r["refers_to"] == stored[0]["page_id"] for r in group if r["record_type"] == "revisit")
    assert Counter((r["page_id"], r["html"]) for r in found if r["record_type"] == "response") <= Counter((i, h or "") for i, _, h, _, _ in rows)
    # the same bytes from another order of the rows
    other = f"file://{tmp_path}/b"
    write_archives(df.orderBy("url").coalesce(2), other, min_revisit_bytes=least, shard_bytes=shard, roll_bytes=roll)
    assert files_of(uri) == files_of(other) == {m["file"]: m["sha256"] for m in manifest}
    assert not list((tmp_path / "a" / "_temporary").glob("*"))


def test_records_are_plain_warc(spark, tmp_path):
    uri = f"file://{tmp_path}/w"
    write_archives(spark.createDataFrame([(1, "http://a/ b", "<p>x</p>"), (2, "http://c/", "<p>x</p>")], "page_id long, url string, html string"), uri)
    (path,) = tmp_path.glob("w/*.warc.gz")
    text = gzip.decompress(path.read_bytes())
    assert text.count(b"WARC/1.1\r\n") == 3
    with path.open("rb") as stream:
        found = list(records(stream))
    assert [f["WARC-Type"] for f, _ in found] == ["warcinfo", "revisit", "response"]
    assert found[1][0]["WARC-Refers-To"] == found[2][0]["WARC-Record-ID"] and found[1][0]["WARC-Target-URI"] == "http://a/%20b"
    for fields, block in found[1:]:
        assert "sha1:" + brute.base64.b32encode(hashlib.sha1(block).digest()).decode() == fields["WARC-Block-Digest"]


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    uri = f"file://{tmp_path}/m"
    write_archives(spark.createDataFrame([(1, None, "a")], "page_id long, url string, html string"), uri)
    (tmp_path / "m" / "part-9999999-00000.warc.gz").write_bytes(b"left by a failed run")
    assert read_archives(spark, uri).count() == 1


def test_no_pages(spark, tmp_path):
    uri = f"file://{tmp_path}/e"
    assert write_archives(spark.createDataFrame([], "page_id long, url string, html string"), uri).collect() == []
    assert read_archives(spark, uri).collect() == []


def test_cut_points(spark):
    """Clustered ids, one id in a third of all rows, null ids, empty pages: shards are of like size."""
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(62), 10) for i in range(3000)] + [(7, rng.getrandbits(62), 10) for _ in range(3000)] + [(None, rng.getrandbits(62), 10) for _ in range(3000)] + [(10**15, 1, 10), (-(10**15), 2, 4000)]
    df = spark.createDataFrame(rows, "id long, hash long, bytes long")
    cuts = cut_points(df, 5000)
    assert cuts == cut_points(df.repartition(5), 5000) == sorted(cuts)
    at = np.array(cuts, dtype=np.int64).T
    ids, hashes = np.array([-(1 << 63) if i is None else i for i, _, _ in rows]), np.array([h for _, h, _ in rows])
    shards = shards_of(ids, hashes, at)
    assert shards.tolist() == [sum(c <= (int(i), int(h)) for c in cuts) for i, h in zip(ids, hashes)]
    sizes = Counter()
    for s, (_, _, n) in zip(shards.tolist(), rows):
        sizes[s] += n
    assert 14 <= len(cuts) <= 19 and max(sizes.values()) < 12_000
    assert cut_points(df, 10**9) == [] and len(cut_points(df, 1, most=8)) == 7


def test_a_shard_rolls_into_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, None, "".join(rng.choice("abcdefgh") for _ in range(2000))) for i in range(200)]
    uri = f"file://{tmp_path}/r"
    manifest = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), uri, roll_bytes=20_000).collect()
    assert {m["shard"] for m in manifest} == {0} and len(manifest) > 5 and all(m["bytes"] < 25_000 for m in manifest)
    assert read_archives(spark, uri).count() == 200
