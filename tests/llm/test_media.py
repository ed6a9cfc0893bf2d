import hashlib
import random
import zlib

import pytest

from verdict.llm import matroska
from verdict.llm.media import digest, packet_table, padded, store


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 32768, 32832, 200_000, 1_000_000])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n)
    data = matroska.write(raw)
    back, media = matroska.payload(data)
    assert back == raw
    assert media.duration_ns == n * 125_000
    assert {c[2] for c in media.cues} == set(media.clusters)
    stamps = [p.timestamp_ns for p in media.packets]
    assert stamps == [k * 4096 * 125_000 for k in range(len(stamps))]


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing(lacing):
    sizes = [300] * 4 if lacing == matroska.FIXED else [0, 255, 700, 3, 70_000, 1]
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    block = matroska.lace(frames, lacing)
    found, at = matroska.lace_sizes(block, 0, len(block), lacing)
    assert found == sizes and block[at:] == b"".join(frames)


def test_unknown_sizes_and_block_groups():
    block = matroska.vint(3) + (5).to_bytes(2, "big") + b"\0" + b"abc"
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.number(matroska.TIMESTAMP, 7) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
    data = matroska.HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    media = matroska.packets(data)
    assert [(p.track, p.timestamp_ns, data[p.offset : p.offset + p.size], p.cluster) for p in media.packets] == [(3, 12_000_000, b"abc", 0), (3, 12_000_000, b"abc", 1)]


def test_empty_cluster_of_unknown_size_between_others():
    block = matroska.vint(1) + (0).to_bytes(2, "big") + b"\x80" + b"abc"
    head = matroska.CLUSTER.to_bytes(4, "big") + b"\xff"
    full = head + matroska.number(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, block)
    data = matroska.HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + full + head + full
    media = matroska.packets(data)
    assert [(data[p.offset : p.offset + p.size], p.cluster) for p in media.packets] == [(b"abc", 0), (b"abc", 2)]


def test_damaged_files_raise_or_stop():
    data = matroska.write(bytes(range(256)) * 64)
    rng = random.Random(5)
    for _ in range(300):
        broken = bytearray(data[: rng.randrange(len(data))])
        if broken:
            broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        try:
            matroska.packets(bytes(broken))
        except (ValueError, IndexError, KeyError, OverflowError):
            pass


def test_operator(spark):
    texts = [None, "", "a" * 64, "é\x00" * 5000, "tie", "tie"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, media string")
    rows = {r.key: r for r in digest(store(docs)).collect()}
    for k, t in enumerate(texts):
        n, raw = padded(t)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r.media_bytes == len(matroska.write(raw))
    assert rows[4].asDict() | {"key": 0} == rows[5].asDict() | {"key": 0}
    assert None in rows and digest(store(docs.limit(0))).count() == 0


def test_packet_table(spark):
    files = spark.createDataFrame([(1, bytearray(matroska.write(b"x" * 10_000))), (2, bytearray(b"junk")), (3, None)], "id long, m binary")
    rows = packet_table(files, files.id, files.m).orderBy("key", "packet").collect()
    assert [(r.key, r.packet, r["size"], r.error is None) for r in rows] == [(1, 0, 4096, True), (1, 1, 4096, True), (1, 2, 1808, True), (2, None, None, False), (3, None, None, False)]
    assert all(r.cued for r in rows if r.key == 1)
