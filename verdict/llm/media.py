"""Media columns: texts stored as Matroska files, and packet tables read from a column of Matroska files.

Defined results: a null or empty text is stored as 64 zero bytes; a null or damaged file gives no packets and one row
with ``error`` set; repeated rows give repeated, equal rows; other columns are not read. Both operators map one row at a
time within Arrow batches and keep no state, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.llm import matroska
from verdict.llm.common import slices

UNIT = 64
STORED = "key long, n_bytes long, media binary"
DIGEST = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PACKETS = "key long, packet int, track long, timestamp_ns long, offset long, size long, cluster int, lacing int, keyframe boolean, cued boolean, error string"


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes of a text, filled with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def feature(media: matroska.Media, data: bytes) -> str:
    """What the packet table and the samples say: counts, duration, lacing modes, mean and energy of the samples."""
    samples = np.frombuffer(data, np.uint8)
    histogram = np.zeros(256, np.int64)
    for p in media.packets:
        histogram += np.bincount(samples[p.offset : p.offset + p.size], minlength=256)
    values, n = np.arange(256), max(1, int(histogram.sum()))
    mean, energy = int(values @ histogram) / n, int(values**2 @ histogram) / n
    cued = len({c[2] for c in media.cues} & set(media.clusters))
    laced = "".join(str(k) for k in sorted({p.lacing for p in media.packets}))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cued={cued};duration_ns={media.duration_ns};lacing={laced};mean={mean:.3f};energy={energy:.3f};symbols={int((histogram > 0).sum())}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for start, stop in slices(texts.to_pylist(), 16_000_000):
                sizes, media = [], []
                for value in texts.slice(start, stop - start).to_pylist():
                    n, raw = padded(value)
                    sizes.append(n)
                    media.append(matroska.write(raw))
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, STORED)


def digest(stored: DataFrame) -> DataFrame:
    """Reads the files of ``store`` back: digests of the payload and of the file, and features from the packet table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in (x.as_py() for x in batch.column(2)):
                raw, media = matroska.payload(data)
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, data)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in DIGEST.split(", ")])

    return stored.mapInArrow(run, DIGEST)


def packet_table(files: DataFrame, key: Column, media: Column) -> DataFrame:
    """One row per packet of every Matroska file: track, timestamp, byte range, cluster, lacing, and whether a cue points
    at its cluster. A null or damaged file gives one row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in batches:
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                try:
                    if data is None:
                        raise matroska.EbmlError("null")
                    found = matroska.packets(data)
                    cued = {c[2] for c in found.cues}
                    rows = [(ident, k, p.track, p.timestamp_ns, p.offset, p.size, p.cluster, p.lacing, p.keyframe, found.clusters[p.cluster] in cued, None) for k, p in enumerate(found.packets)]
                except (ValueError, IndexError, KeyError) as e:
                    rows = [(ident, *[None] * 9, str(e) or type(e).__name__)]
                for start in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[start : start + 4096]), kinds)], names)

    return files.select(key.cast("long").alias("key"), media.alias("media")).mapInArrow(run, PACKETS)
