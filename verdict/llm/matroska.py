"""Matroska in pure Python: an EBML reader and a small writer for raw audio packets.

``packets`` reads any Matroska file held in memory: variable-length ids and sizes, unknown sizes of segments and
clusters, simple blocks and block groups, all four lacing modes, and cues. Damaged files raise ``EbmlError``.
``write`` stores bytes losslessly as packets of 8-bit PCM samples; ``payload`` reads them back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

# Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}  # with SeekHead, Attachments, Chapters, Tags
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples per packet, packets per laced block, blocks per cluster of the writer; the rate is in samples a second.
FRAME, LACE, BLOCKS, RATE = 4_096, 8, 16, 8_000


class EbmlError(ValueError):
    """The bytes are not a well-formed Matroska file."""


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    cluster: int
    lacing: int
    keyframe: bool


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]  # time in ns, track, byte offset of the cluster in the file
    clusters: list[int]  # byte offsets
    duration_ns: int


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise EbmlError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise EbmlError(f"bad element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """The value of a variable-length integer (None: unknown size) and the byte after it."""
    if at >= len(data) or not data[at]:
        raise EbmlError(f"no size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise EbmlError(f"cut size at byte {at}")
    top = (1 << (7 * width)) - 1
    value = int.from_bytes(data[at : at + width], "big") & top
    return (None if value == top else value), at + width


def elements(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its data, end of its data). An element of unknown size reaches up to ``end``;
    whoever descends into it passes as ``stop`` the ids that close it."""
    while at < end:
        start = at
        ident, at = read_id(data, at)
        if ident in stop:
            return
        size, at = read_size(data, at)
        last = end if size is None else at + size
        if last > end:
            raise EbmlError(f"element {ident:#x} at byte {start} ends beyond its parent")
        yield ident, start, at, last
        at = last


def uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def real(data: bytes, at: int, end: int) -> float:
    return 0.0 if at == end else struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0]


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The sizes of the frames in a block whose payload starts at ``at``, and where the first frame starts."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise EbmlError("cut lace")
    n = data[at] + 1
    at += 1
    if lacing == FIXED:
        if (end - at) % n:
            raise EbmlError("fixed lace of unequal frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise EbmlError("cut lace")
            size, at = size + data[at], at + 1
        else:
            first = at
            value, at = read_size(data, at)
            if value is None:
                raise EbmlError("bad lace size")
            size = value if not k else sizes[-1] + value - ((1 << (7 * (at - first) - 1)) - 1)
        if size < 0:
            raise EbmlError("negative lace size")
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0:
        raise EbmlError("lace beyond its block")
    return [*sizes, rest], at


def packets(data: bytes) -> Media:
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise EbmlError("no EBML header")
    segment = next((x for x in top if x[0] == SEGMENT), None)
    if segment is None:
        raise EbmlError("no segment")
    _, _, base, end = segment
    scale, duration, tracks, cues, clusters, found = 1_000_000, 0.0, {}, [], [], []
    at = base
    while at < end:
        ident, start = read_id(data, at)[0], at
        size, first = read_size(data, read_id(data, at)[1])
        last = end if size is None else first + size
        if last > end:
            raise EbmlError(f"element {ident:#x} at byte {start} ends beyond the segment")
        if ident == INFO:
            for k, _, a, b in elements(data, first, last):
                if k == TIMESTAMP_SCALE:
                    scale = uint(data, a, b)
                elif k == DURATION:
                    duration = real(data, a, b)
        elif ident == TRACKS:
            for k, _, a, b in elements(data, first, last):
                if k == TRACK_ENTRY:
                    entry = {x: (p, q) for x, _, p, q in elements(data, a, b)}
                    number = uint(data, *entry[TRACK_NUMBER]) if TRACK_NUMBER in entry else 0
                    tracks[number] = {"codec": bytes(data[slice(*entry.get(CODEC_ID, (0, 0)))]).decode("ascii", "replace"), "type": uint(data, *entry.get(TRACK_TYPE, (0, 0))), "frame_ns": uint(data, *entry.get(DEFAULT_DURATION, (0, 0)))}
        elif ident == CUES:
            for k, _, a, b in elements(data, first, last):
                if k == CUE_POINT:
                    parts = list(elements(data, a, b))
                    time = next((uint(data, p, q) for x, _, p, q in parts if x == CUE_TIME), 0)
                    for x, _, p, q in parts:
                        if x == CUE_TRACK_POSITIONS:
                            spot = {y: uint(data, r, s) for y, _, r, s in elements(data, p, q)}
                            cues.append((time, spot.get(CUE_TRACK, 0), base + spot.get(CUE_CLUSTER_POSITION, 0)))
        elif ident == CLUSTER:
            clusters.append(start)
            time, reached = 0, first
            for k, s, a, b in elements(data, first, last, TOP_LEVEL if size is None else frozenset()):
                reached = b
                if k == TIMESTAMP:
                    time = uint(data, a, b)
                elif k == SIMPLE_BLOCK:
                    found += _block(data, a, b, time, len(clusters) - 1, None)
                elif k == BLOCK_GROUP:
                    parts = list(elements(data, a, b))
                    for x, _, p, q in parts:
                        if x == BLOCK:
                            found += _block(data, p, q, time, len(clusters) - 1, all(y[0] != 0xFB for y in parts))
            if size is None:
                last = reached
        at = last
    out = []
    for track, time, nth, offset, n, cluster, lacing, key in found:
        out.append(Packet(track, time * scale + nth * tracks.get(track, {}).get("frame_ns", 0), offset, n, cluster, lacing, key))
    return Media(out, tracks, [(t * scale, k, p) for t, k, p in cues], clusters, round(duration * scale))


def _block(data: bytes, at: int, end: int, time: int, cluster: int, key: bool | None) -> list[tuple]:
    track, at = read_size(data, at)
    if track is None or at + 3 > end:
        raise EbmlError("cut block")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    lacing = (flags >> 1) & 3
    sizes, at = lace_sizes(data, at + 3, end, lacing)
    out = []
    for nth, size in enumerate(sizes):
        out.append((track, time + relative, nth, at, size, cluster, lacing, bool(flags & 0x80) if key is None else key))
        at += size
    return out


def vint(value: int) -> bytes:
    """The shortest size field that is not the reserved all-ones value."""
    width = 1
    while value >= (1 << (7 * width)) - 1:
        width += 1
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The payload of a block that holds ``frames``."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING:
        head += vint(len(frames[0]))
        for before, f in zip(frames, frames[1:-1]):
            delta, width = len(f) - len(before), 1
            while not -((1 << (7 * width - 1)) - 1) <= delta <= (1 << (7 * width - 1)) - 1:
                width += 1
            head += (delta + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    return head + b"".join(frames)


HEADER = element(EBML, number(EBML_VERSION, 1), number(EBML_READ_VERSION, 1), number(EBML_MAX_ID, 4), number(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), number(DOC_TYPE_VERSION, 4), number(DOC_TYPE_READ_VERSION, 2))


def write(samples: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file with one track of 8-bit mono PCM; the time unit is one sample.

    Packets of ``frame`` samples are laced into blocks, blocks are gathered in clusters, and each cluster has a cue. Full
    blocks use fixed lacing, the last one EBML lacing, since its last packet may be shorter.
    """
    unit = 1_000_000_000 // RATE
    info = element(INFO, number(TIMESTAMP_SCALE, unit), element(DURATION, struct.pack(">d", float(len(samples)))), element(MUXING_APP, b"corpus"), element(WRITING_APP, b"corpus"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))), number(CHANNELS, 1), number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), number(FLAG_LACING, 1), number(DEFAULT_DURATION, frame * unit), element(CODEC_ID, b"A_PCM/INT/LIT"), audio))
    step = frame * LACE
    clusters, cues, position = [], [], len(info) + len(tracks)
    # A block's time is relative to its cluster in 16 signed bits, so each cluster spans fewer than 2**15 units.
    per_cluster = max(1, min(BLOCKS, 32_767 // step + 1))
    for start in range(0, max(1, len(samples)), step * per_cluster):
        blocks = []
        for at in range(start, min(start + step * per_cluster, max(1, len(samples))), step):
            chunk = samples[at : at + step]
            frames = [chunk[k : k + frame] for k in range(0, max(1, len(chunk)), frame)]
            lacing = NO_LACING if len(frames) == 1 else FIXED if len(chunk) == step else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, vint(1), struct.pack(">hB", at - start, 0x80 | lacing << 1), lace(frames, lacing)))
        cluster = element(CLUSTER, number(TIMESTAMP, start), *blocks)
        cues.append(element(CUE_POINT, number(CUE_TIME, start), element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1), number(CUE_CLUSTER_POSITION, position))))
        clusters.append(cluster)
        position += len(cluster)
    return HEADER + element(SEGMENT, info, tracks, *clusters, element(CUES, *cues))


def payload(data: bytes, track: int = 1) -> tuple[bytes, Media]:
    """The bytes of a track's packets in time order, and the tables."""
    media = packets(data)
    own = sorted((p for p in media.packets if p.track == track), key=lambda p: (p.timestamp_ns, p.offset))
    return b"".join(data[p.offset : p.offset + p.size] for p in own), media
