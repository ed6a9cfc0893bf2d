"""Line dedup: a deletion-neighbourhood join over the words of lines, keeping the earliest.

Lines are compared by their words in lower case. Two lines are near when one edit of a word (replace, insert or delete)
turns one into the other and both have at least ``NEAR_WORDS`` words; shorter ones count only when equal, and not at all
below ``MIN_WORDS`` words and ``MIN_CHARS`` characters. Lines are taken in order of (doc_id, text, number): one that equals
or is near an earlier line that stays is dropped. So a dropped line always has a near one that stays, and no chain of
edits leads away from what is kept.

Equal lines are first reduced to one row per content. Two near lines share their first or their last half, so only
contents that share a half with another go on. Those emit every variant with one word left out as a hashed key, and
themselves: equal variants of one position are replacements of each other, a variant equal to a whole line is an
insertion. Contents that share a key are a group, which is verified word by word against its earliest content. Then rounds
decide: the earliest content that is left in each of its groups stays, and whatever shares a group with it and comes
later is dropped. A round reduces each group to its least content before any shuffle; no pairs within a group are formed.

Words and variants are hashed to 64 bits, contents to 128. The hash of a line, of a half or of a line without a word
follows from a running sum over the hashes of its words, so a line's variants cost no more than the line. numpy does that
over slices of bounded size, whole texts each.

Defined results: null and empty texts have one empty line, which is never dropped; rows that agree in ``doc_id`` and text
are one document; a null ``doc_id`` is earliest; only ``doc_id`` and ``text`` are read by ``line_decisions``, and
``clean`` keeps all other columns; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import Sieve, checkpointed, hinted, looked_up, sieve, sieved, slices
from verdict.llm.jaccard import INVERSE, IS_SPACE, MULTIPLIER, SLICE, mixed, powers

MIN_WORDS, MIN_CHARS, NEAR_WORDS = 3, 30, 8
#: Base of the running sums over words; odd, so it can be divided out.
BASE = 0xC2B2AE3D27D4EB4F
UNBASE = pow(BASE, -1, 1 << 64)
#: For the second half of contents' hashes.
SECOND = 0x9FB21C651E98DF25
UNSECOND = pow(SECOND, -1, 1 << 64)
FIRST, LAST = np.uint64(0x1111), np.uint64(0x2222)


class Lines(NamedTuple):
    """The lines of some texts: the text and number of each, its first word and its count of words, and running sums."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray
    seconds: np.ndarray  # running sums over second hashes of the words
    chars: np.ndarray  # characters of the line with one blank between words

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``start`` up to ``stop``."""
        return (self.sums[stop] - self.sums[start]) * powers(len(self.hashes) + 1, UNBASE)[start]

    def variants(self, k: int) -> np.ndarray:
        """The hash of line ``k`` without each of its words."""
        s, e = int(self.start[k]), int(self.start[k] + self.words[k])
        ahead = self.sums[s:e] - self.sums[s]
        behind = (self.sums[e] - self.sums[s + 1 : e + 1]) * np.uint64(UNBASE)
        back = np.uint64(pow(UNBASE, s, 1 << 64))
        return mixed((ahead + behind) * back + np.uint64(e - s - 1))


def lines_of(texts: Sequence[str | None]) -> Lines:
    lowered = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\n".join([*lowered, b""]), np.uint8)
    ends = np.flatnonzero(buffer == 10)
    per_text = np.array([t.count(b"\n") + 1 for t in lowered], np.int64)
    text = np.repeat(np.arange(len(lowered)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    space = np.concatenate([[True], IS_SPACE[buffer]])
    edge = np.flatnonzero(np.diff(space.astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(len(buffer), MULTIPLIER))])
    hashes = mixed((sums[end] - sums[begin]) * powers(len(buffer) + 1, INVERSE)[begin])
    stop = np.searchsorted(begin, ends)
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes), BASE))])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(len(buffer), SECOND))])
    second = mixed((other[end] - other[begin]) * powers(len(buffer) + 1, UNSECOND)[begin] + np.uint64(1))
    seconds = np.concatenate([np.zeros(1, np.uint64), np.cumsum(second * powers(len(second), SECOND))])
    letters = np.concatenate([[0], np.cumsum(~space[1:] & ((buffer & 0xC0) != 0x80))])
    opening = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return Lines(text, number, start, stop - start, hashes, running, seconds, letters[ends] - letters[opening] + np.maximum(0, stop - start - 1))


def wholes_of(lines: Lines, pick: np.ndarray) -> np.ndarray:
    """The hashes of whole lines, their number of words included, as ``variants`` has those of lines without a word."""
    s, n = lines.start[pick], lines.words[pick]
    return mixed(lines.part(s, s + n) + n.astype(np.uint64))


def contents_of(lines: Lines, pick: np.ndarray) -> pa.Array:
    """128 bits for each line: what equal lines agree in."""
    s, n = lines.start[pick], lines.words[pick]
    second = mixed((lines.seconds[s + n] - lines.seconds[s]) * powers(len(lines.seconds) + 1, UNSECOND)[s] + n.astype(np.uint64))
    both = np.ascontiguousarray(np.stack([wholes_of(lines, pick), second], 1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pick), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def halves_of(lines: Lines, pick: np.ndarray, near_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, keys): keys of first and last halves, for lines of the same length and of one word less."""
    s, n = lines.start[pick], lines.words[pick]
    half, near = n // 2, n >= near_words
    keys = []
    for p in (half, half - 1):
        p = np.maximum(p, 0)
        size = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys += [mixed(lines.part(s, s + p) + size ^ FIRST), mixed(lines.part(s + n - p, s + n) + size ^ LAST)]
    count = np.where(near, np.where(n % 2 == 0, 4, 2), 0)
    mask = np.arange(4)[None, :] < count[:, None]
    return np.concatenate([[0], np.cumsum(count)]), np.stack(keys, 1)[mask] if len(s) else np.zeros(0, np.uint64)


SLIM = "doc_id long, text_hash long, line int, content binary, halves array<bigint>"


def slim_lines(docs: DataFrame, min_words: int, min_chars: int, near_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            texts = batch.column(2).to_pylist()
            for start, stop in slices(texts, SLICE):
                lines = lines_of(texts[start:stop])
                pick = np.flatnonzero((lines.words >= min_words) | (lines.chars >= min_chars))
                rows = pa.array(lines.text[pick] + start)
                offsets, keys = halves_of(lines, pick, near_words)
                halves = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.take(rows), hashes.take(rows), pa.array(lines.number[pick], pa.int32()), contents_of(lines, pick), halves], ["doc_id", "text_hash", "line", "content", "halves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SLIM)


def full_lines(docs: DataFrame) -> DataFrame:
    """(content, first, whole, keys, hashes) of the lines whose numbers stand in ``wanted``: the hash of the line, the
    hashes of the line without each of its words, and its words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for start, stop in slices(texts, SLICE):
                lines = lines_of(texts[start:stop])
                first = np.searchsorted(lines.text, np.arange(stop - start))
                pick = np.array([first[k - start] + n for k in range(start, stop) for n in sorted(set(wanted[k]))], np.int64)
                rows = pa.array(lines.text[pick] + start)
                place = pa.StructArray.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines.number[pick], pa.int32())], ["doc_id", "text_hash", "line"])
                keys = [lines.variants(k).view(np.int64) for k in pick.tolist()]
                words = [lines.hashes[lines.start[k] : lines.start[k] + lines.words[k]].tobytes() for k in pick.tolist()]
                yield pa.RecordBatch.from_arrays([contents_of(lines, pick), place, pa.array(wholes_of(lines, pick).view(np.int64), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())], ["content", "first", "whole", "keys", "hashes"])

    return docs.mapInArrow(run, f"content binary, first {PLACE}, whole long, keys array<bigint>, hashes binary")


PLACE = "struct<doc_id:bigint,text_hash:bigint,line:int>"


def verified(members: DataFrame) -> DataFrame:
    """The rows (group, content, first) whose words ``a``, without the one at ``at``, are the words ``b`` of the earliest
    content of their group, without the one at ``lead_at``; -1 leaves out none."""

    def rest(raw: bytes, at: int) -> bytes:
        return raw if at < 0 else raw[: 8 * at] + raw[8 * at + 8 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [rest(a.as_py(), p) == rest(b.as_py(), q) for a, b, p, q in zip(batch.column(3), batch.column(4), batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    return members.select("group", "content", "first", "a", "b", "at", "lead_at").mapInArrow(run, f"group binary, content binary, first {PLACE}")


def groups(full: DataFrame) -> DataFrame:
    """(group, content, first, at): contents of a group are within one edit of each other, by their hashes; ``at`` is the
    word that they agree without, -1 for none. Only groups of several contents are given."""
    # Keys that stand more than once, of lines and of variants: the keys alone are shuffled, and then only rows that have one.
    every = full.select(F.explode(F.concat("keys", F.array("whole"))).alias("key"))
    shared = checkpointed(every.groupBy("key").count().where("count > 1").select("key"))
    marks = sieve(shared)
    emitted = full.select("content", "first", F.posexplode("keys").alias("at", "key")).where(sieved(marks, F.col("key")))
    emitted = checkpointed(emitted.join(hinted(shared), "key"))
    # Replacements: the same words but for the one at a place.
    swaps = emitted.repartition("key", "at")
    several = swaps.groupBy("key", "at").count().where("count > 1").select("key", "at")
    swapped = swaps.join(several, ["key", "at"]).select(F.concat_ws(",", F.col("key").cast("string"), F.col("at").cast("string")).cast("binary").alias("group"), "content", "first", "at")
    # Insertions: a line that another is without one of its words. A pair is a group of its own.
    whole = full.where(sieved(marks, F.col("whole"))).select(F.col("whole").alias("key"), F.col("content").alias("shorter"), F.col("first").alias("shorter_first"))
    pairs = emitted.join(hinted(whole), "key").where(F.col("content") != F.col("shorter")).dropDuplicates(["content", "shorter"])
    name = F.concat("shorter", "content")
    sides = F.array(F.struct("content", "first", "at"), F.struct(F.col("shorter").alias("content"), F.col("shorter_first").alias("first"), F.lit(-1).alias("at")))
    return swapped.unionByName(pairs.select(name.alias("group"), F.explode(sides).alias("s")).select("group", "s.*"))


def once(full: DataFrame) -> DataFrame:
    """``full`` with each content once: rows that agree in ``doc_id`` and text give it again. Only the contents are shuffled
    where none does."""
    full = checkpointed(full.withColumn("row", F.monotonically_increasing_id()))
    again = checkpointed(full.groupBy("content").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("content").alias("twice"), "kept"))
    if again.isEmpty():
        return full
    return checkpointed(full.join(hinted(again), F.col("content") == F.col("twice"), "left").where(F.col("twice").isNull() | (F.col("row") == F.col("kept"))).drop("twice", "kept"))


def survivors(members: DataFrame) -> DataFrame:
    """(content, near_first): the contents that are dropped, and the earliest near one that stays.

    ``members`` has group, content and first. In a round every group names its earliest content that is left. Contents
    that all their groups name stay; those that a staying one comes before in a group go. Rounds end when none is open;
    their number is the length of the longest chain of lines each of which depends on the one before, at most.
    """
    alive = members.withColumn("stays", F.lit(False))
    while True:
        leads = alive.groupBy("group").agg(F.min(F.struct("first", "stays")).alias("lead"))
        seen = alive.join(leads, "group").groupBy("content").agg(F.bool_and(F.col("first") == F.col("lead.first")).alias("stays"), F.bool_or(F.col("lead.stays") & (F.col("lead.first") < F.col("first"))).alias("goes"))
        alive = checkpointed(alive.drop("stays").join(seen, "content").where(~F.col("goes")).drop("goes"))
        if alive.where(~F.col("stays")).isEmpty():
            break
    kept = alive.groupBy("group").agg(F.min("first").alias("kept_first"))
    return members.join(kept, "group").where(F.col("kept_first") < F.col("first")).groupBy("content").agg(F.min("kept_first").alias("near_first"))


def marks_of(rows: DataFrame) -> Sieve:
    """A sieve of the contents of ``rows``, by their ``xxhash64``."""
    return sieve(rows.select(F.xxhash64("content").alias("x")))


def line_decisions(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, line, kept_doc_id, kept_text_hash, kept_line, distance) per dropped line."""
    docs = docs.select("doc_id", "text")
    slim = checkpointed(slim_lines(docs, min_words, min_chars, near_words))
    place = F.struct("doc_id", "text_hash", "line")
    contents = checkpointed(slim.groupBy("content").agg(F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("repeated"), F.first("halves").alias("halves")))

    # Contents that share a half with another content.
    shared = checkpointed(contents.select(F.explode("halves").alias("half")).groupBy("half").count().where("count > 1").select("half"))
    halved = contents.select("first", F.explode("halves").alias("half")).where(sieved(sieve(shared), F.col("half")))
    # An inner join, as a semi-join would be pushed below the sieve and shuffle all halves.
    likely = halved.join(hinted(shared), "half")

    # Their words, from the line where each stands first.
    wanted = checkpointed(likely.groupBy(F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h")).agg(F.collect_set("first.line").alias("wanted")))
    texts = looked_up(docs, wanted)
    full = once(full_lines(texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("h").alias("text_hash"), "text", "wanted")))

    # Groups of near contents, each verified against its earliest.
    near = checkpointed(groups(full))
    words = full.select("content", "hashes").where(sieved(marks_of(near), F.xxhash64("content")))
    lead = near.groupBy("group").agg(F.min(F.struct("first", "content", "at")).alias("lead")).select("group", F.col("lead.content").alias("lead_content"), F.col("lead.at").alias("lead_at"))
    paired = near.join(lead, "group").join(words.withColumnRenamed("hashes", "a"), "content").join(words.select(F.col("content").alias("lead_content"), F.col("hashes").alias("b")), "lead_content")
    near = checkpointed(survivors(checkpointed(verified(paired))))

    # Lines that stand once and have no near one are not dropped; only the others are looked up.
    judged = contents.select("content", "first", "repeated").where(F.col("repeated") | sieved(marks_of(near), F.xxhash64("content"))).join(near, "content", "left").where(F.col("repeated") | F.col("near_first").isNotNull()).drop("repeated")
    judged = checkpointed(judged)
    dropped = slim.select("content", place.alias("place")).where(sieved(marks_of(judged), F.xxhash64("content"))).join(hinted(judged), "content").where((F.col("place") != F.col("first")) | F.col("near_first").isNotNull())
    kept = F.coalesce("near_first", "first")
    out = dropped.select("place.*", kept.alias("kept"), F.when(F.col("near_first").isNotNull(), 1).otherwise(0).alias("distance"))
    return out.select("doc_id", "text_hash", "line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.text_hash").alias("kept_text_hash"), F.col("kept.line").alias("kept_line"), "distance").distinct()


def clean(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, text: str = "text") -> DataFrame:
    """``docs`` without their dropped lines, with the columns they came with; ``n_chars`` follows the text where present.

    Documents of which nothing but blank lines is left go; of such as never had words, all stay.
    """
    names = {c.lower() for c in docs.columns}
    gone, left, doc, own = (next(n for n in (base + "_" * k for k in range(len(names) + 1)) if n not in names) for base in ("gone", "left", "doc_of_lines", "hash_of_lines"))
    dropped = line_decisions(docs.select("doc_id", F.col(text).alias("text")), min_words, near_words)
    lines = dropped.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(own)).agg(F.collect_set("line").alias(gone))
    joined = docs.join(lines, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(own)), "left")
    rest = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line, k: ~F.coalesce(F.array_contains(gone, k), F.lit(False)))
    joined = joined.withColumn(left, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")))
    joined = joined.where(F.col(gone).isNull() | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    columns = {text: F.col(left)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
