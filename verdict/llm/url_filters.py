"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Every glob is packed into one row of bits: a start bit, a bit per literal, and self-loops for its wildcards. ``*`` stands
for any characters but ``/``, ``**`` for any characters. All globs advance together, one byte of all URLs of a batch at
a time: ``D = ((D << 1) & B[byte]) | (D & S[byte])`` with the shift carried across 64-bit words.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no glob; host and path are those
of the canonical URL, whose host alone is lower-cased; repeated rows give repeated, equal rows; other columns are not
read. The work is per row, so a lost executor costs only its tasks; memory is bounded by slices of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


#: Globs over host and path that block a URL on which no rule decides.
BLOCKED = ("**casino**", "**free-bets**", "**adult-**", "**porn**", "**xxx**", "**viagra**", "**poker-**", "**slots-**", "**-bets.**", "**/ads/**", "**/track/click**")


class Automaton:
    """All globs in one row of 64-bit words."""

    def __init__(self, globs: Sequence[str]) -> None:
        bits, loops, slash_free, self.starts, self.finals = [], [], [], [], []
        for glob in globs:
            self.starts.append(len(bits))
            bits.append(None)
            loops.append(False)
            slash_free.append(False)
            raw, at = glob.encode(), 0
            while at < len(raw):
                if raw[at : at + 1] == b"*":
                    wide = raw[at : at + 2] == b"**"
                    slash_free[-1] = not wide and (slash_free[-1] or not loops[-1])
                    loops[-1] = True
                    at += 1 + wide
                else:
                    bits.append(raw[at])
                    loops.append(False)
                    slash_free.append(False)
                    at += 1
            self.finals.append(len(bits) - 1)
        self.words = -(-len(bits) // 64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        for k, (byte, loop, narrow) in enumerate(zip(bits, loops, slash_free)):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            if byte is None:
                self.first[word] |= bit
            else:
                self.step[byte, word] |= bit
            if loop:
                self.stay[:, word] |= bit
                if narrow:
                    self.stay[ord("/"), word] &= ~bit

    def matches(self, urls: Sequence[bytes]) -> np.ndarray:
        """A row per URL, a column per glob. URLs are taken in order of length, so that no step runs on finished ones."""
        out = np.zeros((len(urls), len(self.finals)), bool)
        order = sorted(range(len(urls)), key=lambda k: -len(urls[k]))
        lengths = np.array([len(urls[k]) for k in order], np.int64)
        state = np.tile(self.first, (len(order), 1))
        text = np.frombuffer(b"".join(urls[k] for k in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        for at in range(int(lengths[0]) if len(order) else 0):
            n = int(np.searchsorted(-lengths, -at, "left"))
            seen, now = text[begin[:n] + at], state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[seen]) | (now & self.stay[seen])
        for column, bit in enumerate(self.finals):
            out[order, column] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL in canonical form."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((k for k in (rest.find(c) for c in "?#") if k >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {k: k + 32 for k in range(65, 91)}


def judge(pages: DataFrame, rules: Sequence[Rule], blocked: Sequence[str] = BLOCKED, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, pattern) per row: the longest fitting rule decides, else the first fitting glob blocks,
    else the URL is allowed."""
    rules = sorted(rules, key=lambda r: (-len(r.name), r.name))
    globs = [g for r in rules for g in r.globs] + list(blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                split = [parts(u) for u in batch.column(1).slice(start, 4096).to_pylist()]
                fits = automaton.matches([(h + p).encode("utf-8", "surrogatepass") for h, p in split])
                by_rule = fits[:, : 2 * len(rules)].reshape(len(split), len(rules), 2).any(2)
                rest = fits[:, 2 * len(rules) :]
                names, verdicts, hits = [], [], []
                for (host, _), r, b in zip(split, by_rule, rest):
                    rule = rules[int(r.argmax())] if r.any() else None
                    hit = blocked[int(b.argmax())] if len(b) and b.any() else None
                    names.append(rule.name if rule else None)
                    hits.append(hit)
                    verdicts.append(rule.action if rule else "block" if hit else "allow")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 4096), *(pa.array(x, pa.string()) for x in ([h for h, _ in split], [p for _, p in split], names, verdicts, hits))], [key, "host", "path", "rule", "verdict", "pattern"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(url).alias(url)).mapInArrow(run, f"`{key}` long, host string, path string, rule string, verdict string, pattern string")

