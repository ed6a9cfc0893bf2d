"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from a bounded sample of labelled documents: words, and stems with several endings, that mark label
1 beyond chance. All terms stand in one trie; the Levenshtein automaton of one edit is intersected with it and made
deterministic, so that a text is scanned with one table lookup per letter while a match is still possible. An edit
replaces, inserts or deletes a letter or swaps two neighbours. Each hit is weighed by its context window: quotation, told
by marks around it or around the passage that it stands in, and words of reporting lower it, other hits and direct address
raise it.
A logistic layer over a document's hits gives the score.

Defined results: null and empty texts, and texts without hits, get the score of the bias; repeated rows get equal scores;
without training rows of both classes the lexicon is empty; columns other than the id and the text are not read. Texts are
scanned whole, in slices of bounded size per batch; the work is per row, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from math import exp, lgamma, log, log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.training import held_out, training_rows

#: Words of fewer letters than FUZZY_FROM, stems of fewer than STEM_FUZZY_FROM and terms that are not pure must match
#: exactly; the first letter takes an edit in terms of FIRST_FROM letters or more. Stems have up to STEM_LETTERS letters.
FUZZY_FROM, STEM_FUZZY_FROM, FIRST_FROM, STEM_LETTERS, WINDOW, MAX_ROWS = 5, 7, 6, 16, 6, 6_000
#: The least share of label 1 among the documents that hold a stem, for one that is not pure.
MIXED = 0.35
TOKEN = re.compile(r"[^\W_]+")
#: Letters that digits stand for in disguised words.
LEET = dict(zip("013457", "oieast"))
QUOTES = frozenset("\"'“”„‟«»‹›‘’`")
#: Pairs of marks around a quoted passage; a passage ends with its line.
PASSAGES = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›"}
MARKS = re.compile("[\n\"“”„«»‹›]")
REPORTING = frozenset("said says say quote quoted quotes called word term slur insult insults wrote writes dit mot terme écrit sagte wort begriff schrieb dijo palabra término escribió".split())
ADDRESS = frozenset("you your yours u ur du dich dein ihr tu toi vous tú usted eres te".split())


class Term(NamedTuple):
    text: str
    stem: bool  # also fits words that go on after it
    pure: bool = True  # else documents of label 0 hold it too, though less often

    @property
    def edits(self) -> int:
        return int(self.pure and len(self.text) >= (STEM_FUZZY_FROM if self.stem else FUZZY_FROM))


class Automaton:
    """Deterministic automaton for all words within one edit of a term, where the term takes edits.

    ``table[state, class]`` is the next state, 0 the dead one. ``term[state]`` and ``distance[state]`` tell what a word
    matches that ends in the state (-1: nothing); ``final[state]`` marks states in which a stem has matched already.

    A state is a set of places in the trie, each with the edits spent: none, one (INNER), or one on the first letter
    (FIRST). A place is a node, or a node and the letter that a swap still needs to get there.
    """

    INNER, FIRST = 1, 2

    def __init__(self, terms: Sequence[Term]) -> None:
        self.terms = list(terms)
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        takes: list[set[int]] = [set()]  # the kinds of edits that some term below takes
        for k, term in enumerate(self.terms):
            kinds = ({self.INNER} | ({self.FIRST} if len(term.text) >= FIRST_FROM else set())) if term.edits else set()
            node = 0
            for c in term.text:
                takes[node] |= kinds
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    takes.append(set())
                node = children[node][c]
            takes[node] |= kinds
            ends[node].append(k)
        letters = sorted({c for t in self.terms for c in t.text})
        self.classes = {c: k + 1 for k, c in enumerate(letters)}

        def put(found: dict, place, e: int) -> None:
            found[place] = min(found.get(place, 9), e)

        def close(found: dict) -> frozenset:
            """Adds what a letter that the word lacks leads to."""
            for node, e in list(found.items()):
                if e == 0 and isinstance(node, int):
                    kind = self.INNER if node else self.FIRST
                    for child in children[node].values():
                        if kind in takes[child] and not any(self.terms[k].stem for k in ends[child]):
                            put(found, child, kind)
            return frozenset(found.items())

        def verdict(state: frozenset) -> tuple[int, int, bool]:
            hits = [(int(e > 0), -len(self.terms[k].text), k) for node, e in state if isinstance(node, int) for k in ends[node] if e == 0 or self.terms[k].edits and (e == self.INNER or len(self.terms[k].text) >= FIRST_FROM)]
            if not hits:
                return -1, 0, False
            e, _, k = min(hits)
            return k, e, any(self.terms[k].stem for _, _, k in hits)

        def after(state: frozenset, c: str) -> frozenset:
            found: dict = {}
            for place, e in state:
                if not isinstance(place, int):
                    if place[1] == c:
                        put(found, place[0], e)
                    continue
                kind = self.INNER if place else self.FIRST
                for letter, child in children[place].items():
                    if letter == c:
                        put(found, child, e)
                    elif e == 0:
                        if kind in takes[child]:
                            put(found, child, kind)
                        swapped = children[child].get(c)
                        if swapped is not None and kind in takes[swapped]:
                            put(found, (swapped, letter), kind)
                if e == 0 and kind in takes[place]:
                    put(found, place, kind)
            return close(found)

        first = close({0: 0})
        number = {frozenset(): 0, first: 1}
        rows, queue = [[0] * (len(letters) + 1)], [first]
        term, distance, final = [-1], [0], [False]
        for state in queue:
            k, e, done = verdict(state)
            term.append(k)
            distance.append(e)
            final.append(done)
            row = []
            for c in ["", *letters]:
                goes = frozenset() if done else after(state, c)
                if goes not in number:
                    number[goes] = len(number)
                    queue.append(goes)
                row.append(number[goes])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.term, self.distance, self.final = np.array(term), np.array(distance), np.array(final)

    @cached_property
    def code(self) -> np.ndarray:
        """The class of every code point; made anew in each process."""
        out = np.zeros(0x110000, np.int32)
        for c, k in self.classes.items():
            out[ord(c)] = k
        for digit, c in LEET.items():
            out[ord(digit)] = self.classes.get(c, 0)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "code"}

    def scan(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words ``codes[begin:end]`` match: their indexes, terms and distances."""
        code = self.code
        state = np.ones(len(begin), np.int32)
        alive = np.flatnonzero(end > begin)
        at = begin.copy()
        while len(alive):
            now = self.table[state[alive], code[codes[at[alive]]]]
            state[alive] = now
            at[alive] += 1
            alive = alive[(now != 0) & ~self.final[now] & (at[alive] < end[alive])]
        hit = np.flatnonzero(self.term[state] >= 0)
        return hit, self.term[state[hit]], self.distance[state[hit]]


_IS_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.array([chr(c).isalnum() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    return _IS_LETTER


def passages(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the passages between marks of quotation, one after the other, found in one pass."""
    out, opened = [], None
    for m in MARKS.finditer(text):
        if m[0] == "\n":
            opened = None
        elif opened is not None and m[0] in PASSAGES[text[opened]]:
            out.append((opened, m.start()))
            opened = None
        elif opened is None and m[0] in PASSAGES:
            opened = m.start()
    return out


class Hit(NamedTuple):
    term: int
    distance: int
    quoted: bool
    weight: float
    begin: int
    end: int


class Model(NamedTuple):
    automaton: Automaton
    innocent: frozenset[str]  # words near a term that occur in documents of label 0
    layer: tuple[float, ...]

    def hits(self, texts: Sequence[str | None], slice_chars: int = 1_000_000) -> Iterator[tuple[int, list[Hit]]]:
        """(index, hits) of the lower-cased texts that have any. Whole texts are scanned in slices, so memory is bounded."""
        start = 0
        while start < len(texts):
            stop, total = start, 0
            while stop < len(texts) and (stop == start or total + len(texts[stop] or "") <= slice_chars):
                total += len(texts[stop] or "")
                stop += 1
            for k, found in self._scan(texts[start:stop]):
                yield start + k, found
            start = stop

    def _scan(self, texts: Sequence[str | None]) -> Iterator[tuple[int, list[Hit]]]:
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.flatnonzero(np.diff(letters()[codes].astype(np.int8)))
        begin, end = edge[::2] + 1, edge[1::2] + 1
        if not self.automaton.terms or not len(begin):
            return
        where, terms, distances = self.automaton.scan(codes, begin, end)
        starts = np.concatenate([[1], np.cumsum([len(t) + 1 for t in lowered]) + 1])
        owner = np.searchsorted(starts, begin[where], "right") - 1
        by_text: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, w, t, d in zip(owner.tolist(), where.tolist(), terms.tolist(), distances.tolist()):
            by_text[k].append((w, t, d))
        for k, found in by_text.items():
            text, base = lowered[k], int(starts[k])
            word = lambda w: text[begin[w] - base : end[w] - base]  # noqa: E731, B023
            found = [(w, t, d) for w, t, d in found if not d or word(w) not in self.innocent]
            at = [w for w, _, _ in found]
            first, last = np.searchsorted(begin, base), np.searchsorted(begin, base + len(text))
            out, quotes = [], passages(text) if found else []
            for w, t, d in found:
                near = range(max(int(first), w - WINDOW), min(int(last), w + WINDOW + 1))
                around = {word(x) for x in near if x != w}
                a, b = int(begin[w]) - base, int(end[w]) - base
                marked = a > 0 and text[a - 1] in QUOTES and b < len(text) and text[b] in QUOTES
                inside = bisect_right(quotes, (a, len(text))) - 1
                quoted = marked or inside >= 0 and b <= quotes[inside][1] or bool(around & REPORTING)
                others = sum(abs(x - w) <= WINDOW for x in at) - 1
                weight = (0.3 if quoted else 1.0) * (1 + 0.25 * min(3, others)) * (1.25 if around & ADDRESS else 1.0)
                out.append(Hit(t, d, quoted, weight, a, b))
            if out:
                yield k, out

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.full(len(texts), logistic(self.layer, [0.0] * 5))
        for k, found in self.hits(texts):
            out[k] = logistic(self.layer, inputs(found, self.automaton.terms))
        return out


def inputs(hits: Iterable[Hit], terms: Sequence[Term]) -> list[float]:
    """Plain hits of pure terms, the same with an edit, quoted ones, distinct terms, and hits of terms that are not pure."""
    plain = [h for h in hits if not h.quoted]
    pure = [h for h in plain if terms[h.term].pure]
    return [
        log1p(sum(h.weight for h in pure if not h.distance)),
        log1p(sum(h.weight for h in pure if h.distance)),
        log1p(sum(h.weight for h in hits if h.quoted)),
        log1p(max(0, len({h.term for h in pure}) - 1)),
        float(sum(not terms[h.term].pure for h in plain)),
    ]


def logistic(layer: Sequence[float], x: Sequence[float]) -> float:
    return 1 / (1 + exp(-max(-40.0, min(40.0, layer[0] + sum(w * v for w, v in zip(layer[1:], x))))))


#: What the layer is before it sees data: the bias, and a weight for each of ``inputs``.
PRIOR = (-3.0, 6.0, 5.0, 1.0, 1.0, 1.5)


def chance(ones: int, total: int, base: float) -> float:
    """The probability that at least ``ones`` of ``total`` draws are ones, summed from its largest term on."""
    if ones <= 0:
        return 1.0
    term = exp(lgamma(total + 1) - lgamma(ones + 1) - lgamma(total - ones + 1) + ones * log(base) + (total - ones) * log(1 - base))
    out, odds = 0.0, base / (1 - base)
    for k in range(ones, total + 1):
        out += term
        if k * (1 - base) > total * base and term < 1e-12 * out:
            break
        term *= odds * (total - k) / (k + 1)
    return min(1.0, out)


def learn_terms(rows: Sequence[tuple[str, int]], purity: float = 0.9, level: float = 0.01) -> list[Term]:
    """Words and stems that mark label 1 beyond chance, by the number of different documents that hold them.

    Copies of a document count once: documents with the same least hash of five-word shingles are one.
    """
    groups: dict[int, int] = {}

    def read(wanted: int) -> Iterator[tuple[int, set[str]]]:
        for text, label in rows:
            if int(label == 1) == wanted:
                words = TOKEN.findall(text.lower())
                group = min((zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))), default=0)
                groups[group] = max(groups.get(group, 0), wanted)
                yield group, set(words)

    # Plain counts first: only beginnings that several documents hold get sets of their own.
    begun: Counter[str] = Counter()
    for _, found in read(1):
        begun.update({word[:n] for word in found for n in range(3, min(STEM_LETTERS, len(word)) + 1)})
    ones: dict[str, set[int]] = defaultdict(set)
    stems_one: dict[str, set[int]] = defaultdict(set)
    endings: dict[str, set[str]] = defaultdict(set)
    for group, found in read(1):
        for word in found:
            ones[word].add(group)
            for n in range(3, min(STEM_LETTERS, len(word)) + 1):
                if begun[word[:n]] >= 4:
                    stems_one[word[:n]].add(group)
                    endings[word[:n]].add(word)
    del begun
    stems_one = {x: a for x, a in stems_one.items() if len(a) >= 4 and len(endings[x]) >= 4}
    # Of the other documents only what stands in these counts, so memory follows the rows of label 1.
    zeros: dict[str, set[int]] = defaultdict(set)
    stems_zero: dict[str, set[int]] = defaultdict(set)
    for group, found in read(0):
        for word in found:
            if word in ones:
                zeros[word].add(group)
            for n in range(3, min(STEM_LETTERS, len(word)) + 1):
                if word[:n] in stems_one:
                    stems_zero[word[:n]].add(group)
    if not groups or not 0 < sum(groups.values()) < len(groups):
        return []
    base = sum(groups.values()) / len(groups)
    sizes = Counter(len(ones[w] | zeros[w]) if w in zeros else len(ones[w]) for w in ones)

    def marks(a: set[int], b: set[int], candidates: int, share: float, odds: float) -> bool:
        n = len(a | b)
        return len(a) >= 3 and len(a) >= share * n and chance(len(a), n, base) * candidates < odds

    empty: set[int] = set()
    count = Counter(len(a) for a in stems_one.values())
    terms: list[tuple[int, Term]] = []
    for pure, share, odds in ((True, purity, level), (False, MIXED, level / 100)):
        good = {x: len(a) for x, a in stems_one.items() if len(a) >= 4 and len(endings[x]) >= (4 if len(x) > 3 else 8) and 2 * max(len(ones.get(w, empty)) for w in endings[x]) <= len(a) and marks(a, stems_zero.get(x, empty), count[len(a)], share, odds)}
        done: list[str] = [t.text for _, t in terms]
        for s in sorted(good, key=lambda x: (len(x), x)):
            if any(s.startswith(x) or x.startswith(s) for x in done):
                continue
            best = s
            while longer := [x for x in good if len(x) == len(best) + 1 and x.startswith(best) and good[x] >= 0.95 * good[s]]:
                best = longer[0]
            done.append(best)
            terms.append((good[best], Term(best, True, pure)))
    words = {w: len(a) for w, a in ones.items() if len(w) >= 3 and not w.isdigit() and marks(a, zeros.get(w, empty), sizes[len(a | zeros.get(w, empty))], purity, level)}
    stems = tuple(t.text for _, t in terms)
    terms += [(n, Term(w, False)) for w, n in words.items() if not w.startswith(stems)]
    return [t for _, t in sorted(terms, key=lambda x: (-x[0], x[1]))]


def train(rows: Sequence[tuple[str, int]], steps: int = 40, pull: float = 0.0005) -> Model:
    """Fits lexicon, exceptions and layer. Newton's steps find the layer; PRIOR holds it where data are silent."""
    terms = learn_terms(rows)
    automaton = Automaton(terms)
    bare = Model(automaton, frozenset(), PRIOR)
    innocent = set()
    texts = [t for t, _ in rows]
    for k, found in bare.hits(texts):
        if rows[k][1] != 1:
            lowered = texts[k].lower()
            innocent |= {lowered[h.begin : h.end] for h in found if h.distance}
    model = bare._replace(innocent=frozenset(innocent))
    x = np.zeros((len(rows), 6))
    x[:, 0] = 1
    for k, found in model.hits(texts):
        x[k, 1:] = inputs(found, terms)
    y = np.array([int(label == 1) for _, label in rows], float)
    w, prior = np.array(PRIOR), np.array(PRIOR)
    hold = np.diag([1e-6, *[pull] * 5])
    for _ in range(steps if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - y) / len(rows) + hold @ (w - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(rows) + hold, slope)
        w = w - move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
    return model._replace(layer=tuple(w.tolist()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    return train(training_rows(docs, labels, label, max_rows))


def with_scores(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    """``docs`` with the score of every whole text in column ``out``; all other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [sent.value.scores(batch.slice(k, 1024).to_pylist()) for k in range(0, len(batch), 1024)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels, label, max_rows), "text", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
