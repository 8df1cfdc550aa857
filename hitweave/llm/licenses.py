"""License scan with a generalised suffix automaton of license texts.

The automaton holds every run of words of all templates.  A text's words walk through it, which
gives at each word the longest run ending there that some template contains (the matching
statistics).  Long maximal matches are chained, per template and in the order of both sides, into
covered spans; a template that a chain covers far enough gives its label.  The base phrases are
templates too: they are found where the current match has one as its end.

Only stretches in which every pair of neighbouring words is a pair of some template are walked;
elsewhere matches have at most one word.

Defined results: a null or empty text has no words and no labels; a text of any length is walked
whole, word by word, in memory that grows with its words; repeated rows give repeated results; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.license_texts import PHRASES, TEMPLATES, templates

#: Matches of fewer words don't begin a chain; from PAIR words on they join one.
MIN_MATCH = 4
PAIR = 2
#: Covered share of a template that gives its label.
COVERED = 0.6
#: Words between two matches of a chain.
GAP = 12

# Words are ASCII letters and digits and everything beyond ASCII; A-Z count as a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the places where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefixes = []
        for sequence in sequences:
            last, own = 0, []
            for word in sequence:
                last = self._extend(last, word)
                own.append(last)
            prefixes.append(own)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for t, sequence in enumerate(sequences):
            at = 0
            for i, word in enumerate(sequence):
                at = self.next[at][word]
                self.ends[at].append((t, i + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, word: int) -> int:
        """The state of parent's longest run followed by word, cut out of a longer one if need be."""
        there = self.next[parent][word]
        if self.length[there] == self.length[parent] + 1:
            return there
        own = self._state(self.length[parent] + 1, dict(self.next[there]), self.link[there])
        while parent >= 0 and self.next[parent].get(word) == there:
            self.next[parent][word] = own
            parent = self.link[parent]
        self.link[there] = own
        return own

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new


class Scanner:
    def __init__(self, known=None, phrases=PHRASES):
        known = templates() if known is None else known
        sequences = [(label, words_of(text)) for label, text in known] + [(label, words_of(text)) for text, label in phrases]
        self.labels = [label for label, _ in sequences]
        self.sizes = [len(s) for _, s in sequences]
        self.first_phrase = len(known)
        vocabulary = sorted({w for _, s in sequences for w in s})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        coded = [[self.ids[w] for w in s] for _, s in sequences]
        self.auto = Automaton(coded)
        self.pair = np.zeros((len(vocabulary) + 1,) * 2, bool)
        for s in coded:
            self.pair[s[:-1], s[1:]] = True
        # for each state the phrases that end its longest run: (words, label)
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.auto.next]
        for t in range(self.first_phrase, len(sequences)):
            at = 0
            for word in coded[t]:
                at = self.auto.next[at][word]
            for state in range(1, len(self.auto.next)):
                up = state
                while up > 0 and up != at:
                    up = self.auto.link[up]
                if up == at:
                    self.phrases[state].append((self.sizes[t], self.labels[t]))

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of runs of two or more words whose neighbouring pairs all occur in templates."""
        ok = np.zeros(len(ids) + 1, np.int8)
        if len(ids) > 1:
            ok[1:-1] = self.pair[ids[:-1], ids[1:]]
        edge = np.flatnonzero(np.diff(ok))
        return list(zip(edge[0::2].tolist(), (edge[1::2] + 1).tolist(), strict=True))

    def scan(self, text: str):
        """(number of words, base places as (start, label), spans as (label, start, end, covered share))."""
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int32, count=len(words))
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # start, end, state
        follow, link, length = self.auto.next, self.auto.link, self.auto.length
        for start, end in self.stretches(ids):
            state, size, before = 0, 0, 0
            for i, word in enumerate(ids[start:end].tolist(), start):
                before, was = size, state
                while state and word not in follow[state]:
                    state = link[state]
                    size = length[state]
                if word in follow[state]:
                    state, size = follow[state][word], size + 1
                if before >= PAIR and size <= before:
                    matches.append((i - before, i, was))
                for n, label in self.phrases[state]:
                    if n <= size:
                        base.append((i + 1 - n, label))
            if size >= PAIR:
                matches.append((end - size, end, state))
        return len(words), base, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches in the order of text and template that cover a template far enough."""
        chains: dict[int, list[list[int]]] = {}  # by template: [text start, text end, template end, covered]
        done: list[tuple[int, list[int]]] = []
        latest = -GAP - 1  # where the last chain ends
        for start, end, state in matches:
            short = end - start < MIN_MATCH
            if short and start - latest > GAP:
                continue
            seen: set[int] = set()
            for t, _ in self.auto.ends[state]:
                if t >= self.first_phrase or t in seen or (short and t not in chains):
                    continue
                alive = []
                for c in chains.get(t, []):
                    (alive if start - c[1] <= GAP else done).append(c if start - c[1] <= GAP else (t, c))
                chains[t] = alive
                places = [e for u, e in self.auto.ends[state] if u == t]
                seen.add(t)
                best = None
                for place in places:
                    for c in alive:
                        # what overlaps on either side counts once
                        new = min(end - max(start, c[1]), place - max(place - (end - start), c[2]))
                        far = short and place - (end - start) - c[2] > GAP
                        if new > 0 and not far and (best is None or c[3] + new > best[0]):
                            best = (c[3] + new, c, place)
                if best and short:  # it may have joined at the wrong place, so the chain goes on without it as well
                    alive.append([best[1][0], end, best[2], best[0]])
                elif best:
                    best[1][1], best[1][2], best[1][3] = end, best[2], best[0]
                elif not short:
                    alive.append([start, end, places[0], end - start])
                if best or not short:
                    latest = max(latest, end)
        done += [(t, c) for t, own in chains.items() for c in own]
        return self.preferred([(t, c) for t, c in done if c[3] >= COVERED * self.sizes[t]])

    def preferred(self, found: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """The spans of chains, but for those beside a chain of another label, or of the same template, that covers as much and skips less."""
        runs: list[list[tuple[int, list[int], int]]] = []  # of overlapping chains: template, chain, words of text and template it skips
        upto = -1
        for t, c in sorted(found, key=lambda f: f[1][0]):
            if c[0] >= upto:
                runs.append([])
            runs[-1].append((t, c, c[1] - c[0] - c[3] + self.sizes[t] - c[3]))
            upto = max(upto, c[1])
        out = set()
        for run in runs:
            for t, c, own in run:
                better = (
                    (u == t or self.labels[u] != self.labels[t]) and d[0] < c[1] and c[0] < d[1] and d[3] >= c[3] and other <= own and (d[3], other) != (c[3], own)
                    for u, d, other in run
                )
                if not any(better):
                    out.add((self.labels[t], c[0], c[1], c[3] / self.sizes[t]))
        return sorted(out, key=lambda s: (s[1], s[0], s[2]))


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def _joined(labels) -> str:
    return ",".join(sorted(set(labels)))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered spans (in words)."""
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    schema = (
        f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"
    )

    def row(text: str) -> tuple:
        n, base, spans = scanner().scan(text)
        starts, labels = [b[0] for b in base], [b[1] for b in base]
        score = 1.0 if base else max((s[3] for s in spans), default=0.0)
        found = [dict(zip(("label", "start", "end", "covered"), s, strict=True)) for s in spans]
        return n, len(base), min(starts, default=None), max(starts, default=None), _joined(labels), _joined([*labels, *(s[0] for s in spans)]), min(score, 1.0), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)
