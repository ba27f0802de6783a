"""Substring dedup of word runs with suffix automata of reference shards.

A run of ``WINDOW`` consecutive words is removed wherever it is not its first
occurrence. Only text around shared anchors can hold such runs (see
``anchors``); it is addressed to reference shards, each made of the documents that first had
the anchors. A shard's documents are streamed in order of place through a suffix
automaton of its reference text. The matching statistics (the longest suffix
of what was read that the automaton knows) tell the repeated windows; new windows
join the automaton. A shard that would be too much for one task is
dealt over several, each of which gets the reference text, so an automaton is
sent only to the tasks that need it and never to the whole cluster.

Defined cases: null and empty texts have no words and are kept as they are; rows with the
same doc_id and text are one document; a null doc_id comes before all
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import cut_rows, keyed, repeated_runs, window_digest
from .common import WordHasher, rolled

WINDOW = 20
INNER = 8
HOME_ANCHORS = 60_000  # of one shard in one task: about half a million words


class SuffixAutomaton:
    """All substrings of the runs put in, over whole-number symbols."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _split(self, before: int, symbol: int, state: int) -> int:
        """A copy of ``state`` for its strings that end ``before`` + symbol."""
        step, link, size = self.step, self.link, self.size
        copy = len(step)
        step.append(dict(step[state]))
        link.append(link[state])
        size.append(size[before] + 1)
        link[state] = copy
        while before != -1 and step[before].get(symbol) == state:
            step[before][symbol] = copy
            before = link[before]
        return copy

    def put(self, last: int, symbol: int) -> int:
        """Lengthens the run whose state is ``last`` (0 for a new run); gives its new state."""
        step, link, size = self.step, self.link, self.size
        known = step[last].get(symbol)
        if known is not None:
            return known if size[known] == size[last] + 1 else self._split(last, symbol, known)
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at != -1 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at != -1:
            known = step[at][symbol]
            link[new] = known if size[known] == size[at] + 1 else self._split(at, symbol, known)
        return new

    def repeats(self, symbols: list[int], least: int) -> list[bool]:
        """For each symbol, whether the ``least`` symbols that end there were met before,
        here or in earlier calls. Windows not met before are put in."""
        step, link, size = self.step, self.link, self.size
        out, state, known, last, open_run = [], 0, 0, 0, False
        for i, symbol in enumerate(symbols):
            while state and symbol not in step[state]:
                state = link[state]
                known = size[state]
            to = step[state].get(symbol)
            if to is None:
                known = 0
            else:
                state, known = to, known + 1
            met = known >= least
            out.append(met)
            if met:
                open_run = False
            elif i + 1 >= least:
                if open_run:
                    last = self.put(last, symbol)
                else:
                    last = 0
                    for one in symbols[i + 1 - least : i + 1]:
                        last = self.put(last, one)
                    open_run = True
                state, known = last, size[last]  # the next symbol leads on from other places only
        return out


_hashers: list[WordHasher] = []


def word_hashes(raw: bytes) -> np.ndarray:
    if not _hashers:
        _hashers.append(WordHasher())
    return rolled(_hashers[0](raw.split()), INNER)


def word_slices(raw: bytes):
    words = raw.split()
    return len(words), lambda start, stop: b" ".join(words[start:stop])


def match_shards(groups: Iterator[list[tuple]]) -> Iterator[tuple]:
    """Repeated runs of each shard; new windows too where other tasks hold parts of the shard."""
    for group in groups:
        automaton, ids = SuffixAutomaton(), {}
        several = group[0][2] > 1
        # The reference text comes first: its document is the smallest.
        for home, _, _, d, key, start, raw in group:
            words = raw.split()
            met = automaton.repeats([ids.setdefault(word, len(ids)) for word in words], WINDOW)
            flags = np.array(met, np.int8)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                yield d, key, start + a - WINDOW + 1, start + b, None, None
            if several and d != home:
                for e in np.flatnonzero(flags[WINDOW - 1 :] == 0).tolist():
                    high, low = window_digest(b" ".join(words[e : e + WINDOW]))
                    yield d, key, start + e, start + e + WINDOW, high, low


CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])
CUT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def cut_words(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
    words = raw.split()
    removed = 0
    kept: list[bytes] = []
    at = 0
    for start, stop in runs:
        kept += words[at:start]
        removed += stop - start
        at = stop
    kept += words[at:]
    text = b" ".join(kept)
    return len(words), removed, hashlib.sha256(text).hexdigest(), text.decode()


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """One row per row of the input: doc_id, n_words, n_removed, kept_sha256 and the text that is left."""
    runs = repeated_runs(docs, word_hashes, word_slices, WINDOW, INNER, match_shards, False, "word-runs", HOME_ANCHORS)
    return cut_rows(keyed(docs), runs, cut_words, CUT, CUT_SQL)
