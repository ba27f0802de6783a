"""Exact removal of repeated byte strings with enhanced suffix arrays.

Every byte that lies in a ``LENGTH``-byte string which also starts elsewhere is
removed. The text around shared anchors is brought together by home (see
``anchors``), and its suffixes are sorted there by prefix doubling. Runs of suffixes that
share ``LENGTH`` bytes are the candidates; runs whose suffixes are all preceded by the
same byte are skipped, since the run one byte earlier holds longer strings. The
others get their common prefixes in the order of the text, which keeps very long periodic texts linear, and are scanned with a stack over their common-prefix lengths: each interval of the tree whose
suffixes are preceded by different bytes is a maximal repeat, and all suffixes of
the interval are its occurrences.

Defined cases: null and empty texts have no bytes; rows with the same doc_id and
text are one document; a null doc_id is a document like others; an empty table
gives no rows; other columns are ignored. Text that is cut inside a character keeps its
remaining bytes; ``text`` then shows a replacement mark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import cut_rows, keyed, repeated_runs, window_digest
from .common import mix

LENGTH = 200
INNER = 48
HOME_ANCHORS = 20_000  # of one home in one task: about two million bytes
BATCH_BYTES = 1_000_000
SCAN = 1 << 16  # suffixes taken at a time
FIRST = 7  # symbols in the first sort key, nine bits each

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BASE = 0x9E3779B97F4A7C15


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return _powers[0][:n], _powers[1][:n]


def byte_hashes(raw: bytes) -> np.ndarray:
    """One hash for each run of INNER bytes."""
    n = len(raw) - INNER + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power)])
        return mix((sums[INNER:] - sums[:n]) * inverse[:n])


def byte_slices(raw: bytes):
    return len(raw), lambda start, stop: raw[start:stop]


class SuffixArray:
    """Sorted suffixes of several strings, with the ranks by which ``length`` equal symbols are told.

    Strings of different groups share nothing: their suffixes are sorted apart.
    """

    def __init__(self, strings: list[bytes], length: int = LENGTH, groups: list[int] | None = None) -> None:
        sizes = np.array([len(s) for s in strings], np.int64)
        n = int(sizes.sum()) + len(strings)
        symbols = np.zeros(n + max(FIRST, length), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        symbols[:n] = raw
        symbols[:n] += 1
        symbols[self.starts + sizes] = 0
        self.symbols, self.owner = symbols[:n], np.repeat(np.arange(len(strings)), sizes + 1)
        self.left = (self.starts + sizes)[self.owner] - np.arange(n)  # symbols up to the end of the string
        group = np.array(groups or [0] * len(strings), np.int64)[self.owner]
        self._sort(symbols, n, length, int(sizes.max()), group)

    def _sort(self, symbols: np.ndarray, n: int, length: int, longest: int, group: np.ndarray) -> None:
        key = np.zeros(n, np.int64)
        known = min(FIRST, length)
        for i in range(known):
            key = (key << 9) | symbols[i : n + i]
        order = np.lexsort((key, group)) if group[-1] != group[0] else np.argsort(key, kind="stable")
        key, group = key[order], group[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        slots = np.arange(n)
        rank = np.full(n + length, -1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        self.deep = None
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if self.deep is None and (known * 2 > length or not len(at) or known >= longest):
                self.deep, self.known = rank.copy(), known
            if not len(at) or known >= longest:
                break
            here = order[at]
            both = rank[here] * (n + 1) + rank[np.minimum(here + known, n)] + 1
            again = np.argsort(both, kind="stable")
            here, both = here[again], both[again]
            order[at] = here
            fresh = np.concatenate([[True], both[1:] != both[:-1]])
            rank[here] = np.maximum.accumulate(np.where(fresh, at, 0))
            new[at] = fresh
            known *= 2
        self.order = order

    def alike(self, length: int) -> np.ndarray:
        """For each slot but the first, whether its suffix has ``length`` symbols in common with the one before."""
        a, b = self.order[:-1], self.order[1:]
        fits = (self.left[a] >= length) & (self.left[b] >= length)
        same = np.zeros(len(a), bool)
        at = np.flatnonzero(fits)
        x, y = a[at], b[at]
        equal = self.deep[x] == self.deep[y]
        covered = self.known
        while covered < length:
            shift = min(covered, length - self.known)
            equal &= self.deep[x + shift] == self.deep[y + shift]
            covered = shift + self.known
            if shift == length - self.known:
                break
        same[at] = equal
        return same

    def prefixes(self, lows: np.ndarray, highs: np.ndarray, length: int) -> np.ndarray:
        """The common prefixes with the next slot, for the slots low..high-1 of each of the runs that share ``length`` symbols.

        Suffixes are taken in the order of the text: the one that begins a symbol later shares at most one symbol
        less with its own neighbour, so what is known need not be compared again and periodic texts take linear time.
        """
        slots = np.concatenate([np.arange(low, high) for low, high in zip(lows, highs)] or [np.empty(0, np.int64)])
        before, places = self.order[slots], self.order[slots + 1]
        in_text = np.argsort(places, kind="stable")
        sizes = np.minimum(self.left[before], self.left[places])
        found = np.empty(len(slots), np.int64)
        last, shared = -2, 0
        for start in range(0, len(slots), SCAN):
            part = in_text[start : start + SCAN]
            near = [x[part].tolist() for x in (before, places, sizes)]
            values = []
            for a, b, size in zip(*near):
                shared = self._common(a, b, size, max(length, shared - 1) if b == last + 1 else length)
                values.append(shared)
                last = b
            found[part] = values
        return found

    def _common(self, a: int, b: int, size: int, known: int) -> int:
        """Length of the common prefix of two suffixes, at most ``size``, of which ``known`` symbols are equal."""
        symbols, at, step = self.symbols, known, 256
        if at < size and symbols[a + at] != symbols[b + at]:
            return at
        while at < size:
            stop = min(size, at + step)
            differ = np.flatnonzero(symbols[a + at : a + stop] != symbols[b + at : b + stop])
            if len(differ):
                return at + int(differ[0])
            at, step = stop, step * 2
        return size


def maximal_repeats(array: SuffixArray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Maximal repeats of ``length`` symbols or more: their length, all occurrences, and those
    occurrences that no longer maximal repeat holds. Longer ones come before the shorter ones around them."""
    alike = array.alike(length)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], alike.astype(np.int8), [0]])))
    lows, highs = edges[::2], edges[1::2]  # slots low..high share the prefix
    if not len(lows):
        return
    before = np.where(array.left[array.order] == array.left[np.maximum(array.order - 1, 0)] - 1, array.symbols[np.maximum(array.order - 1, 0)], -1)
    before[array.order == 0] = -1
    bounds = np.stack([lows, highs + 1], 1).ravel()
    padded = np.append(before, 0)
    least, most = np.minimum.reduceat(padded, bounds)[::2], np.maximum.reduceat(padded, bounds)[::2]
    several = (least != most) | (least < 0)
    lows, highs = lows[several], highs[several]
    shared, done = array.prefixes(lows, highs, length), 0
    for low, high in zip(lows.tolist(), highs.tolist()):
        places, lefts = array.order[low : high + 1], before[low : high + 1].tolist()
        prefixes = shared[done : done + high - low].tolist()
        done += high - low
        # Frames: prefix length, first slot, the one preceding symbol (None: several), slots not yet reported.
        stack: list[list] = []
        for slot in range(len(places)):
            frame = [None, slot, lefts[slot] if lefts[slot] >= 0 else None, [slot]]
            prefix = prefixes[slot] if slot < len(prefixes) else 0
            # A leaf or closed interval joins the next open interval with the larger of both prefix lengths.
            while stack and stack[-1][0] > prefix:
                top = stack.pop()
                top[2] = top[2] if top[2] == frame[2] else None
                top[3] += frame[3]
                if top[2] is None:
                    yield top[0], places[top[1] : slot + 1], [int(places[s]) for s in top[3]]
                    top[3] = []
                frame = [None, top[1], top[2], top[3]]
            if slot == len(prefixes):
                break
            if stack and stack[-1][0] == prefix:
                top = stack[-1]
                top[2] = top[2] if top[2] == frame[2] else None
                top[3] += frame[3]
            else:
                frame[0] = prefix
                stack.append(frame)


def _compare(rows: list[tuple], several: bool) -> Iterator[tuple]:
    """Repeated runs in the spans of one or more homes, and open windows where other tasks hold parts."""
    found: dict[tuple[int, bytes], list[tuple]] = {}
    home_text = set()
    for home, _, _, d, key, start, raw in rows:
        found.setdefault((home, raw), []).append((d, key, start))
        if d == home:
            home_text.add(raw)
    strings, places = [raw for _, raw in found], list(found.values())
    for raw, where in zip(strings, places):
        if len(where) > 1:
            for d, key, start in where:
                yield d, key, start, start + len(raw), None, None
    homes = {home: i for i, home in enumerate(dict.fromkeys(home for home, _ in found))}
    array = SuffixArray(strings, LENGTH, [homes[home] for home, _ in found])
    for length, _, fresh in maximal_repeats(array):
        for at in fresh:
            owner = array.owner[at]
            inside = int(at - array.starts[owner])
            for d, key, start in places[owner]:
                yield d, key, start + inside, start + inside + length, None, None
    if several:
        # Windows that the home's own text does not have may be in the text of other tasks.
        alike = array.alike(LENGTH)
        run = np.cumsum(np.concatenate([[True], ~alike])) - 1
        own = np.array([s in home_text for s in strings])
        with_home = np.zeros(run[-1] + 1, bool)
        with_home[run[own[array.owner[array.order]]]] = True
        for at in array.order[~with_home[run] & (array.left[array.order] >= LENGTH)].tolist():
            owner = array.owner[at]
            inside = int(at - array.starts[owner])
            d, key, start = places[owner][0]
            high, low = window_digest(strings[owner][inside : inside + LENGTH])
            yield d, key, start + inside, start + inside + LENGTH, high, low


def match_homes(groups: Iterator[list[tuple]]) -> Iterator[tuple]:
    """Small homes are sorted in one array, each as a group of its own."""
    waiting, size = [], 0
    for group in groups:
        if group[0][2] > 1:
            yield from _compare(group, True)
            continue
        waiting += group
        size += sum(len(row[6]) for row in group)
        if size >= BATCH_BYTES:
            yield from _compare(waiting, False)
            waiting, size = [], 0
    if waiting:
        yield from _compare(waiting, False)


CUT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("text", pa.string()),
])
CUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def cut_bytes(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
    at, parts = 0, []
    for start, stop in runs:
        parts.append(raw[at:start])
        at = stop
    kept = b"".join([*parts, raw[at:]])
    return len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per row of the input: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the text that is left."""
    runs = repeated_runs(docs, byte_hashes, byte_slices, LENGTH, INNER, match_homes, True, "byte-runs", HOME_ANCHORS)
    return cut_rows(keyed(docs), runs, cut_bytes, CUT, CUT_SQL)
