"""External induced sorting of suffixes with common-prefix values.

The sorter classifies suffixes (L: greater than their successor, S: smaller; S*: an S
after an L), names the substrings between S* positions, recurses while names repeat,
and induces first the L, then the S suffixes.  Both inductions run on a priority
queue of suffix tuples that carries the common prefix with the queue's previous tuple
of the same symbol.

Two queues serve.  With few symbols (``BucketQueue``) the queue is monotone: symbols
are taken in order, and a symbol's tuples in order of arrival, so all that wait for a
symbol are taken and induced from at once, as arrays.  With many symbols (the names of
a recursion) tuples are taken one by one from a heap (``DiskQueue``).  Beyond
``memory`` tuples either queue writes to anonymous temporary files (a task's own
spill, gone with the task), and texts and results of more than ``memory`` symbols are
arrays on disk as well.
"""

from __future__ import annotations

import heapq
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

#: Common prefix of nothing yet.
OPEN = np.int64(1) << 60


def kept(values: np.ndarray, memory: int) -> np.ndarray:
    """The array, on disk if it has more than ``memory`` values."""
    if len(values) <= memory:
        return values
    out = np.memmap(tempfile.TemporaryFile(), values.dtype, "w+", shape=values.shape)
    out[:] = values
    return out


class BucketQueue:
    """Monotone priority queue: (position, common) tuples by symbol, in order of arrival; overflow is appended to a file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.parts, self.file, self.end = memory, 0, {}, None, 0

    def put(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append(np.stack([position, common]))
        self.held += len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115  lives as long as the queue
        self.file.seek(self.end)
        for symbol, parts in self.parts.items():
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    part.tofile(self.file)
                    parts[i] = (self.end, part.shape[1])
                    self.end += part.nbytes
        self.held = 0

    def __contains__(self, symbol: int) -> bool:
        return symbol in self.parts

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for part in self.parts.pop(symbol):
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.fromfile(self.file, np.int64, 2 * part[1]).reshape(2, -1)
            else:
                self.held -= part.shape[1]
            out.append(part)
        both = out[0] if len(out) == 1 else np.concatenate(out, axis=1)
        return both[0], both[1]


class Minima:
    """Range minima of an array, by doubling."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            a, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(a[:-step], a[step:]))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of [low, high) each; ``OPEN`` where that is empty."""
        size = high - low
        out = np.full(len(low), OPEN)
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[size > 0]):
            at = np.flatnonzero((level == k) & (size > 0))
            row = self.levels[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


class Inducer:
    """Sends the left neighbours of processed suffixes, of one type, to the queue with their common prefixes."""

    def __init__(self, t: np.ndarray, is_s: np.ndarray, up: bool, skip: int, symbols: int, memory: int):
        self.t, self.is_s, self.up, self.skip = t, is_s, up, skip
        self.queue = BucketQueue(memory)
        self.since = np.full(symbols, -1, np.int64)  # least gap since a symbol's last tuple; -1: none yet

    def process(self, position: np.ndarray, gap: np.ndarray) -> None:
        """``gap``: common prefix of each suffix with the one processed before it."""
        left = position - 1
        i = np.flatnonzero((left >= 0) & (self.is_s[left] == self.up))
        i = i[self.t[left[i]] > self.skip]
        lowest = gap.min()
        if not len(i):
            np.minimum(self.since, lowest, out=self.since)
            return
        symbol = self.t[left[i]]
        order = np.argsort(symbol, kind="stable")
        i, symbol = i[order], symbol[order]
        new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(i))
        minima = Minima(gap)
        before = np.where(new, 0, np.concatenate([[0], i[:-1] + 1]))
        shared = minima.over(before, i + 1)
        own = symbol[start]
        shared[start] = np.minimum(shared[start], self.since[own])
        shared += 1
        np.minimum(self.since, lowest, out=self.since)
        last = i[stop - 1]
        self.since[own] = minima.over(last + 1, np.full(len(last), len(gap)))
        left = left[i]
        for c, a, b in zip(own.tolist(), start.tolist(), stop.tolist()):
            self.queue.put(c, left[a:b], shared[a:b])


def _join(parts: list[np.ndarray], memory: int) -> np.ndarray:
    return kept(np.concatenate(parts), memory) if parts else np.zeros(0, np.int64)


def _induce_l(t, is_s, run, seeds: np.ndarray, common: np.ndarray, ends: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The L suffixes in ascending order, with common prefixes, from the sorted S* suffixes; symbols up to ``ends`` occur once each."""
    symbols = int(t.max()) + 1
    work = Inducer(t, is_s, False, -1, symbols, memory)
    out_p, out_c = [], []
    symbol = t[seeds]
    first = np.searchsorted(symbol, np.arange(symbols + 1))
    low = int(first[min(ends + 1, symbols)])
    if low:
        work.process(seeds[:low], np.zeros(low, np.int64))
    for c in range(symbols):
        before = None
        while c in work.queue:
            p, gap = work.queue.take(c)
            out_p.append(p)
            out_c.append(gap)
            before = p[-1]
            work.process(p, gap)
        a, b = int(first[c]), int(first[c + 1])
        if c > ends and b > a:
            gap = np.array(common[a:b])
            gap[0] = 0 if before is None else min(run[before], run[seeds[a]])
            work.process(seeds[a:b], gap)
    return _join(out_p, memory), _join(out_c, memory)


def _induce_s(t, is_s, run, seeds: np.ndarray, common: np.ndarray, ends: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The S suffixes in descending order from the sorted L suffixes; a value relates a suffix to the one after it."""
    symbols = int(t.max()) + 1
    work = Inducer(t, is_s, True, ends, symbols, memory)
    out_p, out_c = [], []
    first = np.searchsorted(t[seeds], np.arange(symbols + 1))
    for c in range(symbols - 1, ends, -1):
        before = None
        while c in work.queue:
            p, gap = work.queue.take(c)
            out_p.append(p)
            out_c.append(gap)
            before = p[-1]
            work.process(p, gap)
        a, b = int(first[c]), int(first[c + 1])
        if b > a:
            gap = np.zeros(b - a, np.int64)
            gap[1:] = common[a + 1 : b][::-1]
            gap[0] = 0 if before is None else min(run[before], run[seeds[b - 1]])
            work.process(seeds[a:b][::-1], gap)
    once = np.flatnonzero(is_s & (t > 0) & (t <= ends))  # each symbol of its own, nothing to induce from
    once = once[np.argsort(t[once])][::-1]
    out_p.append(once)
    out_c.append(np.zeros(len(once), np.int64))
    pos, gap = _join(out_p, memory), _join(out_c, memory)
    return pos, np.append(gap[1:], 0)


class DiskQueue:
    """Priority queue of 4-tuples of integers, smallest first; overflow lives in sorted runs on disk."""

    def __init__(self, memory: int):
        self.memory, self.heap, self.runs = memory, [], []

    def push(self, item: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.heap.sort()
        keep = self.memory // 2
        f = tempfile.TemporaryFile()  # noqa: SIM115  lives as long as the run
        np.array(self.heap[keep:], np.int64).tofile(f)
        f.seek(0)
        del self.heap[keep:]
        reader = self._read(f)
        self.runs.append([next(reader), reader])

    @staticmethod
    def _read(f) -> Iterator[tuple[int, int, int, int]]:
        while len(block := np.fromfile(f, np.int64, 4 * 4096)):
            yield from map(tuple, block.reshape(-1, 4).tolist())

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)

    def peek(self) -> tuple[int, int, int, int]:
        best = self.heap[0] if self.heap else None
        for run in self.runs:
            if best is None or run[0] < best:
                best = run[0]
        return best

    def pop(self) -> tuple[int, int, int, int]:
        best = self.peek()
        if self.heap and self.heap[0] == best:
            return heapq.heappop(self.heap)
        run = next(r for r in self.runs if r[0] == best)
        run[0] = next(run[1], None)
        if run[0] is None:
            self.runs.remove(run)
        return best


class RangeMinimum:
    """Minimum of the values since a given order, over a growing sequence."""

    def __init__(self):
        self.at, self.value = [], []

    def add(self, order: int, value: int) -> None:
        while self.value and self.value[-1] >= value:
            self.at.pop()
            self.value.pop()
        self.at.append(order)
        self.value.append(value)

    def since(self, order: int) -> int:
        """Over orders greater than ``order``."""
        return self.value[bisect_right(self.at, order)]


def suffixes(text: np.ndarray, memory: int = 1_000_000, ends: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of non-negative integers (a suffix that is a prefix of another comes first); symbols below ``ends`` occur once each."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = kept(np.append(text.astype(np.int64) + 1, 0), memory)  # the end marker is the smallest symbol
    n += 1
    # S where the next different symbol is greater
    change = np.flatnonzero(t[:-1] != t[1:])
    block = np.searchsorted(change, np.arange(n - 1))
    is_s = kept(np.append(t[change[block]] < t[change[block] + 1], True), memory)
    run = kept(np.append(change[block] - np.arange(n - 1) + 1, 1), memory)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    order, common = _sort_stars(t, is_s, run, star, memory)
    if int(t.max()) - ends <= max(n >> 6, 300):
        l_pos, l_lcp = _induce_l(t, is_s, run, order, common, ends, memory)
        s_pos, s_lcp = _induce_s(t, is_s, run, l_pos, l_lcp, ends, memory)
    else:
        tl, sl, rl = t.tolist(), is_s.tolist(), run.tolist()
        l_pos, l_lcp = _induce(tl, sl, rl, list(zip(order.tolist(), common.tolist())), False, memory)
        s_pos, s_lcp = _induce(tl, sl, rl, list(zip(l_pos, l_lcp)), True, memory)
    # join both: symbols ascend, L before S within one
    pos = np.concatenate([np.asarray(l_pos, np.int64), np.asarray(s_pos, np.int64)[::-1]])
    own = np.concatenate([np.asarray(l_lcp, np.int64), np.asarray(s_lcp, np.int64)[::-1]])
    place = np.argsort(2 * t[pos] + is_s[pos], kind="stable")
    sa, lcp = pos[place], own[place]
    if len(sa) > 1:
        a, b = sa[:-1], sa[1:]
        lcp[1:] = np.where(t[a] != t[b], 0, np.where(is_s[a] != is_s[b], np.minimum(run[a], run[b]), lcp[1:]))
    lcp[0] = 0
    return kept(sa, memory), kept(lcp, memory)


def _induce(t, is_s, run, seeds, up: bool, memory: int):
    """Positions of the L suffixes in ascending order (``up``: of the S suffixes in descending order) with common prefixes.

    ``seeds`` are the sorted S* (or all L) suffixes with the common prefix to their
    predecessor.  A processed suffix sends its left neighbour, of the induced type,
    to the queue, keyed by symbol and by the order of processing.
    """
    sign = -1 if up else 1
    seeds = seeds[::-1] if up else seeds
    queue, minimum, last = DiskQueue(memory), RangeMinimum(), {}
    out_pos, out_lcp = [], []
    at, done, before = 0, 0, -1
    while at < len(seeds) or len(queue):
        if len(queue) and at < len(seeds):
            c, s = sign * queue.peek()[0], t[seeds[at][0]]
            # ascending: L before S of one symbol; descending: S before L
            from_queue = (c <= s) if not up else (c >= s)
        else:
            from_queue = at == len(seeds)
        if from_queue:
            _, _, p, common = queue.pop()
            if before >= 0 and t[before] == t[p]:
                gap = common if is_s[before] == is_s[p] else min(run[before], run[p])
            else:
                gap = 0
            out_pos.append(p)
            out_lcp.append(gap)
        else:
            p, common = seeds[at]
            if before < 0 or t[before] != t[p]:
                gap = 0
            elif is_s[before] == is_s[p]:
                # the seed's own value relates it to the seed processed next to it
                gap = seeds[at - 1][1] if up else common
            else:
                gap = min(run[before], run[p])
            at += 1
        done += 1
        minimum.add(done, gap)
        before = p
        q = p - 1
        if q >= 0 and is_s[q] == up:
            c = t[q]
            prior = last.get(c)
            shared = 1 + minimum.since(prior) if prior is not None else 0
            last[c] = done
            queue.push((sign * c, done, q, shared))
    if up:
        # out_lcp[i] relates i to the greater suffix before it; turn it to the smaller one after it
        out_lcp = [*out_lcp[1:], 0]
    return out_pos, out_lcp


def _names(t: np.ndarray, is_s: np.ndarray, star: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ranks of the typed substrings between S* positions, several symbols to a sort key."""
    bits = int(2 * int(t.max()) + 3).bit_length()
    per = max(62 // bits, 1)

    def key(own: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(len(own), np.int64)
        for k in range(step * per, (step + 1) * per):
            at = np.minimum(star[own] + k, len(t) - 1)
            out = (out << bits) | np.where(k < length[own], 2 * t[at] + is_s[at] + 1, 0)  # of equal symbols the L one is smaller
        return out

    rank = np.unique(key(np.arange(len(star)), 0), return_inverse=True)[1].astype(np.int64)
    step = 1
    while len(own := np.flatnonzero(length > step * per)):  # no substring is a prefix of another: shorter ones have their place
        more = key(own, step)
        order = np.lexsort((more, rank[own]))
        new = np.concatenate([[0], (np.diff(rank[own][order]) == 0) & (np.diff(more[order]) != 0)])
        sub = np.zeros(len(own), np.int64)
        sub[order] = np.cumsum(new)  # ascends within a rank
        fine = rank * (len(star) + 1)
        fine[own] += sub
        rank = np.unique(fine, return_inverse=True)[1].astype(np.int64)
        step += 1
    return rank


def _sort_stars(t: np.ndarray, is_s: np.ndarray, run: np.ndarray, star: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, with common prefixes, by naming their substrings and recursion where names repeat."""
    m, n = len(star), len(t)
    if m <= 1:
        return star, np.zeros(m, np.int64)
    length = np.append(star[1:], star[-1]) - star + 1
    names = _names(t, is_s, star, length)
    if names.max() == m - 1:
        sub_order, sub_lcp = np.argsort(names), np.zeros(m, np.int64)
    else:
        sub_order, sub_lcp = suffixes(names, memory)
    equal = sub_lcp[1:]
    a, b = sub_order[:-1], sub_order[1:]
    i, j = a + equal, b + equal
    common = np.zeros(m, np.int64)
    common[1:] = np.where(i < m, star[np.minimum(i, m - 1)], n) - star[a]
    todo = np.flatnonzero((i < m) & (j < m))
    k = 0
    while len(todo):  # the first substrings that differ, symbol by symbol
        ok = (k < length[i[todo]]) & (k < length[j[todo]])
        todo = todo[ok]
        x, y = star[i[todo]] + k, star[j[todo]] + k
        same = t[x] == t[y]
        both = same & (is_s[x] == is_s[y])
        common[todo[both] + 1] += 1
        mixed = same & ~both  # one symbol, two types: equal up to the end of the shorter run
        common[todo[mixed] + 1] += np.minimum(run[x[mixed]], run[y[mixed]])
        todo = todo[both]
        k += 1
    return star[sub_order], common


def naive_suffixes(text: list[int]) -> tuple[list[int], list[int]]:
    """Brute force for tests."""
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] * len(sa)
    for k in range(1, len(sa)):
        a, b = text[sa[k - 1] :], text[sa[k] :]
        while lcp[k] < min(len(a), len(b)) and a[lcp[k]] == b[lcp[k]]:
            lcp[k] += 1
    return sa, lcp
