"""Suffix order and common-prefix values by external induced sorting.

A suffix is L-type if it is larger than the next one, else S-type; an S-type suffix after an
L-type one is a sample. The samples' substrings (from one sample to the next) are sorted
and named, the string of names is sorted recursively, and the samples' order induces that of
all suffixes: a suffix is the tuple (its symbols and types up to the next sample, that
sample's rank, its position). Those symbol runs are prefix-free with their types,
so the tuples' order is the suffixes' order.

The common-prefix value of two neighbours comes the same way: where their runs differ it is
read off the run; where they are equal it is the run's length plus the smallest value between the
ranks of the two samples, which the recursion has carried up.

Tuples pass through ``DiskQueue``, which keeps ``Space.memory`` bytes and puts sorted runs
in files beyond that; long arrays are files mapped into memory. The files have no name, so they go
with the task that made them, even if it is killed. Order and values are exact for the
first ``cap`` symbols; neighbours that agree on so many may stand in any order.
"""
from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

STEP = 1 << 18  # positions worked on at once


class Space:
    """Arrays in memory, or in nameless files of the task if they are large."""

    def __init__(self, memory: int = 192 << 20):
        self.memory = memory

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory // 4:
            return np.zeros(n, dtype)
        return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))


class DiskQueue:
    """Priority queue of tuples of unsigned 64-bit integers: all are pushed, then all popped in
    the order of all columns but the last, which is the load."""

    def __init__(self, width: int, space: Space):
        self.width, self.limit = width, max(1 << 10, space.memory // (16 * width))
        self.held: list[np.ndarray] = []
        self.count = 0
        self.runs: list = []

    def push(self, *columns: np.ndarray) -> None:
        self.held.append(np.stack([np.asarray(c, np.uint64) for c in columns]))
        self.count += len(columns[0])
        if self.count >= self.limit:
            run = tempfile.TemporaryFile()
            rows = self._sorted()
            run.write(np.ascontiguousarray(rows.T))
            self.runs.append((run, rows.shape[1]))

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.held, 1) if self.held else np.zeros((self.width, 0), np.uint64)
        self.held, self.count = [], 0
        return rows[:, np.lexsort(rows[-2::-1])]  # the position only rides along

    def pop(self) -> Iterator[np.ndarray]:
        """Blocks of tuples, one per column, in ascending order within and across blocks."""
        rest = self._sorted()
        if not self.runs:
            for i in range(0, rest.shape[1], STEP):
                yield rest[:, i:i + STEP]
            return
        block = max(64, self.limit // (len(self.runs) + 1))
        done = [0] * len(self.runs)

        def load(i: int) -> np.ndarray:
            run, n = self.runs[i]
            run.seek(done[i] * 8 * self.width)
            m = min(block, n - done[i])
            done[i] += m
            return np.frombuffer(run.read(m * 8 * self.width), np.uint64).reshape(m, self.width).T

        parts = [load(i) for i in range(len(self.runs))] + [rest]
        while True:
            for i in range(len(self.runs)):
                if not parts[i].shape[1] and done[i] < self.runs[i][1]:
                    parts[i] = load(i)
            # What is not above the lowest last tuple of the runs with more to come can go out.
            ends = [tuple(parts[i][:-1, -1].tolist()) for i in range(len(self.runs)) if done[i] < self.runs[i][1]]
            out = []
            for i, p in enumerate(parts):
                m = p.shape[1] if not ends else _not_above(p, min(ends))
                out.append(p[:, :m])
                parts[i] = p[:, m:]
            rows = np.concatenate(out, 1)
            if rows.shape[1]:
                yield rows[:, np.lexsort(rows[-2::-1])]
            elif not ends:
                return


def _not_above(rows: np.ndarray, bound: tuple) -> int:
    """How many leading tuples of sorted rows are at most ``bound``."""
    lo, hi = 0, rows.shape[1]
    while lo < hi:
        mid = (lo + hi) // 2
        if tuple(rows[:-1, mid].tolist()) <= bound:
            lo = mid + 1
        else:
            hi = mid
    return lo


class RangeMinimum:
    """min(values[i:j]) for many ranges: minima of blocks, doubled, and inside blocks from either side."""

    BLOCK = 32

    def __init__(self, values: np.ndarray, space: Space):
        b, n = self.BLOCK, len(values)
        full = -(-n // b)
        self.values = values
        self.left, self.right = space.array(full * b, values.dtype), space.array(full * b, values.dtype)
        top = np.iinfo(values.dtype).max
        low = np.full(full, top, values.dtype)
        step = max(1, STEP // b)
        for i in range(0, full, step):
            j = min(full, i + step)
            x = np.full(((j - i) * b), top, values.dtype)
            x[:max(0, min(n, j * b) - i * b)] = values[i * b:j * b]
            x = x.reshape(-1, b)
            self.left[i * b:j * b] = np.minimum.accumulate(x, 1).ravel()
            self.right[i * b:j * b] = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
            low[i:j] = x.min(1)
        self.table = [low]
        while 2 ** len(self.table) <= full:
            d = 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-d], self.table[-1][d:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Ranges must not be empty."""
        b, last = self.BLOCK, j - 1
        bi, bj = i // b, last // b
        out = np.minimum(self.right[i], self.left[last])
        near = np.flatnonzero(bi == bj)
        if len(near):
            low = self.values[i[near]].copy()
            size = j[near] - i[near]
            for d in range(1, int(size.max())):
                m = np.flatnonzero(size > d)
                low[m] = np.minimum(low[m], self.values[i[near[m]] + d])
            out[near] = low
        far = np.flatnonzero(bj - bi > 1)
        if len(far):
            a, e = bi[far] + 1, bj[far]
            k = np.frexp((e - a).astype(np.float64))[1] - 1
            for level in np.unique(k):
                m = k == level
                t = self.table[level]
                out[far[m]] = np.minimum(out[far[m]], np.minimum(t[a[m]], t[e[m] - (1 << level)]))
        return out


class SuffixOrder:
    """The suffixes of ``text`` (unsigned integers; the last one is smaller than all others)."""

    def __init__(self, text: np.ndarray, cap: int, space: Space | None = None):
        self.text, self.cap, self.space = text, cap, space or Space()
        n = self.n = len(text)
        self.bits = max(2, (2 * int(text.max()) + 1).bit_length())
        self.per_key = 64 // self.bits
        self.keys = 2 if self.bits <= 12 else 3
        # Types: that of the next place where neighbours differ. Worked from the right in blocks.
        self.packed = self.space.array(n, np.uint64)  # symbols and types from each position on, as many as a key holds
        self.next = self.space.array(n, np.int64)  # rank among samples, by position, of the next sample
        small = np.zeros(0, bool)
        places = []
        carry, follow = True, np.zeros(self.per_key, np.uint64)
        for a in range((n - 1) // STEP * STEP, -1, -STEP):
            b = min(n, a + STEP)
            x = np.asarray(text[a:min(n, b + 1)]).astype(np.int64)
            kind = np.empty(b - a, bool)
            up, differ = x[1:] > x[:-1], x[1:] != x[:-1]
            if b == n:
                kind[-1] = True
            at = np.flatnonzero(differ)
            known = np.repeat(up[at], np.diff(at, prepend=-1))
            kind[:len(known)] = known
            if len(known) < len(up):
                kind[len(known):len(up)] = carry
            col = (2 * x[:b - a] + kind).astype(np.uint64)
            ahead = np.concatenate([col, follow])
            packed = np.zeros(b - a, np.uint64)
            for k in range(self.per_key):
                packed = (packed << np.uint64(self.bits)) | ahead[k:k + b - a]
            self.packed[a:b] = packed
            follow = ahead[:self.per_key]
            after = np.append(kind[1:], small[:1]) if b < n else kind[1:]
            here = np.flatnonzero(after & ~kind[:len(after)]) + a + 1
            places.append(here)
            small, carry = kind[:1], bool(kind[0])
        self.samples = np.concatenate(places[::-1]) if places else np.zeros(0, np.int64)
        if not len(self.samples):  # a single symbol
            self.samples = np.array([n - 1])
        edges = np.diff(np.concatenate([[0], self.samples]))
        for i in range(0, len(edges), STEP):
            j = min(len(edges), i + STEP)
            begin = self.samples[i - 1] if i else 0
            self.next[begin:self.samples[j - 1]] = np.repeat(np.arange(i, j), edges[i:j])
        self.next[n - 1] = len(self.samples) - 1

    def size(self, pos: np.ndarray) -> np.ndarray:
        """Symbols of a position's run, the next sample's first one included."""
        return self.samples[self.next[pos]] - pos + 1

    def pack(self, pos: np.ndarray, size: np.ndarray, skip: int) -> np.ndarray:
        """Symbols and types skip, skip + 1, ... of the runs, as many as a key holds."""
        at = pos + skip
        np.minimum(at, self.n - 1, out=at)
        have = np.minimum(size - skip, self.per_key)
        np.maximum(have, 0, out=have)
        shift = ((self.per_key - have) * self.bits).astype(np.uint64)
        out = self.packed[at]
        if self.per_key * self.bits == 64:
            out[have == 0] = 0
            np.minimum(shift, np.uint64(63), out=shift)
        return (out >> shift) << shift

    def compare(self, a: np.ndarray, b: np.ndarray):
        """(common symbols, whether the runs are equal) of pairs; for equal runs the sample is not counted."""
        common, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        left, skip = np.arange(len(a)), 0
        size_a, size_b = self.size(a), self.size(b)
        mask = np.uint64((1 << self.bits) - 1)
        while len(left) and skip < self.cap:
            x = self.pack(a[left], size_a[left], skip) ^ self.pack(b[left], size_b[left], skip)
            differ = x != 0
            if differ.any():
                y, who = x[differ], left[differ]
                at, found = np.zeros(len(y), np.int64), np.zeros(len(y), np.uint64)
                for k in range(self.per_key):
                    part = (y >> np.uint64(self.bits * (self.per_key - 1 - k))) & mask
                    first = (found == 0) & (part != 0)
                    at[first], found[first] = k, part[first]
                common[who], same[who] = skip + at, False
                kind = who[found == 1]  # one symbol, two types: both go on with it for the shorter run of it
                if len(kind):
                    common[kind] += np.minimum(self._repeat(a[kind] + common[kind]), self._repeat(b[kind] + common[kind]))
            ended = ~differ & (size_a[left] <= skip + self.per_key)
            common[left[ended]] = size_a[left[ended]] - 1
            left = left[~differ & ~ended]
            skip += self.per_key
        common[left] = self.cap
        return np.minimum(common, self.cap), same

    def _repeat(self, pos: np.ndarray) -> np.ndarray:
        """How often the symbol at pos follows itself, itself included, up to the cap."""
        out, left = np.ones(len(pos), np.int64), np.arange(len(pos))
        for d in range(1, self.cap):
            at = pos[left] + d
            left = left[(at < self.n) & (self.text[np.minimum(at, self.n - 1)] == self.text[pos[left]])]
            if not len(left):
                break
            out[left] = d + 1
        return out

    def ordered(self, blocks, rank) -> Iterator[np.ndarray]:
        """Positions in the order of (run, rank of the sample after it); rank may be None."""
        queue = DiskQueue(self.keys + 2, self.space)
        wide = self.keys * self.per_key
        for pos in blocks:
            size = self.size(pos)
            tail = np.zeros(len(pos), np.uint64) if rank is None else np.where(size > wide, 0, rank[self.next[pos]])
            queue.push(*[self.pack(pos, size, k * self.per_key) for k in range(self.keys)], tail, pos)
        held = None
        for rows in queue.pop():
            rows = rows if held is None else np.concatenate([held, rows], 1)
            cut = rows.shape[1] - 1
            while cut and (rows[:self.keys, cut - 1] == rows[:self.keys, -1]).all():
                step = np.flatnonzero((rows[:self.keys, max(0, cut - STEP):cut] != rows[:self.keys, -1:]).any(0))
                cut = max(0, cut - STEP) + int(step[-1]) + 1 if len(step) else max(0, cut - STEP)
            held = rows[:, cut:]
            if cut:
                yield self._refined(rows[:, :cut], rank)
        if held is not None:
            yield self._refined(held, rank)

    def _refined(self, rows: np.ndarray, rank) -> np.ndarray:
        """Order runs that are longer than the keys by what follows."""
        pos = rows[-1].astype(np.int64)
        keys = rows[:self.keys]
        group = np.cumsum(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        skip = self.keys * self.per_key
        size = self.size(pos)
        at = np.flatnonzero(size > skip)
        while len(at) and skip < self.cap:
            g = group[at]
            many = np.zeros(len(at), bool)
            many[1:] = g[1:] == g[:-1]
            many[:-1] |= many[1:]
            at, g = at[many], g[many]
            if not len(at):
                break
            key = self.pack(pos[at], size[at], skip)
            wide = skip + self.per_key
            tail = np.zeros(len(at), np.int64) if rank is None else np.where(size[at] > wide, 0, rank[self.next[pos[at]]])
            order = np.lexsort((tail, key, g))
            pos[at], size[at] = pos[at[order]], size[at[order]]
            key, g = key[order], g[order]
            new = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])]))
            fresh = group.copy()
            fresh[at] = new  # only compared among ``at``, which stay together by group
            group = fresh
            at = at[size[at] > wide]
            skip = wide
        return pos

    def _pairs(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(previous, position, common, same) in order; the first position's previous is itself."""
        last = None
        for pos in batches:
            before = np.concatenate([pos[:1] if last is None else [last], pos[:-1]])
            common, same = self.compare(before, pos)
            if last is None:
                common[0], same[0] = 0, False
            last = pos[-1]
            yield before, pos, common, same

    def _samples_ranked(self):
        """(rank of each sample by position, common symbols of each sample in order with the one before)."""
        m = len(self.samples)
        name = self.space.array(m, np.int64)
        lcp = self.space.array(m, np.uint16)
        count = 0
        blocks = (self.samples[i:i + STEP] for i in range(0, m, STEP))
        for _, pos, common, same in self._pairs(self.ordered(blocks, None)):
            names = count - 1 + np.cumsum(~same)
            lcp[names[~same]] = common[~same]  # by name, which is the rank if all differ
            name[self._sample_at(pos)] = names
            count = int(names[-1]) + 1
        if count == m:
            return name, lcp
        inner = SuffixOrder(name, self.cap, self.space)
        rank = self.space.array(m, np.int64)
        done = 0
        for before, at, common in inner.neighbours():
            rank[at] = done + np.arange(len(at))
            end = np.minimum(at + common, m - 1)
            value = self.samples[end] - self.samples[at]
            go = np.flatnonzero((common < self.cap) & (value < self.cap) & (before != at))
            value[go] += self.compare(self.samples[before[go] + common[go]], self.samples[end[go]])[0]
            lcp[done:done + len(at)] = np.minimum(value, self.cap)
            done += len(at)
        return rank, lcp

    def _sample_at(self, pos: np.ndarray) -> np.ndarray:
        """Number of the sample at pos, by position."""
        return np.where(pos == self.n - 1, len(self.samples) - 1, self.next[pos] - 1)

    def neighbours(self, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(previous suffix, suffix, symbols they have in common up to the cap), in order, in blocks.

        ``wanted`` (bool by position): only the suffixes from there. The samples' order, which ends before any of
        them is looked at, is that of the whole text; their tuples alone are sorted and compared."""
        rank, lcp = self._samples_ranked()
        between = RangeMinimum(lcp, self.space)
        blocks = (np.arange(i, min(self.n, i + STEP)) for i in range(0, self.n, STEP))
        if wanted is not None:
            blocks = (pos[wanted[pos[0]:pos[-1] + 1]] for pos in blocks)
        for before, pos, common, same in self._pairs(self.ordered(blocks, rank)):
            x, y = rank[self.next[before]], rank[self.next[pos]]
            go = same & (common < self.cap) & (x < y)
            common[go] += between(x[go] + 1, y[go] + 1)
            yield before, pos, np.minimum(common, self.cap)
