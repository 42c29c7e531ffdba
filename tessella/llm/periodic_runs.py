"""Runs (maximal repetitions) of words, found by partition refinement, and texts with runs collapsed.

A run is a stretch of words with smallest period q and at least 2 q words that can't be extended
with that period.  Positions of a text are classed by the factor (string of words) of length k
that starts there, for k = 1, 2, ...  A class splits where the positions one to the right fall into
different classes, and only the smaller parts of what split before are looked at, so every position
is looked at O(log n) times: O(n log n) for all lengths.  Each class is a list in text order.  Two
neighbours of a class at distance q when factors have length q are a square with a primitive root;
squares of one period at consecutive positions are merged into a run.

A link of two neighbours is noted with the length at which it came up; when it breaks (or at the
end) it was a square if the length equal to its distance lies between.  So nothing is searched at
any length.  Many texts are refined together, in numpy while many positions move and one by one
when few do (a text that repeats itself to its end loses one position a length).

Defined results: words are what stands between ASCII white space; a null text has none, no runs
and the empty text as its collapsed form; repeated rows stay; columns named like new ones are
replaced.  Texts are handled in blocks of about a megabyte; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import _IS_SPACE, map_rows, trimmed, utf8_blocks

#: With fewer positions to look at than this, they are looked at one by one.
FEW = 96

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, indptr, start byte, length in bytes) of the words of every row; equal words of a block have one id."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, np.zeros(len(offsets), np.int64), e, e
    inside = ~_IS_SPACE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    edge = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~edge | cut[:-1]))
    edge = np.concatenate([inside[1:], [False]])
    size = np.flatnonzero(inside & (~edge | cut[1:])) + 1 - starts
    packed = raw[inside]
    ends = np.concatenate([[0], np.cumsum(size)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    ids = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    return ids, np.searchsorted(starts, offsets), starts, size


class Refinement:
    """Classes of the positions of many rows of symbols (ids, indptr); every row ends with a symbol of its own."""

    def __init__(self, ids: np.ndarray, indptr: np.ndarray, least: int):
        count = np.diff(indptr)
        rows = len(count)
        self.base = indptr + np.arange(rows + 1)  # the first position of a row
        n = len(ids) + rows
        row = np.repeat(np.arange(rows), count + 1)
        kinds = int(ids.max(initial=-1)) + 2
        symbol = np.full(n, kinds - 1, np.int64)
        symbol[np.arange(len(ids)) + np.repeat(np.arange(rows), count)] = ids
        # No square has a period beyond half a row, and no run of a shorter row counts.
        self.most = np.where(count >= least, count // 2, 0)[row].astype(np.int64)
        key = row * kinds + symbol
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.where = np.empty(n, np.int64)
        self.where[self.order] = np.arange(n)
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, n))
        self.cls = np.empty(n, np.int64)
        self.cls[self.order] = np.repeat(np.arange(len(heads)), size)
        self.classes = len(heads)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)  # there are never more classes than positions
        self.start[: len(heads)], self.size[: len(heads)] = heads, size
        same = np.concatenate([key[1:] == key[:-1], [False]]) if n else np.zeros(0, bool)
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.next[self.order[same]] = self.order[np.flatnonzero(same) + 1]
        self.prev[self.order[np.flatnonzero(same) + 1]] = self.order[same]
        self.born = np.ones(n, np.int64)
        self.mark = np.zeros(n, dtype=bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        # At length 1, all classes of a row but its largest are small.
        large = np.zeros(len(heads), dtype=bool)
        if n:
            by = np.lexsort((-size, row[self.order[heads]]))
            own = row[self.order[heads]][by]
            large[by[np.concatenate([[True], own[1:] != own[:-1]])]] = True
        self.small = np.flatnonzero(~large[self.cls]) if n else np.zeros(0, np.int64)

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of all squares with a primitive root."""
        k, small = 1, self.small
        source = self.cls[small]
        while len(small) >= FEW:
            k += 1
            small, source = self._split(k, small, source)
        if len(small):
            self._split_few(k, small.tolist(), source.tolist())
        at = np.flatnonzero(self.next >= 0)
        gap = self.next[at] - at
        whole = (self.born[at] <= gap) & (gap <= self.most[at])
        self.found.append((at[whole], gap[whole]))
        return np.concatenate([a for a, _ in self.found]), np.concatenate([g for _, g in self.found])

    def _relink(self, at: np.ndarray, to: np.ndarray, k: int) -> None:
        """New next positions from length k on; the old links that were squares are noted."""
        gap = self.next[at] - at
        whole = (self.next[at] >= 0) & (self.born[at] <= gap) & (gap < k)
        if whole.any():
            self.found.append((at[whole], gap[whole]))
        self.next[at], self.born[at] = to, k

    def _split(self, k: int, small: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of length k from those of k - 1: positions before small classes (source) leave their class, dealt by source.

        Returns the positions of the classes that are small now, with their classes.
        """
        none = np.zeros(0, np.int64)
        y = small - 1
        ok = y >= 0
        y, s = y[ok], source[ok]
        c = self.cls[y]
        ok = (self.size[c] > 1) & (self.most[y] >= k)
        y, s, c = y[ok], s[ok], c[ok]
        if not len(y):
            return none, none
        by = np.lexsort((y, s, c))
        y, s, c = y[by], s[by], c[by]
        head = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
        g_at = np.flatnonzero(head)
        g_size, g_class = np.diff(np.append(g_at, len(y))), c[g_at]
        c_at = np.flatnonzero(np.concatenate([[True], g_class[1:] != g_class[:-1]]))
        parts, own = np.diff(np.append(c_at, len(g_class))), g_class[c_at]
        taken, greatest = np.add.reduceat(g_size, c_at), np.maximum.reduceat(g_size, c_at)
        rest = self.size[own] - taken
        real = (rest > 0) | (parts > 1)  # else the whole class goes on together
        if not real.any():
            return none, none
        y, keep = y[np.repeat(real, taken)], np.repeat(real, parts)
        g_size = g_size[keep]
        own, parts, taken, greatest, rest = own[real], parts[real], taken[real], greatest[real], rest[real]
        g_of = np.repeat(np.arange(len(own)), parts)
        # The first of the largest groups keeps the class's number where nothing else is left of it.
        top = np.flatnonzero(g_size == greatest[g_of])
        top = top[np.concatenate([[True], g_of[top][1:] != g_of[top][:-1]])]
        number = np.empty(len(g_size), np.int64)
        stays = np.zeros(len(g_size), dtype=bool)
        stays[top[rest == 0]] = True
        number[stays] = own[rest == 0]
        fresh = int((~stays).sum())
        number[~stays] = self.classes + np.arange(fresh)
        self.classes += fresh
        # Groups move to the front of their class's slots; what stood there takes the slots that they leave.
        before = np.cumsum(taken) - taken
        slot = np.arange(len(y)) + np.repeat(self.start[own] - before, taken)
        left = self.where[y]
        self.mark[y] = True
        there = self.order[slot]
        there = there[~self.mark[there]]
        left = left[left >= np.repeat(self.start[own] + taken, taken)]
        self.order[left], self.where[there] = there, left
        self.order[slot], self.where[y] = y, slot
        self.mark[y] = False
        g_at = np.cumsum(g_size) - g_size
        self.start[own] += taken
        self.size[own] = rest
        self.start[number], self.size[number] = slot[g_at], g_size
        self.cls[y] = np.repeat(number, g_size)
        # What is left of a class closes up over the positions that have gone.
        some = np.repeat(rest > 0, taken)
        if some.any():
            gone, of = y[some], np.repeat(own, taken)[some]
            gone = gone[np.lexsort((gone, of))]
            first = np.concatenate([[True], self.prev[gone[1:]] != gone[:-1]])
            p, q = self.prev[gone[first]], self.next[gone[np.append(first[1:], True)]]
            self.prev[q[q >= 0]] = p[q >= 0]
            self._relink(p[p >= 0], q[p >= 0], k)
        tail = np.zeros(len(y), dtype=bool)
        tail[g_at + g_size - 1] = True
        to = np.append(y[1:], -1)
        to[tail] = -1
        changed = self.next[y] != to
        self._relink(y[changed], to[changed], k)
        back = np.append(-1, y[:-1])
        back[g_at] = -1
        self.prev[y] = back
        # All parts but the largest are small.
        little = np.ones(len(g_size), dtype=bool)
        little[top[rest < greatest]] = False
        out = y[np.repeat(little, g_size)]
        short = (rest > 0) & (rest < greatest)
        if short.any():
            n = rest[short]
            more = self.order[np.arange(n.sum()) + np.repeat(self.start[own[short]] - (np.cumsum(n) - n), n)]
            out = np.concatenate([out, more])
        return out, self.cls[out]

    def _split_few(self, k: int, small: list[int], source: list[int]) -> None:
        """The same from length k on, position by position."""
        order, where, cls, start, size, after, before, born, most = (a.tolist() for a in (self.order, self.where, self.cls, self.start, self.size, self.next, self.prev, self.born, self.most))
        classes, at, gaps = self.classes, [], []

        def link(p: int, q: int) -> None:
            gap = after[p] - p
            if born[p] <= gap < k:
                at.append(p)
                gaps.append(gap)
            after[p], born[p] = q, k

        while small:
            k += 1
            marked: dict[int, dict[int, list[int]]] = {}
            for x, s in zip(small, source, strict=True):
                c = cls[x - 1] if x else -1
                if x and size[c] > 1 and most[x - 1] >= k:
                    marked.setdefault(c, {}).setdefault(s, []).append(x - 1)
            small, source = [], []
            for c, by_source in marked.items():
                groups = list(by_source.values())
                rest = size[c] - sum(map(len, groups))
                if not rest and len(groups) == 1:
                    continue
                for group in groups:
                    group.sort()
                    if rest:
                        for y in group:
                            p, q = before[y], after[y]
                            if p >= 0:
                                link(p, q)
                            if q >= 0:
                                before[q] = p
                for group in groups:
                    for y, to in zip(group, [*group[1:], -1], strict=True):
                        if after[y] != to:
                            link(y, to)
                    for y, p in zip(group, [-1, *group[:-1]], strict=True):
                        before[y] = p
                if not rest:  # the largest group stays as the class
                    stays = max(groups, key=len)
                    groups = [g for g in groups if g is not stays]
                    rest = len(stays)
                slot = start[c]
                numbers = []
                for group in groups:
                    numbers.append(classes)
                    start[classes], size[classes] = slot, len(group)
                    for y in group:
                        w, other = where[y], order[slot]
                        order[w], where[other] = other, w
                        order[slot], where[y], cls[y] = y, slot, classes
                        slot += 1
                    classes += 1
                start[c], size[c] = slot, rest
                largest = max(range(len(groups)), key=lambda i: len(groups[i]))  # noqa: B023
                if rest >= len(groups[largest]):
                    largest = -1
                else:
                    small += order[slot : slot + rest]
                    source += [c] * rest
                for i, (group, number) in enumerate(zip(groups, numbers, strict=True)):
                    if i != largest:
                        small += group
                        source += [number] * len(group)
        self.next, self.born = np.array(after, np.int64), np.array(born, np.int64)
        self.found.append((np.array(at, np.int64), np.array(gaps, np.int64)))


def find_runs(ids: np.ndarray, indptr: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of at least `least` symbols, by row, start and period."""
    refined = Refinement(ids, indptr, least)
    at, period = refined.squares()
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    head = np.concatenate([[True], (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    squares = np.diff(np.append(first, len(at)))
    at, period = at[first], period[first]
    length = squares - 1 + 2 * period
    row = np.searchsorted(refined.base, at, side="right") - 1
    start = at - refined.base[row]
    by = np.lexsort((period, start, row))
    by = by[length[by] >= least]
    return row[by], start[by], length[by], period[by]


def collapsed(raw: np.ndarray, starts: np.ndarray, size: np.ndarray, indptr: np.ndarray, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the rows' words that aren't dropped, joined by one space."""
    kept = np.flatnonzero(~dropped)
    upto = np.searchsorted(kept, indptr)
    starts, size = starts[kept], size[kept]
    space = np.ones(len(kept), np.int64)
    space[upto[1:][upto[1:] > upto[:-1]] - 1] = 0
    ends = np.concatenate([[0], np.cumsum(size + space)])
    out = np.full(ends[-1], 32, np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(ends[:-1], size) + step] = raw[np.repeat(starts, size) + step]
    return out, ends[upto]


def annotate(docs: DataFrame, *, text: str = "text", least: int = 12) -> DataFrame:
    """All columns of docs, with two more: runs (array of start, length and period in words, by start, then period) and collapsed.

    Only runs of at least `least` words count.  A word is dropped from the collapsed text if a
    run contains it after the run's first period; what is left is joined by single spaces.
    """
    kept = docs.drop("runs", "collapsed")
    at = kept.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, offsets in utf8_blocks(b.column(at)):
                part = b.slice(i, j - i)
                ids, indptr, starts, size = words(raw, offsets)
                row, start, length, period = find_runs(ids, indptr, least)
                upto = np.searchsorted(row, np.arange(part.num_rows + 1))
                listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_ARROW_RUN)))
                cover = np.zeros(len(ids) + 1, np.int64)
                np.add.at(cover, indptr[row] + start + period, 1)
                np.add.at(cover, indptr[row] + start + length, -1)
                data, ends = collapsed(raw, starts, size, indptr, np.cumsum(cover)[:-1] > 0)
                joined = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, listed, joined], names=[*part.schema.names, "runs", "collapsed"])

    return map_rows(kept, trimmed(apply), (StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())))
