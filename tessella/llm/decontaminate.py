"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts are words.  A benchmark item of n words matches a document that holds it within
floor((1 - similarity) n) word edits.  For each document:

1. Shared q-grams name the windows: with at most k edits, at least n - q + 1 - q k of an
   item's q-grams stand in the document within 2 k neighbouring diagonals, so a window is
   looked at exactly if some item could be there.
2. Each window of the item's size, and each item, is embedded by the CGK random walk
   (a shared random bit for each step and word says whether the walk moves on), which turns
   edit distance into Hamming distance; in each of ``tables`` repetitions a few coordinates
   are sampled (``samples``), and window and item meet if they agree on all of them.  The number of
   repetitions follows from the recall that is asked for (``tables_for``).
3. Pairs that met are verified by the exact edit distance of the item to the best passage.

One narrow pass over the documents: nothing is shuffled.  Items are broadcast in blocks of
at most ``block_words`` words (or one item), one pass for each block, so the broadcast is
bounded however large the benchmark.  Items and windows are embedded in groups of like
length, so none is padded to more than twice its own.

Defined results: a null or blank text matches nothing, and neither does an item without
words; equal items match alike, each under its own item_id; repeated rows give repeated
result rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, map_rows, mix64, trimmed, utf8_blocks, word_hashes

_U = np.uint64
_NONE = _U(0x6A09E667F3BCC909)  # what the walk emits beyond the last word
HITS = "doc_id long, item_id long, start int, end int, edits int, n_words int, similarity double"


def walk(words: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings of rows of words (padded; n words each), 3 steps a word: one row for each, columns are steps."""
    rows, width = words.shape
    padded = np.concatenate([words, np.full((rows, 1), _NONE, _U)], axis=1)
    padded[np.arange(width + 1) >= n[:, None]] = _NONE
    steps = 3 * width
    out = np.empty((steps, rows), dtype=_U)
    at, row = np.zeros(rows, np.int64), np.arange(rows)
    for j in range(steps):
        w = padded[row, np.minimum(at, width)]
        out[j] = w
        at += (mix64(w + _U((seed * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> _U(63)).astype(np.int64)
    return out.T


def table_keys(words: np.ndarray, n: np.ndarray, tables: int, samples: int) -> np.ndarray:
    """One key for each row and table: the sampled coordinates of a walk over the first 3 n steps."""
    keys = np.empty((len(words), tables), dtype=_U)
    rng = np.random.default_rng(20)
    row = np.arange(len(words))
    for seed in range(4):  # repetitions share four walks
        e = walk(words, n, seed)
        for t in range(seed, tables, 4):
            h = n.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + _U(t)
            for u in rng.random(samples):
                h = mix64(h + e[row, (u * 3 * n).astype(np.int64)])
            keys[:, t] = h
    return keys


def tables_for(recall: float, agree: float, samples: int) -> int:
    """Repetitions after which two strings that agree on a share of their coordinates have met with probability recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**samples)))


#: Words of one group that is embedded at once.
WAVE_WORDS = 1 << 18


def like_lengths(n: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of lengths within a factor of two, of about WAVE_WORDS words when padded."""
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        least = int(n[order[at]])
        end = int(np.searchsorted(n[order], 2 * max(least, 8), side="left"))
        end = max(at + 1, min(end, at + WAVE_WORDS // max(int(n[order[end - 1]]), 1)))
        yield order[at:end]
        at = end


def passage_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of text with the least word edits to item; of equals the first to end, then the longest."""
    n, m = len(item), len(text)
    cost = np.zeros(m + 1, np.int64)
    start = np.arange(m + 1)
    columns = np.arange(m + 1)
    for i in range(1, n + 1):
        change = cost[:-1] + (text != item[i - 1])
        drop = cost + 1
        best, origin = drop.copy(), start.copy()
        better = (change < best[1:]) | ((change == best[1:]) & (start[:-1] < origin[1:]))
        best[1:][better], origin[1:][better] = change[better], start[:-1][better]
        # insertions: a running minimum of best - column, keeping the origin of where it was reached
        level = best - columns
        low = np.minimum.accumulate(level)
        new = np.maximum.accumulate(np.where(level == low, columns, 0))
        cost, start = low + columns, origin[new]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


@dataclass(frozen=True)
class Items:
    """A block of benchmark items, ready for search."""

    ids: list[int | None]
    n: np.ndarray
    k: np.ndarray
    need: np.ndarray
    words: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by q: sorted hashes, item, place
    keys: np.ndarray
    key_item: np.ndarray


def prepare(ids: list, texts: list[str | None], similarity: float, tables: int, samples: int) -> Items:
    column = pa.array(texts, pa.string())
    rows = [h[p[r] : p[r + 1]] for i, j, raw, o in utf8_blocks(column, 1 << 22) for h, p, _, _ in [word_hashes(raw, o)] for r in range(j - i)]
    known = [r for r, w in enumerate(rows) if len(w)]
    n = np.array([len(rows[r]) for r in known], dtype=np.int64)
    k = np.floor((1 - similarity) * n + 1e-9).astype(np.int64)
    words = [rows[r] for r in known]
    need, q_of = np.ones(len(known), np.int64), np.ones(len(known), np.int64)
    for a in range(len(known)):
        for q in (3, 2, 1):
            shared = n[a] - q + 1 - q * k[a]
            if shared >= 2 or q == 1:
                need[a], q_of[a] = max(1, shared), q
                break
    grams = {}
    for q in np.unique(q_of).tolist():
        own = [(combine(words[a], q), a) for a in np.flatnonzero(q_of == q)]
        h = np.concatenate([g for g, _ in own])
        item = np.concatenate([np.full(len(g), a) for g, a in own])
        place = np.concatenate([np.arange(len(g)) for g, _ in own])
        o = np.argsort(h, kind="stable")
        grams[q] = (h[o], item[o], place[o])
    table = np.zeros((len(known), tables), _U)
    for own in like_lengths(n):
        block = np.full((len(own), int(n[own].max())), _NONE, _U)
        for i, a in enumerate(own):
            block[i, : n[a]] = words[a]
        table[own] = table_keys(block, n[own], tables, samples)
    keys = table.reshape(-1)
    o = np.argsort(keys, kind="stable")
    return Items([ids[r] for r in known], n, k, need, words, grams, keys[o], np.repeat(np.arange(len(known)), tables)[o])


def windows(items: Items, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, first word) of the item-sized windows that the shared q-grams leave; words of many documents, row their document."""
    found_item, found_at = [], []
    for q, (hashes, item, place) in items.grams.items():
        g = combine(words, q)
        if not len(g):
            continue
        inside = row[: len(g)] == row[q - 1 :][: len(g)]
        lo = np.searchsorted(hashes, g)
        hit = np.flatnonzero((lo < len(hashes)) & inside)
        hit = hit[hashes[lo[hit]] == g[hit]]
        if not len(hit):
            continue
        lo, count = lo[hit], np.searchsorted(hashes, g[hit], side="right") - lo[hit]
        pos = np.repeat(hit, count)
        entry = np.repeat(lo, count) + np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count)
        t, diagonal = item[entry], pos - place[entry]
        # the same q-gram may stand on a diagonal once for each place only
        o = np.lexsort((diagonal, row[pos], t))
        t, diagonal, r = t[o], diagonal[o], row[pos][o]
        last = np.arange(len(t)) + items.need[t] - 1
        ok = last < len(t)
        last = np.minimum(last, len(t) - 1)
        ok &= (t[last] == t) & (r[last] == r) & (diagonal[last] - diagonal <= 2 * items.k[t])
        mark = np.zeros(len(t) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(ok), 1)
        np.add.at(mark, last[ok] + 1, -1)
        keep = np.cumsum(mark[:-1]) > 0
        pairs = np.unique(np.stack([t[keep], diagonal[keep], r[keep]]), axis=1)
        found_item.append(pairs[0])
        first = np.searchsorted(row, pairs[2])  # a window starts within its document
        found_at.append(np.maximum(pairs[1], first))
    if not found_item:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_item), np.concatenate(found_at)


def search(items: Items, words: np.ndarray, indptr: np.ndarray, tables: int, samples: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(document, item): (edits, first word, end word)}: the best passage of each pair that is within the item's edits."""
    row = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    item, at = windows(items, words, row)
    met: set[tuple[int, int, int]] = set()
    if len(item):
        spans = np.unique(np.stack([at, items.n[item]]), axis=1)
        for own in like_lengths(spans[1]):
            start, n = spans[0, own], spans[1, own]
            place = start[:, None] + np.arange(int(n.max()))
            ends = indptr[row[start] + 1]
            outside = (place >= ends[:, None]) | (np.arange(place.shape[1]) >= n[:, None])
            block = words[np.minimum(place, len(words) - 1)]
            block[outside] = _NONE
            keys = table_keys(block, n, tables, samples)
            lo, hi = np.searchsorted(items.keys, keys), np.searchsorted(items.keys, keys, side="right")
            w, t = np.nonzero(hi > lo)
            for a, b, c in zip(start[w].tolist(), lo[w, t].tolist(), hi[w, t].tolist(), strict=True):
                met.update((int(row[a]), x, a) for x in items.key_item[b:c].tolist())
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    spans_of: list[list[int]] = []
    for r, t, a in sorted(met):  # windows that overlap, widened by their edits, are verified as one
        n, k = int(items.n[t]), int(items.k[t])
        if spans_of and spans_of[-1][:2] == [r, t] and a - spans_of[-1][3] <= 2 * k:
            spans_of[-1][3] = a
        else:
            spans_of.append([r, t, a, a])
    for r, t, a, z in spans_of:
        n, k = int(items.n[t]), int(items.k[t])
        lo, hi = max(int(indptr[r]), a - k), min(int(indptr[r + 1]), z + n + k)
        edits, s, e = passage_distance(items.words[t], words[lo:hi])
        if edits <= k:
            got = (edits, lo + s, lo + e)
            if (r, t) not in best or got < best[r, t]:
                best[r, t] = got
    return best


def _searcher(held, tables: int, samples: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        for b in batches:
            out: list[tuple] = []
            for i, j, raw, offsets in utf8_blocks(b.column(1)):
                words, indptr, starts, ends = word_hashes(raw, offsets)
                heads = np.cumsum((raw & 0xC0) != 0x80)  # code points up to each byte
                for (r, t), (edits, s, e) in search(items, words, indptr, tables, samples).items():
                    before = int(heads[offsets[r] - 1]) if offsets[r] else 0
                    at = [int(heads[x - 1]) - before if x else 0 for x in ((starts[s] if e > s else 0), (ends[e - 1] if e > s else 0))]
                    out.append((b.column(0)[i + r].as_py(), items.ids[t], *at, edits, int(items.n[t]), 1 - edits / int(items.n[t])))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits", "n_words", "similarity"])

    return apply


def _blocks(benchmark: DataFrame, similarity: float, tables: int, samples: int, block_words: int) -> Iterator[Items]:
    """The benchmark's items in ascending order, at most about block_words words at a time; at least one block."""
    ids, texts, size, none = [], [], 0, True
    known = benchmark.where(F.col("text").isNotNull())
    for item in known.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(item[0])
        texts.append(item[1])
        size += len(item[1].split())
        if size >= block_words:
            yield prepare(ids, texts, similarity, tables, samples)
            ids, texts, size, none = [], [], 0, False
    if ids or none:
        yield prepare(ids, texts, similarity, tables, samples)


#: Of pairs as far apart as the similarity 0.8 allows, 19 of 20 agree on this share of the coordinates of their four
#: walks or more (measured on replaced and inserted words, 20 to 120 words); they meet with this probability.
RECALL, AGREE = 0.99, 0.33


def find(docs: DataFrame, benchmark: DataFrame, *, similarity: float = 0.8, recall: float = RECALL, agree: float = AGREE, samples: int = 2, block_words: int = 1_000_000) -> DataFrame:
    """One row for each document and benchmark item that it holds: the best passage, in code points of the text.

    An item without an id is found as well; its item_id is null.
    """
    tables = tables_for(recall, agree, samples)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _blocks(benchmark, similarity, tables, samples, block_words):
        part = rows.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(items), tables, samples), HITS)
        out = part if out is None else out.unionAll(part)
    return out


def _cleaner(held, at: int, tables: int, samples: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = np.ones(b.num_rows, dtype=bool)
            for i, _, raw, offsets in utf8_blocks(b.column(at)):
                words, indptr, _, _ = word_hashes(raw, offsets)
                for r, _ in search(held.value, words, indptr, tables, samples):
                    clean[i + r] = False
            yield b.filter(pa.array(clean))

    return apply


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", similarity: float = 0.8, recall: float = RECALL, agree: float = AGREE, samples: int = 2, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item."""
    tables = tables_for(recall, agree, samples)
    for items in _blocks(benchmark, similarity, tables, samples, block_words):
        held = docs.sparkSession.sparkContext.broadcast(items)
        docs = map_rows(docs, trimmed(_cleaner(held, docs.columns.index(text), tables, samples)))
    return docs
