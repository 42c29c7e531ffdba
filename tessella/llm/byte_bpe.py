"""Byte-level BPE encoding by backtracking from longest matches, and decoding.

The split pattern cuts a text into pieces, each encoded on its own.  The bytes of a piece are
read as Latin-1 characters, so that an Aho-Corasick automaton over the tokens, both written
backwards, finds the longest token that starts at every byte.  Two tokens may stand side by side
if merging their bytes gives just these two; a sequence whose neighbours all may is what the
merges give, and there is one only.  So the encoder takes the longest token, goes to the next
shorter one where it doesn't fit its left neighbour, steps back where none fits, and marks ends
that lead nowhere; no byte is stepped back from twice.  Compatible pairs are memoised, and so are pieces.

Defined results: a null or empty text has no tokens; nulls in other columns and repeated rows stay
as they are; a column named like a new one is replaced.  Special tokens aren't looked for: their
strings are ordinary text.  A piece that is a token as a whole is that token, even if no merges
make it.  Decoding null gives null, and so do ids that the vocabulary lacks.  Texts are handled in
blocks of about a megabyte; a longer text is a block of its own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from .common import map_rows, trimmed, utf8_blocks
from .packing import byte_ranks


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a rank file (lines of Base64 and rank) or of a byte-level vocabulary in JSON."""
    if path.endswith(".json"):
        return byte_ranks(path)[0]
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Vocabulary:
    """Tokens by rank, as bytes end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * top
        for t, r in ranks.items():
            self.token[r] = t
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
        """The bytes of rows of ids; None for a row with an id that no token has."""
        known = (ids >= 0) & (ids < len(self.token))
        known[known] = self.size[ids[known]] > 0
        ids = np.where(known, ids, 0)
        size = np.where(known, self.size[ids], 0) if len(self.token) else np.zeros(len(ids), np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1]) if len(ids) else np.zeros(0, np.int64)
        raw = self.blob[at].tobytes()
        bad = np.concatenate([[0], np.cumsum(~known)])
        rows = zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), (bad[offsets[1:]] > bad[offsets[:-1]]).tolist(), strict=True)
        return [None if wrong else raw[a:b] for a, b, wrong in rows]


class Encoder(Vocabulary):
    """Ids of texts.  Both memos are bounded: they start anew when they are full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, *, most_pairs: int = 1_000_000, most_ids: int = 2_000_000):
        super().__init__(ranks)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.find = regex.compile(pattern).findall
        self.most_pairs, self.most_ids = most_pairs, most_ids
        self.pairs: dict[int, bool] = {}
        self.length = self.size.tolist()
        made = [r for t, r in ranks.items() if self.merge(t) == [r]]  # what no merges make can only be a whole piece
        self.automaton = ahocorasick.Automaton()
        for r in made:
            self.automaton.add_word(self.token[r][::-1].decode("latin-1"), r)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(self.token)
        there = {self.token[r]: r for r in made}
        for r in made:
            t = self.token[r]
            self.shorter[r] = next((there[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in there), -1)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.begin, self.count = array("i"), array("q"), array("q")

    def merge(self, raw: bytes, border: int = 0) -> list[int]:
        """Ids by the merges themselves, for strings of a token or two: the lowest rank first, of equal ones the leftmost; none if one crosses the border."""
        rank, none = self.ranks.get, 1 << 62
        cuts = list(range(len(raw) + 1))
        near = [rank(raw[k : k + 2], none) for k in range(len(raw) - 1)]  # of the two parts from cuts[k] on
        while near:
            least = min(near)
            if least == none:
                break
            k = near.index(least)
            if cuts[k + 1] == border:
                return []
            del cuts[k + 1], near[k]
            if k:
                near[k - 1] = rank(raw[cuts[k - 1] : cuts[k + 1]], none)
            if k < len(near):
                near[k] = rank(raw[cuts[k] : cuts[k + 2]], none)
        return [self.ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may be neighbours."""
        key = left * len(self.token) + right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            got = self.pairs[key] = self.merge(self.token[left] + self.token[right], self.length[left]) == [left, right]
        return got

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n, length, shorter, fits = len(raw), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, r in self.automaton.iter(raw[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0 or length[r] > length[longest[at]]:
                longest[at] = r
        out: list[int] = []
        dead = bytearray(n + 1)
        at, r = 0, longest[0]
        while at < n:
            if r < 0:  # nothing fits here: the token before must be a shorter one
                dead[at] = 1
                r = out.pop()
                at -= length[r]
                r = shorter[r]
            elif dead[at + length[r]] or (out and not fits(out[-1], r)):
                r = shorter[r]
            else:
                out.append(r)
                at += length[r]
                r = longest[at] if at < n else -1
        return out

    def _number(self, piece: str) -> int:
        k = self.index[piece] = len(self.begin)
        ids = self.encode_piece(piece.encode())
        self.begin.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        return k

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows)."""
        if len(self.flat) > self.most_ids:
            self.forget()
        known = self.index.get
        numbers, pieces = array("q"), [0]
        for t in texts:
            for p in self.find(t) if t else ():
                k = known(p)
                numbers.append(self._number(p) if k is None else k)
            pieces.append(len(numbers))
        k = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        begin, count, flat = (np.array(x) for x in (self.begin, self.count, self.flat))
        size = count[k] if len(k) else k
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        ids = flat[np.repeat(begin[k] - ends[:-1], size) + np.arange(ends[-1])] if len(k) else np.zeros(0, np.int32)
        return ids.astype(np.int32), ends[np.array(pieces)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of docs, with the ids of the text in one more (array of int, never null)."""
    kept = docs.drop(out)
    at = kept.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            for i, j, _, _ in utf8_blocks(b.column(at)):
                part = b.slice(i, j - i)
                ids, offsets = own.encode(part.column(at).to_pylist())
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, listed], names=[*part.schema.names, out])

    return map_rows(kept, trimmed(apply), (StructField(out, ArrayType(IntegerType())),))


def decode(docs: DataFrame, path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of docs, with the bytes that the ids stand for in one more."""
    kept = docs.drop(out)
    at = kept.columns.index(ids)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for b in batches:
            step = 1024
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                rows = part.column(at)
                flat, offsets = rows.flatten(), np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                raw = own.decode(flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                raw = [x if there else None for x, there in zip(raw, rows.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, out])

    return map_rows(kept, trimmed(apply), (StructField(out, BinaryType()),))
