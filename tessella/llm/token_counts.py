"""Token counts by prefix dynamic programming over byte-pair merges.

For a word w the table holds, for every prefix, the number of tokens of its encoding and
the last token of it.  The last token of a prefix is the one token that ends there, is
its own encoding, and forms a valid pair with the last token of what stands before it;
a sequence of tokens is the encoding of its text exactly when each neighbouring pair is
the encoding of the pair's text.  So the count of a prefix is one more than that of a
shorter prefix, and nothing is encoded again.  White space separates words, so the
counts at word ends are running sums, and the count at any character is the sum before
its word plus the word's own table.

Defined results: a null text counts as empty (0 tokens); special strings inside a text
count as one token, as the library does by default; white space alone has no tokens;
repeated rows are counted alike.  Caches are bounded and only save time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import utf8_blocks

#: What str.split takes for white space but the tokenizer doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return [table[b] for b in range(256)]


def _parts(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


class _Cache(dict):
    """A dict that fills itself and starts anew when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class _Tokens:
    """Token ids by hash of their characters, in an open-addressing table; word-final tokens have a salt."""

    BASE, SALT, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D), 19

    def __init__(self, tokens: list[tuple[str, bool, int]]):
        size = 1 << self.BITS
        self.key, self.id = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        longest = max(len(t) for t, _, _ in tokens)
        codes = np.zeros((len(tokens), longest), np.uint64)
        lens = np.array([len(t) for t, _, _ in tokens])
        flat = np.frombuffer("".join(t for t, _, _ in tokens).encode("utf-16-le"), np.uint16)
        codes[np.arange(longest) < lens[:, None]] = flat
        h = np.zeros(len(tokens), np.uint64)
        for k in range(longest):
            h = np.where(k < lens, h * self.BASE + codes[:, k], h)
        h = self.final(h, np.array([end for _, end, _ in tokens]))
        for x, slot, (_, _, i) in zip(h.tolist(), self.slot(h).tolist(), tokens, strict=True):
            while self.id[slot] >= 0:
                slot = (slot + 1) & (size - 1)
            self.key[slot], self.id[slot] = x, i

    def final(self, h: np.ndarray, end) -> np.ndarray:
        return h ^ (np.asarray(end).astype(np.uint64) * self.SALT)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the tokens with these hashes, -1 where there is none."""
        slot = self.slot(h)
        out = self.id[slot]
        wrong = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.BITS) - 1)
            got = self.id[slot[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.key[slot[wrong]] != h[wrong])]
        return out


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes, for a tokenizer with word ends (a tokenizers .json file)."""

    def __init__(self, path: str, *, cached_chunks: int = 500_000, cached_words: int = 200_000, cached_pairs: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(model["merges"])}
        self.longest = max(len(t) - len(self.end) * t.endswith(self.end) for t in self.vocab)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.special_start = {t["content"][:2] for t in spec["added_tokens"]}
        self.byte_chars = byte_characters()
        self.tokens = _Tokens([(t.removesuffix(self.end), t.endswith(self.end), i) if self.end and t != self.end else (t, False, i) for t, i in self.vocab.items() if i not in {x["id"] for x in spec["added_tokens"]}])
        self.alone = _Cache(self._is_alone, 100_000)
        self.known_alone = np.full(max(self.vocab.values()) + 1, -1, dtype=np.int8)
        self.most_pairs = cached_pairs
        self.pair_key, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.pair = _Cache(self._is_pair, cached_pairs)
        self.spine = _Cache(self._spine, 100_000)
        made = {"".join(m): k for m, k in self.rank.items()}
        #: Each merge joins parts that earlier merges made; else pairs are decided by merging them.
        self.ordered = len(made) == len(self.rank) and all(made.get(x, -1) < k for m, k in self.rank.items() for x in m)
        self.words = _Cache(self._count_word, cached_words)
        self.chunks = _Cache(self._count_chunk, cached_chunks)

    # merges, for single tokens and pairs only

    def _symbols(self, token: int) -> list[str]:
        t = self.text_of[token]
        if self.end and t.endswith(self.end) and t != self.end:
            core = t[: -len(self.end)]
            return [*core[:-1], core[-1] + self.end]
        return list(t)

    def _merge(self, s: list[str]) -> list[str]:
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda k: self.rank.get((s[k], s[k + 1]), 1 << 60))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        return s

    def _is_alone(self, token: int) -> bool:
        return len(self._merge(self._symbols(token))) == 1

    def _spine(self, key: tuple[int, bool]) -> list[tuple[str, int]]:
        """The parts that stand, one after the other, at the right (True) or left edge of a token while it is built, each with the rank of the merge that ends it."""
        token, right = key
        s, out = self._symbols(token), []
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda k: self.rank.get((s[k], s[k + 1]), 1 << 60))
            if best == (len(s) - 2 if right else 0):
                out.append((s[-1 if right else 0], self.rank[s[best], s[best + 1]]))
            s[best : best + 2] = [s[best] + s[best + 1]]
        return [*out, (s[0], 1 << 60)]

    def _is_pair(self, pair: tuple[int, int]) -> bool:
        """Whether no merge across the border of the two comes before those that build them (of equal rank, the left one is first)."""
        if not self.ordered:
            return self._merge(self._symbols(pair[0]) + self._symbols(pair[1])) == [self.text_of[x] for x in pair]
        left, right = self.spine[pair[0], True], self.spine[pair[1], False]
        i = j = 0
        rank = self.rank.get
        while True:
            x, x_ends = left[i]
            y, y_ends = right[j]
            r = rank((x, y))
            if r is not None and r < x_ends and r <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == 1 << 60:
                    return True
                i += 1
            else:
                j += 1

    # the dynamic program

    def _last(self, w: str, i: int, ending: str, last: list[int], count: list[int]) -> tuple[int, int]:
        vocab, pair, alone = self.vocab, self.pair, self.alone
        for j in range(max(0, i - self.longest), i):
            t = vocab.get(w[j:i] + ending)
            if t is not None and alone[t] and (j == 0 or pair[last[j], t]):
                return t, count[j] + 1
        raise ValueError(f"no token ends at {i} of {w!r}")

    def _open_table(self, w: str, upto: int) -> tuple[list[int], list[int]]:
        last, count = [-1] * (upto + 1), [0] * (upto + 1)
        for i in range(1, upto + 1):
            last[i], count[i] = self._last(w, i, "", last, count)
        return last, count

    def word_prefixes(self, w: str) -> list[int]:
        """Token counts of w[:0], w[:1], ... w, each as a word of its own; w in byte characters."""
        last, count = self._open_table(w, len(w) - 1)
        return [0] + [self._last(w, i, self.end, last, count)[1] for i in range(1, len(w) + 1)]

    def _count_word(self, w: str) -> int:
        t = self.vocab.get(w + self.end)
        if t is not None and self.alone[t]:
            return 1
        last, count = self._open_table(w, len(w) - 1)
        return self._last(w, len(w), self.end, last, count)[1]

    # the same program for many words at once

    def _alone_all(self, t: np.ndarray) -> np.ndarray:
        for x in np.unique(t[self.known_alone[t] < 0]).tolist():
            self.known_alone[x] = self._is_alone(x)
        return self.known_alone[t] == 1

    def _pair_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), max(len(self.pair_key) - 1, 0))
        new = np.unique(key[self.pair_key[at] != key]) if len(self.pair_key) else np.unique(key)
        if len(new):
            ok = np.fromiter((self._is_pair((k >> 32, k & 0xFFFFFFFF)) for k in new.tolist()), bool, len(new))
            if len(self.pair_key) + len(new) > self.most_pairs:  # keep what this call asks for
                mine = np.unique(at[self.pair_key[at] == key]) if len(self.pair_key) else np.zeros(0, np.int64)
                self.pair_key, self.pair_ok = self.pair_key[mine], self.pair_ok[mine]
            where = np.searchsorted(self.pair_key, new)
            self.pair_key, self.pair_ok = np.insert(self.pair_key, where, new), np.insert(self.pair_ok, where, ok)
            at = np.searchsorted(self.pair_key, key)
        return self.pair_ok[at]

    def _count_words(self, words: list[str]) -> np.ndarray:
        """Token counts of words in byte characters: step i finds the last token of every word's prefix of i characters."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        flat = np.frombuffer("".join([words[k] for k in order]).encode("utf-16-le"), np.uint16).astype(np.uint64)
        start = np.cumsum(lens) - lens
        n, most = len(flat), int(lens[0])
        widths = min(self.longest, most)
        found, h = [], np.zeros(n, np.uint64)
        for w in range(widths):  # found[w]: the token of w + 1 characters from each place on, not word-final
            h = h[: n - w] * self.tokens.BASE + flat[w:]
            found.append(self.tokens.find(h))
        last, count = np.full((2, n + len(lens)), -1, np.int32)  # by word: prefixes of 0, 1, ... characters
        base = start + np.arange(len(lens))
        count[base] = 0
        end_count = np.zeros(len(lens), np.int32)
        rows_of = np.searchsorted(-lens, -np.arange(most + 2), side="right")  # words of at least so many characters
        for i in range(1, most + 1):
            for final in (False, True):
                longer = rows_of[i + 1] if i < most else 0
                rows = np.arange(longer) if not final else np.arange(longer, rows_of[i])
                for w in range(min(i, widths), 0, -1):
                    if not len(rows):
                        break
                    at = start[rows] + i - w
                    t = self._final_tokens(flat, at, w) if final else found[w - 1][at]
                    some = np.flatnonzero(t >= 0)
                    if not len(some):
                        continue
                    r, tok = rows[some], t[some]
                    ok = self._alone_all(tok)
                    if w < i:
                        ok[ok] = self._pair_all(last[base[r[ok]] + i - w], tok[ok])
                    r, tok = r[ok], tok[ok]
                    if final:
                        end_count[r] = count[base[r] + i - w] + 1
                    else:
                        last[base[r] + i], count[base[r] + i] = tok, count[base[r] + i - w] + 1
                    rest = np.ones(len(rows), bool)
                    rest[some[ok]] = False
                    rows = rows[rest]
                if len(rows):
                    raise ValueError(f"no token ends at {i} of {words[order[rows[0]]]!r}")
        out = np.empty(len(lens), np.int64)
        out[order] = end_count
        return out

    def _final_tokens(self, flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for w in range(width):
            h = h * self.tokens.BASE + flat[at + w]
        return self.tokens.find(self.tokens.final(h, True))

    def learn(self, chunks: set[str]) -> None:
        """Counts these words together, for the cache."""
        cache = self.chunks
        for some in _parts([c for c in chunks if c not in cache], 50_000):
            if len(cache) + len(some) > cache.most:
                cache.clear()
            parts = [[s.lower()] if s.isascii() and s.isalpha() else self._words_of(s) if "<" not in s else None for s in some]
            new = list({w for p in parts if p for w in p} - self.words.keys())
            if len(self.words) + len(new) > self.words.most:
                new = list({w for p in parts if p for w in p})
                self.words.clear()
            if new:
                self.words.update(zip(new, self._count_words(new).tolist(), strict=True))
            words = self.words
            for s, p in zip(some, parts, strict=True):
                cache[s] = self._count_chunk(s) if p is None else words[p[0]] if len(p) == 1 else sum([words[w] for w in p])

    # texts

    def _normal(self, s: str) -> str:
        s = unicodedata.normalize("NFC", s)
        return s.replace("Σ", "σ").lower()  # a capital sigma is lowered without regard to its place

    def _count_plain(self, s: str) -> int:
        if s.isascii() and s.isalpha():
            return self.words[s.lower()]
        return sum(self.words[w] for w in self._words_of(s))

    def _words_of(self, s: str) -> list[str]:
        c = self.byte_chars
        return [p if p.isascii() and p.isprintable() else "".join([c[b] for b in p.encode("utf-8")]) for p in self.pieces.findall(s.lower() if s.isascii() else self._normal(s))]

    def _count_chunk(self, s: str) -> int:
        if "<" in s and self.special.search(s):
            return sum(self._count_plain(x) for x in self.special.split(s)) + len(self.special.findall(s))
        return self._count_plain(s)

    @staticmethod
    def split(text: str) -> list[str]:
        """The words between white space; no token crosses it."""
        return [x for x in _SPACE.split(text) if x] if _NOT_SPACE.search(text) else text.split()

    def running_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """running() of each text; new words are counted together."""
        chunks = [self.split(t) if t else [] for t in texts]
        new: set[str] = set()
        for c in chunks:
            new.update(c)
        self.learn(new)
        for c in chunks:
            yield self._sums(c)

    def running(self, text: str | None) -> np.ndarray:
        """Token counts at the ends of the words of text."""
        return self._sums(self.split(text) if text else [])

    def _sums(self, chunks: list[str]) -> np.ndarray:
        return np.cumsum(np.fromiter(map(self.chunks.__getitem__, chunks), dtype=np.int64, count=len(chunks)))

    def count(self, text: str | None) -> int:
        r = self.running(text)
        return int(r[-1]) if len(r) else 0

    def table(self, text: str | None) -> PrefixTable:
        return PrefixTable(self, text or "")


class PrefixTable:
    """Answers for one text: the count at any prefix, and the longest prefix within a budget."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        spans = [(m.start(), m.end()) for m in regex.finditer(r"\P{White_Space}+", text)]
        self.start = np.array([a for a, _ in spans], dtype=np.int64)
        self.end = np.array([b for _, b in spans], dtype=np.int64)
        self.total = np.concatenate([[0], counter.running(text)])

    def at(self, n_chars: int) -> int:
        """Tokens of text[:n_chars]."""
        k = int(np.searchsorted(self.end, n_chars, side="right"))
        inside = self.text[self.start[k] : n_chars] if k < len(self.start) else ""
        return int(self.total[k]) + (self.counter._count_chunk(inside) if inside else 0)

    def fit(self, budget: int) -> int:
        """The most characters of a prefix with no more than budget tokens."""
        if budget >= self.total[-1]:
            return len(self.text)
        k = int(np.searchsorted(self.total, budget, side="right")) - 1
        base = int(self.total[k])
        for n in range(int(self.end[k]), int(self.start[k]), -1):
            if base + self.counter._count_chunk(self.text[self.start[k] : n]) <= budget:
                return n
        return int(self.start[k])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """The worker's counter for a tokenizer file; its caches live as long as the worker."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 2048) -> DataFrame:
    """All columns of docs but the text, with n_bytes, n_tokens, over_limit and fit_words (words within the limit)."""
    names = ("n_bytes", "n_tokens", "over_limit", "fit_words")
    rest = docs.drop(*names).withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    rest = rest.select(*[c for c in rest.columns if c != text], text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            n, fit = [], []
            texts = b.column(b.num_columns - 1)
            for i, j, _, _ in utf8_blocks(texts, 4 << 20):
                for r in c.running_all(texts.slice(i, j - i).to_pylist()):
                    n.append(int(r[-1]) if len(r) else 0)
                    fit.append(int(np.searchsorted(r, limit, side="right")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int32())], names=[*b.schema.names[:-1], *names[1:]])

    schema = StructType([*rest.drop(text).schema.fields, StructField("n_tokens", LongType()), StructField("over_limit", BooleanType()), StructField("fit_words", IntegerType())])
    return rest.mapInArrow(apply, schema)


def truncate(docs: DataFrame, tokenizer: str, budget: int, *, text: str = "text") -> DataFrame:
    """All columns of docs, the text cut to its longest prefix within budget tokens; a null text stays null."""
    at = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            cut = [None if t is None else t[: c.table(t).fit(budget)] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if k == at else x for k, x in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(apply, docs.schema)
