"""Personal data: patterns, and a skip-chain conditional random field over their neighbours.

Base spans are what the four patterns match.  Candidates are those and looser strings:
digit groups without a plus or a valid checksum, spelled-out or broken addresses.  The
candidates of a document are the variables of a random field with labels none, email, ip,
card and phone: each has potentials from its shape, neighbours in reading order are linked
(the chain), and so is each candidate with the next one of the same or similar normal form
(the skip chain), however far away.  Base spans are observed.  Loopy sum-product message
passing gives every other candidate's marginals; a candidate that is surely of a kind is
added as a span.

The patterns' own labels don't say what a broken mention looks like, so the fit writes some
itself: into documents that hold base spans it inserts mentions of them in another form
(``broken``), whose label is known, and beside each a number or address of the same form that
is nobody's (``strange``), labelled none.  What the patterns leave and no skip link ties to a
base span counts as none as well.  Weights are fitted by pseudo-likelihood on four fifths of
a bounded sample: documents picked by a hash of id and text, about ``fit_docs`` of them, of each
the first ``fit_nodes`` candidates.  On the last fifth the least marginal is chosen that
keeps ``precision`` of the inserted candidates right; that is what "surely" means.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive;
equal spans of two kinds both stay; repeated rows are treated alike; with no base span in the
sample only base spans are found; only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A match can't start inside a run of digits: it would have started with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: Runs of fewer than 14 digits are matched and dropped by the base pattern; here they don't match.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE_DIGITS = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
_HOST = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            # nothing that starts before this @ can match across it
            done, at = at + 1, text.find("@", at + 1)


def _loose_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spelled-out or broken addresses, leftmost first; each character is looked at a bounded number of times."""
    done, at = 0, _AT.search(text)
    while at:
        start = at.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at.end())
        if start < at.start() and host:
            yield start, host.end()
            done = host.end()
        else:
            done = at.start() + 1
        at = _AT.search(text, max(done, at.start() + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


@dataclass
class Field:
    """The candidates of one document: spans, base labels (-1: not base), shapes and links."""

    spans: list[tuple[int, int]]
    base: np.ndarray
    shape: np.ndarray
    links: np.ndarray  # (from, to, type): 0 chain, 1 same, 2 similar
    told: np.ndarray | None = None  # labels known without the patterns, or -1


SHAPES = 16


def _shape(s: str) -> list[float]:
    d = _digits(s)
    n = len(d)
    at = "@" in s or "at)" in s or "at]" in s
    return [1.0, at, not at and n == 7, not at and 8 <= n <= 9, not at and n == 10, not at and 11 <= n <= 13, not at and 14 <= n <= 19, not at and n > 19, s[0] == "+", "(" in s, s.count(".") == 3, "." in s, " " in s, "-" in s, not at and 14 <= n <= 19 and luhn(d), n == 0]


def _forms(s: str) -> tuple[str, str]:
    """Normal form, and a coarser one that similar strings share."""
    if "@" in s or "at)" in s or "at]" in s:
        f = re.sub(r" ?(?:\(at\)|\[at\]) ?", "@", s).replace(" ", "").lower().strip(".")
        return f, "@" + f.split("@")[0]
    d = _digits(s)
    return d, d[-7:]


def field(text: str, most: int | None = None) -> Field:
    base = base_spans(text)
    nodes = [(a, b, k) for a, b, k in base]
    covered = sorted((a, b) for a, b, _ in base)
    loose = [(m.start(), m.end()) for m in _LOOSE_DIGITS.finditer(text)]
    if "@" in text or "at)" in text or "at]" in text:
        loose += list(_loose_addresses(text))
    if loose:
        starts = np.array([a for a, _ in covered] or [1 << 60])
        reach = np.maximum.accumulate([b for _, b in covered] or [0])
        for a, b in loose:
            k = int(np.searchsorted(starts, b))  # base spans that start before the end
            if k == 0 or reach[k - 1] <= a:
                nodes.append((a, b, -1))
    nodes.sort(key=lambda x: (x[0], x[1], x[2]))
    if most is not None:
        nodes = nodes[:most]
    links = [(k, k + 1, 0) for k in range(len(nodes) - 1)]
    seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for k, (a, b, _) in enumerate(nodes):
        same, near = _forms(text[a:b])
        for kind, form in ((1, same), (2, near)):
            if form in seen[kind - 1] and not (kind == 2 and seen[0].get(same) == seen[1][form]):
                links.append((seen[kind - 1][form], k, kind))
        seen[0][same] = seen[1][near] = k
    return Field([(a, b) for a, b, _ in nodes], np.array([k for _, _, k in nodes], np.int64), np.array([_shape(text[a:b]) for a, b, _ in nodes], float).reshape(-1, SHAPES), np.array(links, np.int64).reshape(-1, 3))


@dataclass(frozen=True)
class Weights:
    shape: np.ndarray  # SHAPES x labels
    pair: np.ndarray  # link type x labels x labels
    sure: float = 0.9  # the least marginal of an added span


#: A message that changes by less than this has settled.
SETTLED = 1e-4


def marginals(f: Field, w: Weights, observed: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Label marginals of every candidate by loopy sum-product; observed holds a label or -1.

    Rounds go on until every message has settled; without rounds, their bound grows with the
    number of candidates, so that evidence gets through a chain of any length.  A round looks
    only at messages that still change or whose source does, so a long chain costs its length.
    """
    unary = f.shape @ w.shape
    held = observed >= 0
    unary[held] = -50.0
    unary[np.flatnonzero(held), observed[held]] = 0.0
    if not len(f.links):
        return _softmax(unary)
    src = np.concatenate([f.links[:, 0], f.links[:, 1]])
    dst = np.concatenate([f.links[:, 1], f.links[:, 0]])
    kind = np.concatenate([f.links[:, 2], f.links[:, 2]])
    back = np.concatenate([np.arange(len(f.links)) + len(f.links), np.arange(len(f.links))])
    pair = w.pair[kind]
    pair[len(f.links) :] = pair[len(f.links) :].transpose(0, 2, 1)
    message = np.zeros((len(src), len(LABELS)))
    belief = unary.copy()
    every = np.arange(len(src))
    live = every
    for _ in range(200 + 8 * len(unary) if rounds is None else rounds):
        out = belief[src[live]] - message[back[live]]
        x = out[:, :, None] + pair[live]
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        step = new - message[live]
        change = np.abs(step).max(axis=1)
        if len(live) == len(src) and change.max() < SETTLED:
            break
        message[live] += 0.5 * step  # damped, so that loops settle
        np.add.at(belief, dst[live], 0.5 * step)
        moving = np.zeros(len(src), bool)
        moving[live] = change >= SETTLED / 10
        moved = np.zeros(len(unary), bool)
        moved[dst[moving]] = True
        live = np.flatnonzero(moving | moved[src])
        if not len(live):  # small changes may have added up: all are looked at once more
            live = every
    belief = unary.copy()
    np.add.at(belief, dst, message)
    return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_weights(fields: list[Field], *, steps: int = 200, rate: float = 0.5, ridge: float = 1e-3) -> Weights:
    """Pseudo-likelihood: each target's label given its neighbours' labels.

    Base spans have their kind, told candidates their label; others count as none unless a link
    of the skip chain ties them to a base span, which leaves them out.  Every other base span is
    a target by its links alone: the patterns decide its shape, so shapes would hide the links.
    """
    shape, label, given, links, at = [], [], [], [], 0
    for f in fields:
        y = f.base + 1
        loose = f.base < 0
        for a, b, kind in f.links:
            if kind and loose[a] != loose[b]:
                y[a if loose[a] else b] = -1
        if f.told is not None:
            y = np.where(f.told >= 0, f.told, y)
        shape.append(f.shape)
        label.append(y)
        given.append(loose)
        links.append(f.links + np.array([at, at, 0]))
        at += len(y)
    x, y, e = np.concatenate(shape), np.concatenate(label), np.concatenate(links)
    known = y >= 0
    e = e[known[e[:, 0]] & known[e[:, 1]]]
    blind = (np.arange(len(y)) % 2 == 0) & (y > 0) & ~np.concatenate(given)
    x = np.where(blind[:, None], 0.0, x)
    n, m = len(y), len(LABELS)
    w, t = np.zeros((SHAPES, m)), np.zeros((3, m, m))
    one = np.eye(m)[np.maximum(y, 0)]
    for _ in range(steps):
        score = x @ w
        np.add.at(score, e[:, 0], t[e[:, 2], :, y[e[:, 1]]])
        np.add.at(score, e[:, 1], t[e[:, 2], y[e[:, 0]], :])
        g = (one - _softmax(score)) * known[:, None]
        w += rate * (x.T @ g / max(n, 1) * 10 - ridge * w)
        d = np.zeros_like(t)
        np.add.at(d, (e[:, 2], slice(None), y[e[:, 1]]), g[e[:, 0]])
        np.add.at(d, (e[:, 2], y[e[:, 0]]), g[e[:, 1]])
        t += rate * (d / max(n, 1) * 10 - ridge * t)
    t[2] += 0.5 * t[1]  # links of similar strings are rare: they start from half of what equal strings tell
    return Weights(w, t)


def broken(s: str, kind: int, form: int) -> str:
    """Another form of a base span, which the patterns miss."""
    if kind == 0:
        return s.replace("@", (" (at) ", " [at] ", "(at)", " @ ")[form % 4])
    if kind == 1:
        return s.replace(".", ("-", " ", ". ", " .")[form % 4])
    d = _digits(s)
    if kind == 2:
        return (".", "  ", " .", "--")[form % 4].join(d[k : k + 4] for k in range(0, len(d), 4))
    return (s.lstrip("+"), d, f"{d[:-10]}({d[-10:-7]}){d[-7:-4]}.{d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}")[form % 4]


def strange(s: str, seed: int) -> str:
    """s with other digits and letters: the same form, but nobody's."""
    out, h = [], seed
    for c in s:
        h = (h * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append(chr(48 + (h >> 33) % 10) if "0" <= c <= "9" else chr(97 + (h >> 33) % 26) if "a" <= c <= "z" and "at" not in s else c)
    return "".join(out)


def with_broken_mentions(text: str, seed: int, most: int | None = None) -> Field:
    """The candidates of text with a broken mention, and a strange one, of every other base span inserted at spaces."""
    gaps = [m.start() for m in re.finditer(" ", text)] or [len(text)]
    new: list[tuple[int, str, int]] = []
    for n, (a, b, kind) in enumerate(base_spans(text)[:most]):
        h = zlib.crc32(f"{seed}:{n}".encode())
        if h & 1:
            mention = broken(text[a:b], kind, h >> 1)
            at = gaps[(h >> 3) % len(gaps)], gaps[(h >> 13) % len(gaps)]
            new += [(at[0], mention, kind + 1), (at[1], strange(mention, h), 0)]
    parts, spots, done, size = [], [], 0, 0
    for at, mention, label in sorted(new):
        parts += [text[done:at], "; ", mention, " ;"]
        size += at - done + 2
        spots.append((size, size + len(mention), label))
        size += len(mention) + 2
        done = at
    f = field("".join([*parts, text[done:]]), most)
    told = np.full(len(f.base), -1)
    for k, (a, b) in enumerate(f.spans):
        for x, y, label in spots:
            if f.base[k] < 0 and a < y and x < b:
                told[k] = label
    f.told = told
    return f


def threshold(fields: list[Field], w: Weights, precision: float) -> float:
    """The least marginal at which this share of the told candidates that are named of a kind are of it; more than 1 if none."""
    best, right = [], []
    for f in fields:
        if f.told is None or not (f.told >= 0).any():
            continue
        p = marginals(f, w, np.where(f.base >= 0, f.base + 1, -1))[f.told >= 0]
        named = p[:, 1:].argmax(axis=1) + 1
        best.append(p[np.arange(len(p)), named])
        right.append(named == f.told[f.told >= 0])
    if not best:
        return w.sure
    p, ok = np.concatenate(best), np.concatenate(right)
    order = np.argsort(-p, kind="stable")
    good = np.flatnonzero(np.cumsum(ok[order]) >= precision * np.arange(1, len(p) + 1))
    return max(0.5, float(p[order][good[-1]])) if len(good) else 2.0


def spans(text: str | None, weights: Weights | None, sure: float | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, end, kind) by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    if weights is None:
        return base, base
    f = field(text)
    if not len(f.base) or (f.base >= 0).all():
        return base, base
    p = marginals(f, weights, np.where(f.base >= 0, f.base + 1, -1))
    added = []
    for k in np.flatnonzero(f.base < 0):
        best = int(p[k].argmax())
        if best and p[k, best] >= (weights.sure if sure is None else sure):
            added.append((*f.spans[k], best - 1))
    return base, sorted(base + added, key=lambda s: (s[0], s[2], s[1]))


def fit(docs: DataFrame, *, fit_docs: int = 20_000, fit_nodes: int = 200, precision: float = 0.98) -> Weights | None:
    """Weights from about fit_docs documents of docs (at most twice as many); None if they hold no base span.

    Half of them by chance are fitted with broken mentions inserted, and all as they are.
    """
    total = docs.count()
    text = F.col("text")
    key = F.xxhash64(F.col("doc_id").cast("long"), text)
    share = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(share < min(1.0, fit_docs / total) if total else F.lit(False)).select(key.alias("key"), text)
    if total > fit_docs and sample.count() > 2 * fit_docs:  # many rows of one id and text are in it: one of each
        sample = sample.dropDuplicates(["key"])
    names = ("base", "shape", "links", "told")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = defaultdict(list)
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole = t.as_py() or ""
                own = field(whole, fit_nodes)
                found = [own, with_broken_mentions(whole, key, fit_nodes)] if (own.base >= 0).any() else [own]
                for f in found:
                    if len(f.base):
                        told = np.full(len(f.base), -1) if f.told is None else f.told
                        for name, value in zip(("key", *names), (key, *(x.tobytes() for x in (f.base, f.shape, f.links, told))), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in names)], names=["key", *names])

    rows = sample.mapInArrow(apply, "key long, base binary, shape binary, links binary, told binary")
    rows = sorted(rows.collect(), key=lambda r: (r["key"], bytes(r["base"]), bytes(r["shape"])))
    fields = [Field([], np.frombuffer(r["base"], np.int64), np.frombuffer(r["shape"], float).reshape(-1, SHAPES), np.frombuffer(r["links"], np.int64).reshape(-1, 3), np.frombuffer(r["told"], np.int64)) for r in rows]
    if not any((f.base >= 0).any() for f in fields):
        return None
    tune = [r["key"] % 5 == 0 for r in rows]
    w = fit_weights([f for f, t in zip(fields, tune, strict=True) if not t] or fields)
    return replace(w, sure=threshold([f for f, t in zip(fields, tune, strict=True) if t], w, precision))


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, weights: Weights | None, *, sure: float | None = None) -> DataFrame:
    """One row for each document: doc_id, base and spans (both arrays of kind, start, end)."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda own: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in own]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [spans(t.as_py(), held.value, sure) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([named(g[i]) for g in got], kind) for i in (0, 1))], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, f"doc_id long, base {_SPAN}, spans {_SPAN}")


def redact(text: str, own: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first."""
    out, at = [], 0
    for a, b, k in own:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
    return "".join([*out, text[at:]])
