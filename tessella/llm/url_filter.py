"""URL verdicts: domain rules, and gradient-boosted trees on lexical features where no rule fits.

All DataFrame expressions.  Training labels are the verdicts of the rules.  At most about
``fit_rows`` labelled URLs are used, picked by a hash of the URL; they are binned, grouped
to distinct bin vectors with weights and written once.  A boosting level is one aggregation
of that table into gradient histograms (nodes x features x bins cells, whatever the input),
from which the splits follow; the trees become one CASE expression over the features.
Suffix statistics are the smoothed shares of blocked rows by a host's last label and by a
path's first folder in the sample, for those of at least ``support`` rows (so at most
fit_rows / support of each), in maps that are part of the plan.  What has no such share takes
the mean of a split's two sides, by the rows that were on each, so that the other features
decide.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule
and is judged by the model; without labelled URLs every verdict of the model is "allow";
repeated rows are judged alike; only the id and URL columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "suffix_rate", "folder_rate")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Split:
    feature: str
    at_most: float
    low: Split | float
    high: Split | float
    #: Share of the rows on the low side, for rows without the feature.
    share: float = 0.5

    def column(self) -> Column:
        low, high = (x.column() if isinstance(x, Split) else F.lit(float(x)) for x in (self.low, self.high))
        known = F.when(F.col(self.feature) <= self.at_most, low)
        return known.when(F.col(self.feature).isNull(), low * self.share + high * (1 - self.share)).otherwise(high) if self.feature.endswith("_rate") else known.otherwise(high)


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Split | float, ...]
    #: Shares of blocked rows by host suffix, and by first folder.
    rates: tuple[tuple[tuple[str, float], ...], tuple[tuple[str, float], ...]]

    def log_odds(self) -> Column:
        return reduce(lambda a, t: a + (t.column() if isinstance(t, Split) else F.lit(float(t))), self.trees, F.lit(self.base))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.when(known, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(known, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first, so it comes last
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.coalesce(F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), F.lit(0.0))


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^/([^/]*)/", 1)


def with_features(rows: DataFrame, model_rates: tuple[tuple[tuple[str, float], ...], ...]) -> DataFrame:
    """rows (url, host, path, ...) with the lexical features."""
    url = F.coalesce("url", F.lit(""))
    # the scheme, and what tells one page of a site from another, are left out
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    rates = [F.create_map(*[F.lit(x) for pair in r for x in pair]) if r else F.create_map().cast("map<string,double>") for r in model_rates]
    return rows.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        (F.size(F.filter(F.split("path", "/"), lambda x: x != ""))).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1))).cast("double").alias("digit_ratio"),
        F.round(_entropy(url), 6).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("params"),
        F.regexp_count("host", F.lit("-")).cast("double").alias("hyphens"),
        F.try_element_at(rates[0], suffix(F.col("host"))).alias("suffix_rate"),
        F.try_element_at(rates[1], folder(F.col("path"))).alias("folder_rate"),
    )


def _best_split(cells: dict[tuple[int, int], tuple[float, float]], features: int, ridge: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node's histogram; of equal gains the first."""
    best = None
    for f in range(features):
        own = sorted((b, g, h) for (k, b), (g, h) in cells.items() if k == f)
        g_all, h_all = sum(x[1] for x in own), sum(x[2] for x in own)
        g = h = 0.0
        for b, dg, dh in own[:-1]:
            g, h = g + dg, h + dh
            gain = round(g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge), 9)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, f, b)
    return best


def fit(labelled: DataFrame, *, fit_rows: int = 20_000, trees: int = 8, depth: int = 2, bins: int = 16, support: int = 20, rate: float = 0.4, ridge: float = 1.0) -> Model:
    """Boosts trees of logistic loss on rows (url, host, path, verdict)."""
    import math

    scratch = Scratch(labelled.sparkSession, "urls")
    y = F.col("verdict").eqNullSafe("block").cast("int")
    total = labelled.count()
    if not total:
        return Model(-10.0, (), ((), ()))
    share = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(share < min(1.0, fit_rows / total)).select("url", "host", "path", y.alias("y"))
    sample = scratch.keep(sample, "sample")
    n, k = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Model(-10.0, (), ((), ()))
    mean = (k + 0.5) / (n + 1)
    rates = ()
    for part in (suffix(F.col("host")), folder(F.col("path"))):
        own = sample.groupBy(part.alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("k")).where(F.col("n") >= support).orderBy("s").collect()
        rates = (*rates, tuple((r["s"], (r["k"] + 10 * mean) / (r["n"] + 10)) for r in own if r["s"] is not None))
    rows = with_features(sample, rates)
    edges = rows.select(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(edges[f] or ())) for f in FEATURES}
    bin_of = lambda f: reduce(lambda a, c: a + F.coalesce((F.col(f) > c).cast("int"), F.lit(0)), cuts[f], F.lit(0))
    binned = rows.select("y", *[bin_of(f).alias(f) for f in FEATURES]).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    binned = scratch.keep(binned, "binned")

    base = math.log(mean / (1 - mean))
    found: list[Split | float] = []
    for _ in range(trees):
        log_odds = reduce(lambda a, t: a + (t.column() if isinstance(t, Split) else F.lit(t)), found, F.lit(base))
        p = 1 / (1 + F.exp(-log_odds))
        graded = binned.select(*FEATURES, (F.col("k") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        splits: dict[int, tuple[int, int]] = {}  # node -> feature, bin; children of node i are 2 i and 2 i + 1
        leaf: dict[int, tuple[float, float]] = {}
        node: Column = F.lit(1)
        for level in range(depth + 1):
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("b")) for i, f in enumerate(FEATURES)])).alias("c")
            sums = graded.select(node.alias("node"), "g", "h", cells).groupBy("node", "c.f", "c.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for i in {r["node"] for r in sums}:
                own = {(r["f"], r["b"]): (r["g"], r["h"]) for r in sums if r["node"] == i}
                leaf[i] = (sum(g for (f, _), (g, _) in own.items() if f == 0), sum(h for (f, _), (_, h) in own.items() if f == 0))
                if level < depth and (best := _best_split(own, len(FEATURES), ridge)):
                    splits[i] = best[1:]
            if level == depth or not any(i >> level == 1 for i in splits):
                break
            node = reduce(lambda a, s: F.when((node == s[0]) & (F.col(FEATURES[s[1][0]]) <= s[1][1]), 2 * s[0]).when(node == s[0], 2 * s[0] + 1).otherwise(a), [(i, s) for i, s in splits.items() if i >> level == 1], F.lit(0))
            graded = graded.where(node > 0)

        def grown(i: int, raw: bool) -> Split | float:
            if i not in splits:
                g, h = leaf.get(i, (0.0, 0.0))
                return round(rate * g / (h + ridge), 9)
            f, b = splits[i]
            name = FEATURES[f]
            at = (cuts[name][b] if b < len(cuts[name]) else math.inf) if raw else float(b)
            low, high = (leaf.get(c, (0.0, 0.0))[1] for c in (2 * i, 2 * i + 1))
            return Split(name, at, grown(2 * i, raw), grown(2 * i + 1, raw), round(low / (low + high), 6) if low + high else 0.5)

        found.append(grown(1, raw=False))
    to_raw = lambda t: t if not isinstance(t, Split) else Split(t.feature, cuts[t.feature][int(t.at_most)] if int(t.at_most) < len(cuts[t.feature]) else math.inf, to_raw(t.low), to_raw(t.high), t.share)
    return Model(base, tuple(to_raw(t) for t in found), rates)


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", fit_rows: int = 20_000) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, and the model's probability of "block"."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).select("*", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("verdict"))
    model = fit(rows.where("rule is not null"), fit_rows=fit_rows)
    scored = with_features(rows, model.rates).select("page_id", "host", "path", "rule", "verdict", (1 / (1 + F.exp(-model.log_odds()))).alias("block_probability"))
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", own))
