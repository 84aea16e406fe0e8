"""URL filters: rules, and gradient-boosted trees on lexical features for what no rule decides.

Rules name a host and a path; they fit the host and its subdomains where the url's path starts with
theirs, and the longest wins.  They are compiled into one expression.  The trees are trained here, by
logistic loss on quantile bins, from labelled urls; features are lengths, depth, digit ratio, entropy,
parameter counts and suffix statistics (how often other urls of a host suffix were labelled block, smoothed).
``held_out`` measures a model on urls that it was not trained on.
``train`` takes at most ``SAMPLE`` labelled rows, those of the smallest hashes, so the fit is bounded
and repeatable; scoring reads every row and shuffles none.

Where no labels are given, pages label their own urls: a page whose text the quality rules reject is one to
block, whatever the url rules say of it.  These labels know nothing of the rules, so suffix statistics are used, each url's
from other folds, and the trees decide every url that no rule decides.

Where pages have no html either, the urls that rules decide are the labelled ones.  Every host and path among
them is one a rule names, so suffix statistics would only repeat the rules and are left out.  Each rule's
urls are judged by trees of the other rules; only where that beats the others' share of block, on the mean
over rules, is there evidence beyond the rules themselves.  Without it the model allows.

Defined results: a null url, or one without ``://``, has an empty host and path; rows that repeat are
judged alike; with labels of one class, or none, the model gives that class (allow with none); an
empty table gives an empty result; of other columns only ``html`` is read, null as empty.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import quality_rules
from foliant.llm.text import ascii_lower
from foliant.session import ship

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 40, 3, 0.2, 32, 20, 1.0
PRIOR = 5.0
#: Parts of the labelled urls, each described by the statistics of the others.
FOLDS = 5

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.when(rest.isNotNull(), F.substring(url, F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, as ``host/path``, and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    parts = host.split(".")
    return parts[-1], ".".join(parts[-2:])


FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_entropy", "path_entropy", "params", "query_length", "hyphens", "has_fragment", "suffix1_rate", "suffix2_rate", "suffix2_seen")


def lexical(url: str, host: str, path: str, stats: dict[str, tuple[int, int]], prior: float) -> list[float]:
    """The features of a url, with statistics of suffixes that must not hold its own label."""
    query = url.partition("#")[0].partition("?")[2]
    one, two = suffixes(host)
    rate = lambda s: (stats.get(s, (0, 0))[0] + PRIOR * prior) / (stats.get(s, (0, 0))[1] + PRIOR)
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / max(1, len(url)), _entropy(host), _entropy(path),
        query.count("=") , len(query), host.count("-"), float("#" in url), rate(one), rate(two), math.log1p(stats.get(two, (0, 0))[1]),
    ]


@dataclass
class Tree:
    """A complete tree: split features and thresholds by level, leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        inner = len(self.feature)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.threshold[at])
        return self.value[at - inner]


@dataclass
class UrlModel:
    stats: dict[str, tuple[int, int]] = field(default_factory=dict)
    prior: float = 0.0
    base: float = -20.0
    trees: list[Tree] = field(default_factory=list)

    def score(self, urls, hosts, paths) -> np.ndarray:
        """The probability of block."""
        x = np.array([lexical(u or "", h, p, self.stats, self.prior) for u, h, p in zip(urls, hosts, paths, strict=True)], float).reshape(-1, len(FEATURES))
        raw = np.full(len(x), self.base)
        for tree in self.trees:
            raw += RATE * tree.predict(x)
        return 1 / (1 + np.exp(-raw))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    inner = (1 << DEPTH) - 1
    feature, threshold, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(1 << DEPTH)
    node = np.zeros(len(bins), int)
    for at in range(inner):
        rows = np.flatnonzero(node == at)
        best = (1e-6, 0, np.inf, 0)
        g, h = gradient[rows].sum(), hessian[rows].sum()
        for f in range(bins.shape[1]) if len(rows) >= 2 * LEAST_LEAF else ():
            count = np.bincount(bins[rows, f], minlength=BINS + 1)
            gl, hl, nl = (np.cumsum(np.bincount(bins[rows, f], w, BINS + 1)) for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
            gain[(nl < LEAST_LEAF) | (count.sum() - nl < LEAST_LEAF)] = 0
            k = int(gain[: len(cuts[f])].argmax()) if len(cuts[f]) else 0
            if len(cuts[f]) and gain[k] > best[0]:
                best = (gain[k], f, cuts[f][k], k)
        feature[at], threshold[at] = best[1], best[2]
        node[rows] = 2 * at + 1 + (bins[rows, best[1]] > best[3] if np.isfinite(best[2]) else np.zeros(len(rows), int))
    for leaf in range(1 << DEPTH):
        rows = node == inner + leaf
        value[leaf] = -gradient[rows].sum() / (hessian[rows].sum() + RIDGE)
    return Tree(feature, threshold, value)


def suffix_statistics(hosts: list[str], block: np.ndarray) -> dict[str, tuple[int, int]]:
    """Of each suffix how many urls are to be blocked, and how many there are."""
    stats: dict[str, tuple[int, int]] = {}
    for host, y in zip(hosts, block.tolist(), strict=True):
        for s in set(suffixes(host)):
            a, b = stats.get(s, (0, 0))
            stats[s] = (a + int(y), b + 1)
    return stats


def fit(urls: list[str], hosts: list[str], paths: list[str], block: np.ndarray, suffix_stats: bool = True) -> UrlModel:
    """Trees from labelled urls; ``block`` is 1 for urls to block.  Without ``suffix_stats`` every suffix counts as unseen.

    A url is trained with the suffix statistics of the other folds: its own label is not among them, and its absence tells nothing.
    """
    if not len(urls):
        return UrlModel()
    prior = float(block.mean())
    if prior in (0.0, 1.0):
        return UrlModel(prior=prior, base=40 * prior - 20)
    folds = [zlib.crc32(u.encode("utf-8", "surrogatepass")) % FOLDS for u in urls]  # a url that repeats is in one fold
    stats = suffix_statistics(hosts, block) if suffix_stats else {}
    apart = [suffix_statistics([h for h, f in zip(hosts, folds, strict=True) if f != k], block[[f != k for f in folds]]) if suffix_stats else {} for k in range(FOLDS)]
    model = UrlModel(stats, prior, math.log(prior / (1 - prior)))
    x = np.array([lexical(u, h, p, apart[f], prior) for u, h, p, f in zip(urls, hosts, paths, folds, strict=True)], float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(bins, cuts, p - block, p * (1 - p))
        model.trees.append(tree)
        raw += RATE * tree.predict(x)
    return model


def _labels(labelled: DataFrame) -> DataFrame:
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("url", "host", "path")]
    return labelled.select(*texts, F.col("block").cast("int").alias("block")).filter("block IS NOT NULL")


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """A model from (url, host, path, block), of at most ``sample`` rows: those with the smallest hashes, ties by url, host, path
    and label.  Null urls, hosts and paths are empty; rows without a label teach nothing."""
    rows = _labels(labelled).withColumn("h", F.xxhash64("url")).orderBy("h", "url", "host", "path", "block").limit(sample).collect()
    return fit([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], np.array([r.block for r in rows], float))


def held_out(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """How a model of four fifths of the labelled urls, by their hash, judges the fifth it has not seen: accuracy, that of
    the more frequent verdict, log loss, and the number judged."""
    labelled = _labels(labelled)
    part = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(5))
    model = train(labelled.filter(part != 0), sample)
    rows = labelled.filter(part == 0).withColumn("h", F.xxhash64("url")).orderBy("h", "url", "host", "path", "block").limit(sample).collect()
    block = np.array([float(r.block) for r in rows])
    if not len(block):
        return {"accuracy": math.nan, "base": math.nan, "log_loss": math.nan, "judged": 0}
    p = model.score([r.url for r in rows], [r.host for r in rows], [r.path for r in rows])
    return {"accuracy": float(np.mean((p >= 0.5) == block)), "base": max(block.mean(), 1 - block.mean()), "log_loss": _log_loss(p, block), "judged": len(block)}


def _log_loss(p: np.ndarray, block: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.mean(block * np.log(p) + (1 - block) * np.log(1 - p)))


def fit_rules(urls: list[str], hosts: list[str], paths: list[str], block: np.ndarray, rules: list[str]) -> UrlModel:
    """Trees from urls that ``rules`` decided, if trees of the other rules foretell each rule's verdicts; else a model that allows."""
    own, table = np.array(rules, object), list(zip(urls, hosts, paths, strict=True))
    trees, share = [], []
    for rule in sorted(set(rules)):
        out, rest = np.flatnonzero(own == rule), np.flatnonzero(own != rule)
        if not len(rest):
            return UrlModel()
        model = fit(*map(list, zip(*(table[k] for k in rest), strict=True)), block[rest], suffix_stats=False)
        trees.append(_log_loss(model.score(*zip(*(table[k] for k in out), strict=True)), block[out]))
        share.append(_log_loss(np.full(len(out), block[rest].mean()), block[out]))
    return fit(urls, hosts, paths, block, suffix_stats=False) if trees and np.mean(trees) < np.mean(share) else UrlModel()


def train_on_rules(ruled_rows: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """As ``train``, of (url, host, path, rule, said) that rules decided."""
    rows = ruled_rows.withColumn("h", F.xxhash64("url")).orderBy("h", "url").limit(sample).collect()
    return fit_rules([r.url or "" for r in rows], [r.host for r in rows], [r.path for r in rows], np.array([r.said == "block" for r in rows], float), [r.rule for r in rows])


def page_text(html: Column) -> Column:
    """What a page says: its html without scripts, styles, comments and markup."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "\n")
    return F.regexp_replace(body, r"<[^>]*>", "\n")


def labelled_by_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """url, host, path, block of (url, host, path, html): 1 where the quality rules reject the page's text.

    Of more pages than ``sample``, texts are read of those with the smallest hashes only, a fifth more than ``train`` takes."""
    n = pages.count()
    if n > sample:
        pages = pages.filter(F.xxhash64(F.coalesce("url", F.lit(""))) <= int(-(2**63) + min(1.0, 1.2 * sample / n) * (2**64 - 1024)))
    docs = pages.select("url", "host", "path", page_text(F.col("html")).alias("text"))
    return quality_rules.judged(docs, quality_rules.RULES, ["url", "host", "path"]).select("row.*", (~F.col("kept")).cast("int").alias("block"))


def probability(url: Column, host: Column, path: Column, model: UrlModel) -> Column:
    @F.arrow_udf("double")
    def run(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(model.score(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist()), pa.float64())

    return run(F.coalesce(url, F.lit("")), host, path)


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability for every row."""
    ship(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    if labelled is None and "html" in pages.columns:
        labelled = labelled_by_pages(pages.select("url", host.alias("host"), path.alias("path"), "html"))
    model = train(labelled) if labelled is not None else train_on_rules(rows.filter("said IS NOT NULL").select("url", "host", "path", "rule", "said"))
    scored = rows.withColumn("block_probability", probability(F.col("url"), F.col("host"), F.col("path"), model))
    verdict = F.coalesce("said", F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")
