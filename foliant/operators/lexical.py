"""Lexical retrieval: positional postings, BM25, pools, quality blend, AND and phrase queries."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import vocab
from foliant.operators import ranking
from foliant.session import ship

TOKEN = r"[\p{L}\p{N}_'-]+"
#: As ``TOKEN``, with marks that stand alone, which folding takes out.
MARKED = TOKEN.replace("_", "_\\u0300-\\u036F")
#: Asked terms that are matched inside the scan's own projection; more meet the tokens in a join.
TERMS = 10_000
#: Asked (query, term) pairs that are scored where texts are read; more meet the tokens in a join.
PAIRS = 100_000
#: Tokens, and scores, that a task handles at once.
PIECE = 1 << 18


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters without, by Unicode's own decomposition; then marks that stand alone, which go."""
    plain = {chr(c): x for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(x := "".join(y for y in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(y))) == 1 and x != chr(c)}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


ACCENTED, PLAIN = _folds()


def folded(text: Column) -> Column:
    """Lower-case, without diacritics; only texts beyond ASCII pay for it."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)


def tokens(text: Column) -> Column:
    """The tokens of the folded text; each is folded by itself, since few have letters beyond ASCII."""
    cut = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(MARKED), 0)
    plain = F.transform(cut, lambda t: F.when(F.octet_length(t) > F.length(t), F.translate(t, ACCENTED, PLAIN)).otherwise(t))
    return F.filter(plain, lambda t: F.length(t) > 1)


def keyed(rows: DataFrame, key: str) -> bool:
    """Whether every row has a key of its own."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).isEmpty()


def counted(lists: pa.Array, wanted: pa.Array | None = None, rows: int | None = None):
    """lo, hi, row, code, tf, names: counts of the words in the rows lo to hi of a column of lists (row - lo, ascending), ``PIECE`` words, ``rows`` rows or
    one row at a time.  Codes are places in ``names``: the words of the column, or those ``wanted``, others being left out."""
    flat = lists.flatten().dictionary_encode()
    ends = np.cumsum(np.asarray(lists.value_lengths()))
    names, code = flat.dictionary, flat.indices.to_numpy()
    if wanted is not None:
        at = pa.compute.index_in(names, wanted).fill_null(-1).to_numpy(zero_copy_only=False)
        names, code = wanted, at[code] if len(at) else code
    lo = 0
    while lo < len(ends):
        begin = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        hi = min(hi, lo + rows) if rows else hi
        own = code[begin : ends[hi - 1]]
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi], prepend=begin))
        held, tf = np.unique((row * (len(names) + 1) + own)[own >= 0], return_counts=True)
        yield lo, hi, held // (len(names) + 1), held % (len(names) + 1), tf, names
        lo = hi


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, positions."""
    each = chunks.select(key, F.posexplode(tokens(F.col(text))).alias("at", "term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


def lengths(chunks: DataFrame, key: str, text: str) -> DataFrame:
    return chunks.select(key, F.size(tokens(F.col(text))).cast("bigint").alias("len"))


def occurrences(chunks: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """key, len, term, tf of the wanted terms.  Few terms are matched where the text is read, so only hits leave the scan."""
    few = [r.term for r in wanted.limit(TERMS + 1).collect()]
    if len(few) <= TERMS:
        cut = lambda t: F.struct(F.size(t).cast("bigint").alias("len"), F.filter(t, lambda x: x.isin(few) if few else F.lit(False)).alias("found"))
        # a lambda variable holds the tokens, which would else be cut anew for each use
        each = chunks.select(key, F.transform(F.array(tokens(F.col(text))), cut)[0].alias("x")).filter(F.size("x.found") > 0).select(key, "x.len", F.explode("x.found").alias("term"))
        return each.groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    each = chunks.select(key, F.explode(tokens(F.col(text))).alias("term")).join(wanted, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"))
    return each.join(lengths(chunks, key, text), key)


def bm25(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "content", every: bool = False) -> DataFrame:
    """query_id, key, score for a frame of queries (query_id, term); repeated terms count again.

    ``every`` keeps chunks that have all terms of a query.  Up to ``PAIRS`` asked pairs are scored where the text is read, so only
    document frequencies are shuffled; more, and chunks whose keys repeat, meet the queries in joins.
    """
    pairs = few(queries)
    if pairs is not None and keyed(chunks, key):
        return _scored(chunks, pairs, key, text, every)
    hits = occurrences(chunks, queries.select("term").distinct(), key, text)
    whole = lengths(chunks, key, text).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    met = hits.join(df, "term").join(F.broadcast(whole)).join(asked, "term")
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (vocab.BM25_K1 + 1) / (F.col("tf") + vocab.BM25_K1 * (1 - vocab.BM25_B + vocab.BM25_B * F.col("len") / F.col("avg_len")))
    scored = met.groupBy("query_id", key).agg(F.sum(F.col("times") * part).alias("score"), F.count("*").alias("matched"))
    if every:
        scored = scored.join(asked.groupBy("query_id").agg(F.count("*").alias("terms")), "query_id").filter("matched = terms").drop("terms")
    return scored.drop("matched")


def few(queries: DataFrame) -> list | None:
    """query_id, term, times of queries, if they are few."""
    asked = queries.filter("term IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id", "term").agg(F.count("*").alias("times")).limit(PAIRS + 1).collect()
    return asked if len(asked) <= PAIRS else None


class Asked(NamedTuple):
    """Queries as arrays: their ids, and for each term, by number, the queries that ask it with its weight there."""

    ids: np.ndarray
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    def summed(self, row: np.ndarray, code: np.ndarray, part: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """query, row, score (above 0) and asked terms met, by query, of ``rows`` rows whose terms ``code`` give ``part``."""
        many = np.diff(self.start)[code]
        pair = np.repeat(self.start[code] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = self.query[pair] * rows + np.repeat(row, many)
        score = np.bincount(cell, self.weight[pair] * np.repeat(part, many), len(self.ids) * rows)
        at = np.flatnonzero(score > 0)
        return at // rows, at % rows, score[at], np.bincount(cell, minlength=len(score))[at]


def asked(pairs: list[tuple[int, int, float]], terms: int) -> Asked:
    """Of (term number, query_id, weight)."""
    pairs = sorted(pairs)
    term, query = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    ids = np.unique(query)
    return Asked(ids, np.searchsorted(term, np.arange(terms + 1)), np.searchsorted(ids, query), np.array([p[2] for p in pairs], np.float64))


def _frequencies(words: DataFrame, wanted: pa.Array) -> tuple[int, int, np.ndarray]:
    """Chunks, tokens and the chunks that hold each of the wanted terms."""

    def run(batches):
        n, total, df = 0, 0, np.zeros(len(wanted), np.int64)
        for batch in batches:
            n, total = n + len(batch), total + len(batch["words"].flatten())
            for *_, code, _, _ in counted(batch["words"], wanted):
                df += np.bincount(code, minlength=len(wanted))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], at)), pa.array(np.append([n, total], df[at]))], names=["at", "c"])

    sums = {r["at"]: r["c"] for r in words.select("words").mapInArrow(run, "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c")).collect()}  # a row a wanted term
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(k, 0) for k in range(len(wanted))], np.int64)


def _scored(chunks: DataFrame, few: list, key: str, text: str, every: bool = False, limit: int | None = None) -> DataFrame:
    """As ``bm25``, of few queries; with ``limit`` no more than a task's best of each query, by rounded score, ties by key."""
    ship(chunks.sparkSession)
    kind = dict(chunks.dtypes)[key]
    wanted = pa.array(sorted({r.term for r in few}), pa.string())
    place = {t: k for k, t in enumerate(wanted.to_pylist())}
    words = chunks.select(key, tokens(F.col(text)).alias("words"))
    n, total, df = _frequencies(words, wanted)
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    own = asked([(place[r.term], r.query_id, idf[place[r.term]] * r.times) for r in few], len(wanted))
    shipped = chunks.sparkSession.sparkContext.broadcast((wanted, own, np.bincount(own.query, minlength=len(own.ids)), total / max(1, n)))
    piece = PIECE

    def run(batches):
        wanted, asked, terms, mean = shipped.value
        ids, k1, b, best, names = asked.ids, vocab.BM25_K1, vocab.BM25_B, None, None
        for batch in batches:
            length = np.asarray(batch["words"].value_lengths())
            own = batch[key].to_numpy(zero_copy_only=False) if limit else batch[key]
            for lo, hi, row, code, tf, _ in counted(batch["words"], wanted, max(1, piece // max(1, len(ids)))):
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[lo + row] / mean))
                of, row, score, met = asked.summed(row, code, part, hi - lo)
                row = lo + row
                if every:
                    of, row, score = (x[met == terms[of]] for x in (of, row, score))
                if not limit:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of]), own.take(pa.array(row)), pa.array(score, pa.float64())], names=["query_id", key, "score"])
                    continue
                best, names = ranking.start(len(ids), limit, own.dtype) if best is None else (best, names)
                near = score >= best[of, -1] - 1e-8
                ranking.merge(best, names, of[near], score[near], own[row][near])
        if best is not None:
            held = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[held]), pa.array(names[held]), pa.array(best[held])], names=["query_id", key, "score"])

    return words.mapInArrow(run, f"query_id bigint, {key} {kind}, score double")


def best(chunks: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """As ``top`` of ``bm25``: a task sends its best only, where queries are few and keys don't repeat."""
    pairs = few(queries)
    here = pairs is not None and keyed(chunks, key)
    return top(_scored(chunks, pairs, key, text, limit=limit) if here else bm25(chunks, queries, key, text), limit, key)


def top(scored: DataFrame, limit: int, key: str = "chunk_id", by: str = "score") -> DataFrame:
    """The best ``limit`` per query: a bounded window that Spark limits before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def normalised(pool: DataFrame) -> DataFrame:
    """Scores of a pool scaled so that the best is 1 and the worst, or a single one, 0."""
    whole = Window.partitionBy("query_id")
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    return pool.withColumn("norm", F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(0.0)))


def reranked(pool: DataFrame, quality: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """A pool of 3 * limit blended with reliability (key, reliability), cut to ``limit``."""
    blend = normalised(pool).join(quality, key).withColumn("blend", vocab.KEYWORD_SHARE * F.col("norm") + vocab.QUALITY_SHARE * F.col("reliability"))
    return top(blend.drop("rank"), limit, key, "blend")


def phrase(chunks: DataFrame, terms: list[str], key: str = "chunk_id", text: str = "content") -> DataFrame:
    """key, hits: where the terms stand side by side."""

    def hits(t: Column) -> Column:
        same = lambda x, i: F.reduce(F.array(*[F.get(t, i + k) == F.lit(w) for k, w in enumerate(terms)]), x == terms[0], lambda a, b: a & F.coalesce(b, F.lit(False)))
        return F.size(F.filter(t, same)).cast("bigint")

    # a lambda variable holds the tokens, which would else be cut anew for each of them
    once = F.transform(F.array(tokens(F.col(text))), hits)[0]
    return chunks.filter(F.contains(folded(F.coalesce(F.col(text), F.lit(""))), F.lit(terms[0]))).select(key, once.alias("hits")).filter("hits > 0")


def query_terms(text: str) -> tuple[list[str], list[list[str]]]:
    """The terms of a question as the tokeniser would cut them, and its phrases: hyphenated words, part by part."""
    low = unicodedata.normalize("NFD", text.lower())
    found = [t for t in re.findall(r"[\w'-]+", "".join(c for c in low if not unicodedata.combining(c))) if len(t) > 1]
    phrases = [[x for x in t.split("-") if x] for t in found if "-" in t.strip("-")]
    return list(dict.fromkeys(found)), phrases
