"""Vector retrieval: vocabulary and TF-IDF, latent semantic vectors, exact cosine search, hybrid fusion, evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import vocab
from foliant.operators import lexical, ranking
from foliant.session import ship
from foliant.sources.shared import new_folder

WORD = r"(?i)[a-z][a-z'-]{1,}"
#: Queries broadcast at once; queries and rows whose cosines a task makes at once.
BLOCK, TILE = 4096, 512
#: Subspace iteration: dimensions beyond those asked for, passes; rows of a partial sum that travel together, cells handled at once, lanes of tasks.
SPARE, PASSES, ROWS, CELLS, LANES = 16, 4, 256, 40_000, 64
#: Cells a row from which rows are multiplied as dense ones.
DENSE = 40


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, c, most: counts of a document's terms and of its most frequent one.

    Where keys don't repeat, a document is counted where it is read and nothing is shuffled."""
    words = _words(docs, key, text)
    if not lexical.keyed(docs, key):
        each = words.select(key, F.explode("words").alias("term"))
        counts = each.groupBy(key, "term").agg(F.count("*").alias("c"))
        return counts.withColumn("most", F.max("c").over(Window.partitionBy(key)))
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, _, row, code, tf, names in lexical.counted(batch["words"]):
                most = np.zeros(row.max(initial=0) + 1, np.int64)
                np.maximum.at(most, row, tf)
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(lo + row)), names.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(most[row])], names=[key, "term", "c", "most"])

    return words.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, term string, c bigint, most bigint")


def vocabulary(counted: DataFrame, n_docs: int, cap: int = vocab.VOCABULARY) -> DataFrame:
    """term, df, idf of the ``cap`` most frequent terms within the bounds of document frequency."""
    return _frequent(counted.groupBy("term").agg(F.count("*").alias("df")), n_docs, cap)


def _frequent(held: DataFrame, n_docs: int, cap: int) -> DataFrame:
    df = held.filter((F.col("df") >= vocab.MIN_DF) & (F.col("df") <= vocab.MAX_DF * n_docs))
    return df.orderBy(F.desc("df"), "term").limit(cap).withColumn("idf", F.ln(F.lit(float(n_docs)) / (1 + F.col("df"))) + 1)


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents' words; texts are dealt first, since a file of few row groups would be cut by as few tasks."""
    return docs.select(key, text).repartition(key).select(key, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), 0).alias("words"))


def frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df of documents with a key each: a piece of documents sends a row a term."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for *_, code, _, names in lexical.counted(batch["words"]):
                df = np.bincount(code, minlength=len(names))
                at = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(df[at], pa.int64())], names=["term", "df"])

    return _words(docs, key, text).mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def weighted(docs: DataFrame, key: str, text: str, terms: list[str], idf: np.ndarray) -> DataFrame:
    """As ``cells``, of documents with a key each: rows are made where texts are read, and nothing is shuffled."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((terms, idf))
    kind = dict(docs.dtypes)[key]

    def run(batches):
        wanted, idf = pa.array(shipped.value[0], pa.string()), shipped.value[1]
        for batch in batches:
            for lo, hi, row, code, tf, names in lexical.counted(batch["words"]):
                most = np.zeros(hi - lo, np.int64)
                np.maximum.at(most, row, tf)
                place = pa.compute.index_in(names, wanted).fill_null(-1).to_numpy(zero_copy_only=False)
                at = place[code] if len(place) else code
                row, i, tf = row[at >= 0], at[at >= 0], tf[at >= 0]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                if len(first):
                    cell = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array((0.5 + 0.5 * tf / most[row]) * idf[i])], names=["i", "weight"])
                    yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(lo + row[first])), pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), cell)], names=[key, "w"])

    return _words(docs, key, text).mapInArrow(run, f"{key} {kind}, w array<struct<i:int,weight:double>>")


def tfidf(counted: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, term, weight: augmented frequency times idf."""
    return counted.join(F.broadcast(words), "term").select(key, "term", ((0.5 + 0.5 * F.col("c") / F.col("most")) * F.col("idf")).alias("weight"))


def cells(weights: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, w: a document's TF-IDF row, sparse, with columns numbered by the vocabulary's order."""
    at = words.select("term", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("i"))  # at most the vocabulary's cap of rows
    return weights.join(F.broadcast(at), "term").groupBy(key).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("weight").cast("double").alias("weight"))).alias("w"))


def _sparse(column: pa.Array):
    """Pieces of a batch's rows: row numbers, columns and weights of their cells, ``CELLS`` or one row at a time."""
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy())
    flat = column.flatten()
    i, w = flat.field("i").to_numpy(), flat.field("weight").to_numpy()
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    lo = 0
    while lo < len(ends):
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + CELLS, "right")))
        yield lo, hi, row[start : ends[hi - 1]] - lo, i[start : ends[hi - 1]], w[start : ends[hi - 1]]
        lo = hi


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by number."""
    out = np.zeros((n, rows.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
        out[at[order][first]] = np.add.reduceat(rows[order], first)
    return out


def _dense(row: np.ndarray, i: np.ndarray, w: np.ndarray, rows: int, wide: int) -> np.ndarray:
    out = np.zeros((rows, wide), np.float32)
    out[row, i] = w
    return out


def _times(q: np.ndarray, row: np.ndarray, i: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """Sparse rows times Q: as a dense product where rows have many cells, which costs less than gathering Q's rows."""
    if len(i) >= DENSE * rows:
        return (_dense(row, i, w, rows, len(q)) @ q.astype(np.float32)).astype(np.float64)
    return _added(row, w[:, None] * q[i], rows)


def gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'(A Q): each task sends a matrix of the basis' size, vocabulary by dimensions, however many documents it read.

    Matrices are cut into parts and added up in two levels, first in ``LANES`` lanes of tasks, so no group holds those of all tasks."""
    shipped = rows.sparkSession.sparkContext.broadcast(basis)
    size, wide = basis.shape

    def run(batches):
        from pyspark import TaskContext

        q, short = shipped.value, shipped.value.astype(np.float32)
        total = np.zeros(q.shape)
        for batch in batches:
            for lo, hi, row, i, w in _sparse(batch["w"]):
                if len(i) >= DENSE * (hi - lo):
                    x = _dense(row, i, w, hi - lo, len(q))
                    total += x.T @ (x @ short)
                else:
                    total += _added(i, w[:, None] * _times(q, row, i, w, hi - lo)[row], len(q))
        if total.any():
            parts = [total[k : k + ROWS] for k in range(0, len(total), ROWS)]
            lane = np.full(len(parts), TaskContext.get().partitionId() % LANES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(lane), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "lane", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["data"].iloc[0]) // 8)
        for x in pdf["data"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "data": [total.tobytes()]})

    out = np.zeros((size, wide))
    sent = rows.select("w").mapInArrow(run, "part bigint, lane bigint, data binary").groupBy("part", "lane").applyInPandas(add, "part bigint, data binary")
    for part, data in sent.groupBy("part").applyInPandas(add, "part bigint, data binary").collect():  # a vocabulary by dimensions
        out[part * ROWS : part * ROWS + ROWS] = np.frombuffer(data).reshape(-1, wide)
    shipped.unpersist()
    return out


def components(rows: DataFrame, size: int, k: int) -> np.ndarray:
    """The ``k`` right singular vectors of the largest singular values, by subspace iteration from a seeded start."""
    wide = min(size, k + SPARE)
    basis = np.eye(size) if wide == size else np.linalg.qr(np.random.default_rng(7).standard_normal((size, wide)))[0]
    for _ in range(0 if wide == size else PASSES):
        basis = np.linalg.qr(gram_times(rows, basis))[0]
    small = basis.T @ gram_times(rows, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    parts = basis @ vectors[:, np.argsort(values)[::-1][:k]]
    return parts * np.sign(parts[np.abs(parts).argmax(0), np.arange(k)])


def lsa(docs: DataFrame, key: str, text: str, dimensions: int = vocab.LSA_DIMENSIONS, cap: int = vocab.VOCABULARY) -> tuple[DataFrame, dict[str, int], np.ndarray, np.ndarray]:
    """Unit vectors (key, embedding), the vocabulary, its idf and the components: right singular vectors of the TF-IDF matrix."""
    ship(docs.sparkSession)
    alone, n = lexical.keyed(docs, key), docs.count()
    counted = None if alone else terms(docs, key, text)
    words = _frequent(frequencies(docs, key, text), n, cap) if alone else vocabulary(counted, n, cap)
    held = words.orderBy(F.desc("df"), "term").collect()  # at most ``cap`` rows
    index = {r.term: k for k, r in enumerate(held)}
    idf = np.array([r.idf for r in held])
    if not index:
        return docs.select(key, F.array().cast("array<float>").alias("embedding")), index, idf, np.zeros((0, 0))
    if alone:
        made = weighted(docs, key, text, list(index), idf)
    else:
        fixed = docs.sparkSession.createDataFrame([(r.term, r.df, r.idf) for r in held], "term string, df bigint, idf double")
        made = cells(tfidf(counted, fixed.select("term", "idf"), key), fixed, key)
    # read once a pass, and by the projection whenever its result is
    path = new_folder(docs.sparkSession, "latent")
    made.write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    parts = components(rows, len(index), max(1, min(dimensions, len(index) - 1, n - 1)))
    shipped = docs.sparkSession.sparkContext.broadcast(parts)

    def project(batches):
        q = shipped.value
        for batch in batches:
            out = np.zeros((len(batch), q.shape[1]))
            for lo, hi, row, i, w in _sparse(batch["w"]):
                out[lo:hi] = _times(q, row, i, w, hi - lo)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch[key], flat], names=[key, "embedding"])

    return rows.mapInArrow(project, f"{key} {dict(docs.dtypes)[key]}, embedding array<float>"), index, idf, parts


def fold_in(docs: DataFrame, key: str, text: str, space: DataFrame) -> DataFrame:
    """Rows placed in a space (term, idf, component) that others made: key, embedding, energy (the squared length of the row, terms that the
    vocabulary lacks counted at its mean weight) and captured (that of its projection).  Each row is handled where it is read.

    The space is broadcast: a vocabulary's cap of rows."""
    import re
    from collections import Counter

    held = space.orderBy("term").collect()
    index, parts = {r.term: k for k, r in enumerate(held)}, np.array([r.component for r in held], np.float64)
    idf = np.array([r.idf for r in held])
    wide = parts.shape[1] if len(held) else 0
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((index, idf, parts))
    kind = dict(docs.dtypes)[key]

    def run(batches):
        index, idf, parts = shipped.value
        usual = float(idf.mean()) if len(idf) else 1.0
        for batch in batches:
            out, energy = np.zeros((len(batch), wide)), np.zeros(len(batch))
            for row, value in enumerate(batch[text]):
                counts = Counter(re.findall(WORD, (value.as_py() or "").lower()))
                most = max(counts.values(), default=1)
                at = np.array([index.get(t, -1) for t in counts], np.int64)
                share = 0.5 + 0.5 * np.array(list(counts.values()), np.float64) / most
                known = at >= 0
                weight = np.where(known, idf[at] if len(idf) else usual, usual) * share
                energy[row] = float((weight**2).sum())
                if known.any():
                    out[row] = weight[known] @ parts[at[known]]
            length = np.linalg.norm(out, axis=1) if wide else np.zeros(len(batch))
            unit = np.divide(out, length[:, None], out=np.zeros_like(out), where=length[:, None] > 0).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * wide), pa.array(unit.reshape(-1), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch[key], flat, pa.array(energy), pa.array(length**2)], names=[key, "embedding", "energy", "captured"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>, energy double, captured double")


def embed(texts: list[str], index: dict[str, int], idf: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Query vectors in the space of ``lsa``."""
    import re
    from collections import Counter

    out = np.zeros((len(texts), parts.shape[1]))
    for row, text in enumerate(texts):
        counts = Counter(re.findall(WORD, text.lower()))
        for term, c in counts.items():
            if term in index:
                out[row] += (0.5 + 0.5 * c / max(counts.values())) * idf[index[term]] * parts[index[term]]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return np.divide(x, (w := np.linalg.norm(x, axis=1, keepdims=True)), out=np.zeros_like(x), where=w > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    sizes = np.unique(pa.compute.list_value_length(column).to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes.tolist()} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _better(best: np.ndarray, names: np.ndarray, asked: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
    """Merges rows ``x`` (keys ``own``) into the k best of each query, in place: by rounded cosine, ties by key.

    Cosines are made a tile at a time; only those that may reach a query's k-th go on."""
    for lo in range(0, len(asked), TILE):
        score = asked[lo : lo + TILE] @ x.T
        at, row = np.nonzero(score >= best[lo : lo + TILE, -1:] - 1e-8)
        ranking.merge(best, names, lo + at, score[at, row], own[row])


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, key, cosine: exact search of a stated set of queries (query_id, embedding) against all rows.

    Queries are broadcast in blocks of ``BLOCK``; a task keeps its k best per query, so what is
    shuffled is bounded by tasks * queries * k, and makes cosines in tiles of ``TILE`` by ``TILE``, so its memory is
    that of a block, however many rows and queries there are.  Vectors of another length than a query raise.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)[key]
    total = queries.count()
    n = -(-total // BLOCK)
    schema = f"query_id bigint, {key} {kind}, cosine double"
    out = spark.createDataFrame([], schema)
    for b in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).select("query_id", "embedding").toArrow().combine_chunks()
        if not len(rows):
            continue
        ids, asked = rows["query_id"].to_numpy().astype(np.int64), _unit(_matrix(pa.concat_arrays(rows["embedding"].chunks)))
        shipped = spark.sparkContext.broadcast((ids, asked))

        def run(batches, shipped=shipped):
            ids, asked = shipped.value
            best, names = np.full((len(ids), k), -np.inf), None
            for batch in batches:
                for lo in range(0, len(batch), TILE):
                    piece = batch.slice(lo, TILE)
                    x, own = _unit(_matrix(piece["embedding"])), piece[key].to_numpy(zero_copy_only=False)
                    if x.shape[1] != asked.shape[1]:
                        raise ValueError(f"vectors of {x.shape[1]} dimensions, queries of {asked.shape[1]}")
                    names = np.zeros((len(ids), k), own.dtype) if names is None else names
                    _better(best, names, asked, x, own)
            if names is not None:
                held = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[held]), pa.array(names[held]), pa.array(best[held])], names=["query_id", key, "cosine"])

        out = out.unionByName(vectors.filter(F.col("embedding").isNotNull()).select(key, "embedding").mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), key)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidates(lexical: DataFrame, vector: DataFrame, traits: DataFrame, key: str) -> DataFrame:
    """query_id, key and the parts of a score: a full outer join of two short lists, plus (key, reliability, entity_overlap)."""
    lex = lexical.select("query_id", key, F.col("norm").alias("bm25"))
    vec = vector.select("query_id", key, F.greatest("cosine", F.lit(0.0)).alias("vector"))
    return lex.join(vec, ["query_id", key], "full_outer").join(traits, key, "left")


def _score(weights) -> Column:
    part = lambda c: weights[c] * F.coalesce(c, F.lit(0.0))
    return part("bm25") + part("vector") + weights["entity"] * F.coalesce("entity_overlap", F.lit(0.0)) + part("reliability")


def blended(parts: DataFrame, key: str, weights: dict[str, float] = vocab.FUSION) -> DataFrame:
    """query_id, key, score, channels of candidates with reliability and entity_overlap."""
    channels = F.concat_ws("+", F.when(F.col("bm25").isNotNull(), "keyword"), F.when(F.col("vector").isNotNull(), "vector"))
    return parts.select("query_id", key, "bm25", "vector", _score(weights).alias("score"), channels.alias("channels"))


def fused(lexical: DataFrame, vector: DataFrame, traits: DataFrame, key: str, weights: dict[str, float] = vocab.FUSION) -> DataFrame:
    """query_id, key, score, channels of ``candidates``."""
    return blended(candidates(lexical, vector, traits, key), key, weights)


def swept(parts: DataFrame, grid: list[dict[str, float]], key: str, k: int) -> DataFrame:
    """bm25, vector, query_id, key, rank: the ``k`` best of each query at each pair of weights, of one set of candidates."""
    scores = F.array(*[F.struct(F.lit(w["bm25"]).alias("wb"), F.lit(w["vector"]).alias("wv"), F.round(_score(vocab.FUSION | w), 6).alias("score")) for w in grid])
    each = parts.select("query_id", key, F.explode(scores).alias("s")).select("s.*", "query_id", key)
    order = Window.partitionBy("wb", "wv", "query_id").orderBy(F.desc("score"), key)
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("wb").alias("bm25"), F.col("wv").alias("vector"), "query_id", key, "rank")


def swept_recall(ranked: DataFrame, expected: DataFrame, ks: list[int], key: str, grid: list[dict[str, float]]) -> DataFrame:
    """bm25, vector, k, recall: the share of expected queries that are met among the first k, at each pair of weights."""
    asked = expected.select("query_id").distinct()
    weights = F.explode(F.array(*[F.struct(F.lit(w["bm25"]).alias("bm25"), F.lit(w["vector"]).alias("vector")) for w in grid]))
    hits = ranked.join(expected, ["query_id", key], "left_semi").groupBy("bm25", "vector", "query_id").agg(F.min("rank").alias("first"))
    met = asked.select("query_id", weights.alias("w")).select("query_id", "w.*").join(hits, ["bm25", "vector", "query_id"], "left")
    shares = met.groupBy("bm25", "vector").agg(*[F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")).alias(f"r{k}") for k in ks])
    return shares.select("bm25", "vector", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])).alias("x")).select("bm25", "vector", "x.*")


def entity_overlap(content, names: list[str]):
    """The share of the named entities that a text mentions."""
    if not names:
        return F.lit(0.0)
    low = F.lower(content)
    return sum((F.contains(low, F.lit(n.lower())).cast("int") for n in names), F.lit(0)) / len(names)


def recall_at(ranked: DataFrame, expected: DataFrame, ks: list[int], key: str, asked: DataFrame | None = None) -> DataFrame:
    """k, recall: the share of queries, those ``asked`` or expected, with an expected (query_id, key) among their first k."""
    marked = ranked.join(expected.withColumn("ok", F.lit(1)), ["query_id", key], "left").withColumn("ok", F.col("ok").isNotNull())
    return recall_of(marked, ks, expected if asked is None else asked)


def recall_of(marked: DataFrame, ks: list[int], asked: DataFrame) -> DataFrame:
    """As ``recall_at``, of ranked rows (query_id, rank, ok) that say themselves whether they are expected."""
    hit = marked.groupBy("query_id").agg(*[F.max(F.when((F.col("rank") <= k) & F.col("ok"), 1).otherwise(0)).alias(f"r{k}") for k in ks])
    met = asked.select("query_id").distinct().join(hit, "query_id", "left").agg(*[F.avg(F.coalesce(f"r{k}", F.lit(0))).alias(f"r{k}") for k in ks])
    return met.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks])).alias("x")).select("x.*")
