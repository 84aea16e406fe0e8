"""A stored inverted index: term-sharded postings in blocks, added to by segments, searched without reading texts.

A segment is four tables in a folder.  ``postings`` holds a row a block: up to ``BLOCK`` chunks of one term in the order of their
place (a hash of the key), with term frequencies, lengths and positions in columns of their own, and what bounds
the score of any chunk in it (the highest frequency, the least length).  ``lexicon`` has document frequencies, ``totals`` the chunks
and tokens, both as differences to the segments before; ``dead`` has the keys whose older postings no longer count.  Folders by shard
of terms, rows sorted by term and small row groups keep a search to the asked terms.

A search adds up block bounds by cell (a range of places), scores the most promising cells of each query exactly, and
then only those cells whose bound reaches the k-th score found.  Scores are those of ``lexical.bm25``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import vocab
from foliant.operators import lexical, ranking
from foliant.session import ship

SHARDS, BLOCK, PLACES = 64, 128, 1 << 20
#: Tokens that a task handles at once; a term that more than a ``DENSE``-th of a piece's chunks hold is spread over ``PARTS`` ranges of places.
PIECE, DENSE, PARTS = 1 << 19, 16, 64
#: Chunks a cell, cells at most, and cells that a query scores before it skips.
CELL_CHUNKS, CELLS, FIRST = 1024, 4096, 4
#: Asked (query, term) pairs from which all cells are scored at once: one of so many queries would want each of them anyway.
MANY = 500
#: Asked terms that are named to the scan; more meet it in a join.
TERMS = lexical.TERMS
ROW_GROUP = 1 << 20
TABLES = ("postings", "lexicon", "totals", "dead")


_POSTINGS = "shard int, term string, low int, high int, n int, max_tf int, min_len int, ids array<{kind}>, places array<int>, tfs array<int>, lens array<int>, spots array<array<int>>"


def shard_of(term: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PLACES)).cast("int")


#: A piece of chunks and one of its terms: the chunks that hold it, ordered by place, their spots one after another.
_PACKED = "term string, part int, n int, ids array<{kind}>, places array<int>, tfs array<int>, lens array<int>, spots array<int>"


def _lists(cuts: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs (start, size), one run after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _pack(names: pa.Array, code: np.ndarray, key: pa.Array, place: np.ndarray, tf: np.ndarray, length: np.ndarray, spots: np.ndarray, chunks: int) -> pa.RecordBatch:
    """Entries of a piece, spots in their order, as ``_PACKED``; terms that a ``DENSE``-th of the piece holds are cut into ``PARTS`` ranges of places."""
    often = np.bincount(code, minlength=len(names)) > max(PARTS, chunks // DENSE)
    part = np.where(often[code], place // (PLACES // PARTS) + 1, 0)
    order = np.lexsort((place, part, code))
    code, part = code[order], part[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])))), len(code))
    spots = spots[_spread((np.cumsum(tf) - tf)[order], tf[order])]
    tf, head = tf[order], cuts[:-1]
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(code[head])), pa.array(part[head], pa.int32()), pa.array(np.diff(cuts), pa.int32()),
        _lists(cuts, key.take(pa.array(order))), _lists(cuts, place[order]), _lists(cuts, tf), _lists(cuts, length[order]), _lists(np.append(0, np.cumsum(tf))[cuts], spots),
    ], names=["term", "part", "n", "ids", "places", "tfs", "lens", "spots"])


def entries(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """term, part, n, ids, places, tfs, lens, spots: a row for each term of a piece of chunks, ``PIECE`` tokens at a time."""
    ship(chunks.sparkSession)
    # dealt first, since a file of few row groups would be cut by as few tasks
    rows = chunks.select(key, text).repartition(key).select(F.col(key).alias("key"), _place(F.col(key)).alias("place"), lexical.tokens(F.col(text)).alias("tokens"))

    def run(batches):
        for batch in batches:
            ends = np.cumsum(np.asarray(batch["tokens"].value_lengths()))
            lo = 0
            while lo < len(ends):
                begin = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
                sizes, piece = np.diff(ends[lo:hi], prepend=begin), batch.slice(lo, hi - lo)
                flat, lo = piece["tokens"].flatten().dictionary_encode(), hi
                if not len(flat):
                    continue
                row = np.repeat(np.arange(len(sizes)), sizes)
                mixed = row * len(flat.dictionary) + flat.indices.to_numpy()
                at = np.argsort(mixed, kind="stable")
                mixed = mixed[at]
                first = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1]))
                tf, own, code = np.diff(np.append(first, len(mixed))), mixed[first] // len(flat.dictionary), mixed[first] % len(flat.dictionary)
                spots = at - (np.cumsum(sizes) - sizes)[row[at]]
                yield _pack(flat.dictionary, code, piece["key"].take(pa.array(own)), piece["place"].to_numpy()[own], tf, sizes[own], spots, len(sizes))

    return rows.mapInArrow(run, _PACKED.format(kind=dict(chunks.dtypes)[key]))


def packed(rows: DataFrame) -> DataFrame:
    """Entries (key, place, term, tf, len, spots) of an index as those of ``entries``."""
    ship(rows.sparkSession)

    def run(batches):
        for batch in batches:
            if len(batch):
                terms = batch["term"].dictionary_encode()
                place, tf, length = (batch[c].to_numpy() for c in ("place", "tf", "len"))
                yield _pack(terms.dictionary, terms.indices.to_numpy(), batch["key"], place, tf, length, batch["spots"].flatten().to_numpy(), len(batch))

    return rows.select("key", "place", "term", "tf", "len", "spots").mapInArrow(run, _PACKED.format(kind=dict(rows.dtypes)["key"]))


def _blocks(kind: pa.DataType):
    """Packed entries, sorted by term and part, to blocks; a block ends with its term, its part, or when it is full.

    What a task holds is a batch, and the entries of the one term and part that goes on."""
    schema = pa.schema([("shard", pa.int32()), ("term", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_len", pa.int32()), ("ids", pa.list_(kind)), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("spots", pa.list_(pa.list_(pa.int32())))])

    def changes(term: pa.Array, part: np.ndarray) -> np.ndarray:
        code = term.dictionary_encode().indices.to_numpy()
        return np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1

    def made(rows: list[pa.RecordBatch]):
        """Blocks of whole runs of a term and part."""
        own = (pa.Table.from_batches(rows).combine_chunks().to_batches() if len(rows) > 1 else rows)[0]
        n = own["n"].to_numpy()
        runs = np.zeros(len(own), np.int64)
        runs[changes(own["term"], own["part"].to_numpy())] = 1
        run = np.repeat(np.cumsum(runs), n)
        place, tf, length, spots = (own[c].flatten().to_numpy() for c in ("places", "tfs", "lens", "spots"))
        order = np.lexsort((place, run))
        spots = spots[_spread((np.cumsum(tf) - tf)[order], tf[order])]
        size = np.bincount(run)
        at = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        cuts = np.append(np.flatnonzero(at % BLOCK == 0), len(run))
        head = pa.array(np.repeat(np.arange(len(own)), n)[order][cuts[:-1]])
        place, tf, length = place[order], tf[order], length[order]
        each = _lists(np.append(0, np.cumsum(tf)), spots)
        yield pa.RecordBatch.from_arrays([
            own["shard"].take(head), own["term"].take(head), pa.array(place[cuts[:-1]], pa.int32()), pa.array(place[cuts[1:] - 1], pa.int32()), pa.array(np.diff(cuts), pa.int32()),
            pa.array(np.maximum.reduceat(tf, cuts[:-1]), pa.int32()), pa.array(np.minimum.reduceat(length, cuts[:-1]), pa.int32()),
            _lists(cuts, own["ids"].flatten().take(pa.array(order))), _lists(cuts, place), _lists(cuts, tf), _lists(cuts, length), _lists(cuts, each),
        ], schema=schema)

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            term, part = batch["term"], batch["part"].to_numpy()
            ends = np.cumsum(np.asarray(batch["spots"].value_lengths()))
            bounds = [0, *changes(term, part).tolist()]
            if held and last != (term[0].as_py(), part[0]):
                yield from made(held)
                held = []
            # whole runs go on together, up to a piece of spots; the last run of the batch is held
            lo = 0
            for k, z in enumerate(bounds[1:], 1):
                after = bounds[k + 1] if k + 1 < len(bounds) else None
                if after is None or held or ends[after - 1] - (ends[lo - 1] if lo else 0) > PIECE:
                    yield from made([*held, batch.slice(lo, z - lo)])
                    held, lo = [], z
            held.append(batch.slice(lo))
            last = (term[len(batch) - 1].as_py(), part[-1])
        if held:
            yield from made(held)

    return run


def _written(df: DataFrame, path: str, by: str | None = None) -> None:
    out = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.expected.ndv#term", "20000")
    (out.partitionBy(by) if by else out).parquet(path)


def write(path: str, found: DataFrame, totals: DataFrame, lexicon: DataFrame | None = None, dead: DataFrame | None = None, shards: int = SHARDS) -> None:
    """A segment of entries (see ``entries``; read once); ``totals`` (n, tokens) and ``lexicon`` (term, df) are differences to earlier segments,
    the lexicon in addition to what the entries tell; ``dead`` are keys whose entries in earlier segments no longer count."""
    _store(path, found, shards)
    _tell(path, found, totals, lexicon, dead, shards)


def _store(path: str, found: DataFrame, shards: int) -> None:
    """The postings of a segment."""
    kind = dict(found.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    ordered = found.withColumn("shard", shard_of(F.col("term"), shards)).repartition("shard", "part").sortWithinPartitions("shard", "term", "part")
    arrow = pa.string() if kind == "string" else pa.int64()
    _written(ordered.mapInArrow(_blocks(arrow), _POSTINGS.format(kind=kind)), f"{path}/postings", "shard")


def _tell(path: str, found: DataFrame, totals: DataFrame, lexicon: DataFrame | None, dead: DataFrame | None, shards: int) -> None:
    """The other tables of a segment whose postings are stored."""
    own = found.sparkSession.read.schema("shard int, term string, n int").parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df"))
    told = own if lexicon is None else own.unionByName(lexicon).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    counted = told.withColumn("shard", shard_of(F.col("term"), shards)).repartition("shard").sortWithinPartitions("shard", "term")
    _written(counted, f"{path}/lexicon", "shard")
    _written(totals.select(F.col("n").cast("bigint").alias("n"), F.col("tokens").cast("bigint").alias("tokens")).coalesce(1), f"{path}/totals")
    none = found.select(F.col("ids")[0].alias("key")).limit(0)
    _written(none if dead is None else dead.select("key"), f"{path}/dead")


def totals_of(chunks: DataFrame, text: str) -> DataFrame:
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(lexical.tokens(F.col(text)))), F.lit(0)).alias("tokens"))


def build(path: str, chunks: DataFrame, key: str, text: str, shards: int = SHARDS) -> Index:
    """The index of a table of chunks, as one segment at ``path``; texts are cut once, tokens are counted from the postings."""
    found = entries(chunks, key, text)
    _store(path, found, shards)
    tokens = F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x))
    stored = chunks.sparkSession.read.schema("shard int, tfs array<int>").parquet(f"{path}/postings").agg(F.coalesce(tokens, F.lit(0)).alias("tokens"))
    _tell(path, found, chunks.agg(F.count("*").alias("n")).crossJoin(stored), None, None, shards)
    return Index(chunks.sparkSession, [(0, path)], shards)


@dataclass
class Index:
    """Segments by number, in order.  Postings of a key count from the last segment that took it out on."""

    spark: SparkSession
    segments: list[tuple[int, str]]
    shards: int = SHARDS

    def _union(self, name: str) -> DataFrame:
        """A table of all segments; schemas are given, since one that holds nothing has no file to tell."""
        kind = self.spark.read.parquet(f"{self.segments[0][1]}/dead").schema["key"].dataType.simpleString()
        schema, out = {"postings": _POSTINGS.format(kind=kind), "lexicon": "shard int, term string, df bigint", "totals": "n bigint, tokens bigint", "dead": f"key {kind}"}[name], None
        for number, path in self.segments:
            part = self.spark.read.schema(schema).parquet(f"{path}/{name}").withColumn("segment", F.lit(number))
            out = part if out is None else out.unionByName(part)
        return out

    def asked(self, queries: DataFrame) -> tuple[list[str], list[int]] | None:
        """The terms of queries and their shards, if they are few enough to be named to a scan."""
        few = [r.term for r in queries.select("term").distinct().limit(TERMS + 1).collect()]
        if len(few) > TERMS:
            return None
        own = self.spark.createDataFrame([(t,) for t in few], "term string").select(shard_of(F.col("term"), self.shards)).distinct()
        return few, sorted(r[0] for r in own.collect())

    def _named(self, table: DataFrame, queries: DataFrame, asked: tuple[list[str], list[int]] | None) -> DataFrame:
        """The rows of asked terms; by folders and row groups, if the terms are named."""
        if asked is None:
            return table.join(queries.select("term").distinct(), "term", "left_semi")
        few, own = asked
        return table.filter(F.col("shard").isin(own) & F.col("term").isin(few)) if few else table.limit(0)

    def dead(self) -> DataFrame | None:
        """key, gone_at; None where there is but one segment."""
        return None if len(self.segments) < 2 else self._union("dead").groupBy("key").agg(F.max("segment").alias("gone_at"))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (key, segment, ...) that still count."""
        dead = self.dead()
        if dead is None:
            return rows
        return rows.join(dead, "key", "left").filter("gone_at IS NULL OR segment >= gone_at").drop("gone_at")

    def rows(self, blocks: DataFrame, *extra: str) -> DataFrame:
        """Live postings of blocks: key, term, place, tf, len, spots if the blocks have them, and ``extra`` columns."""
        lists = [c for c in ("ids", "places", "tfs", "lens", "spots") if c in blocks.columns]
        each = blocks.select("segment", "term", *extra, F.explode(F.arrays_zip(*lists)).alias("x"))
        names = {"ids": "key", "places": "place", "tfs": "tf", "lens": "len", "spots": "spots"}
        return self._live(each.select("segment", "term", *extra, *(F.col(f"x.{c}").alias(names[c]) for c in lists)))

    def entries(self) -> DataFrame:
        """All live entries, as ``packed`` takes them: what a merge of the segments holds."""
        return self.rows(self._union("postings")).select("key", "place", "term", "tf", "len", "spots")

    def whole(self) -> DataFrame:
        """One row: n chunks, tokens, avg_len."""
        return self._union("totals").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).withColumn("avg_len", F.try_divide("tokens", "n"))

    def weights(self, queries: DataFrame, named) -> DataFrame:
        """query_id, term, weight (times asked * idf), avg_len of the asked terms that some chunk holds."""
        asked, whole = queries.groupBy("query_id", "term").agg(F.count("*").alias("times")), self.whole().first()
        df = self._named(self._union("lexicon"), queries, named).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        idf = F.greatest(F.ln((F.lit(whole.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        return asked.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("weight"), F.lit(whole.avg_len).alias("avg_len"))

    @staticmethod
    def _part(tf: str, length: str) -> Column:
        k1, b = vocab.BM25_K1, vocab.BM25_B
        return F.col("weight") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / F.col("avg_len")))

    def _scored(self, blocks: DataFrame, weights: DataFrame, width: int) -> DataFrame:
        """query_id, key, cell, score, matched of the chunks in blocks (with their ids)."""
        met = self.rows(blocks).join(weights, "term")
        cell = (F.col("place") / width).cast("int").alias("cell")
        return met.groupBy("query_id", "key", cell).agg(F.sum(self._part("tf", "len")).alias("score"), F.count("*").alias("matched"))

    def scores(self, queries: DataFrame, every: bool = False) -> DataFrame:
        """query_id, key, score of all chunks with a term of a query (query_id, term); ``every``: with all its terms."""
        named = self.asked(queries)
        scored = self._scored(self._named(self._union("postings"), queries, named).drop("spots"), self.weights(queries, named), PLACES)
        if every:
            scored = scored.join(queries.distinct().groupBy("query_id").agg(F.count("*").alias("terms")), "query_id").filter("matched = terms")
        return scored.select("query_id", "key", "score")

    def cells(self) -> int:
        n = self.whole().first().n or 0
        return min(CELLS, 1 << max(0, math.ceil(math.log2(max(1, n / CELL_CHUNKS)))))

    def bounds(self, postings: DataFrame, weights: DataFrame, cells: int) -> DataFrame:
        """query_id, cell, bound: no chunk of the cell scores more."""
        width = PLACES // cells
        heads = postings.select("term", "low", "high", "max_tf", "min_len")
        over = heads.withColumn("cell", F.explode(F.sequence((F.col("low") / width).cast("int"), (F.col("high") / width).cast("int"))))
        best = over.groupBy("term", "cell").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        return best.join(weights, "term").groupBy("query_id", "cell").agg(F.sum(self._part("max_tf", "min_len")).alias("bound"))

    def top(self, queries: DataFrame, k: int, kept=None) -> DataFrame:
        """query_id, key, score, rank of each query's best ``k``, ties by key.  ``kept`` stores a frame that is read again; caching by default."""
        kept = kept or (lambda df: df.persist())
        few = lexical.few(queries)
        if few is not None and len(few) >= MANY:
            return self._together(queries, k)
        cells = self.cells()
        if cells <= FIRST:
            return _best(self.scores(queries), k)
        named = self.asked(queries)
        weights = kept(self.weights(queries, named))
        postings = self._named(self._union("postings"), queries, named).drop("spots")
        width = PLACES // cells
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
        ranked = kept(self.bounds(postings, weights, cells).withColumn("turn", F.row_number().over(order)))

        def chosen(wanted: DataFrame) -> DataFrame:
            """Scores of chunks in wanted cells (query_id, cell)."""
            spread = wanted.join(weights.select("query_id", "term"), "query_id").select("term", "cell").distinct()
            over = postings.withColumn("cell", F.explode(F.sequence((F.col("low") / width).cast("int"), (F.col("high") / width).cast("int"))))
            inside = self.rows(over.join(spread, ["term", "cell"], "left_semi"), "cell").filter((F.col("place") / width).cast("int") == F.col("cell"))
            met = inside.join(weights, "term").groupBy("query_id", "key", "cell").agg(F.sum(self._part("tf", "len")).alias("score"))
            return met.join(wanted, ["query_id", "cell"], "left_semi").select("query_id", "key", "score")

        first = kept(_best(chosen(ranked.filter(F.col("turn") <= FIRST).select("query_id", "cell")), k).drop("rank"))
        least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = ranked.filter(F.col("turn") > FIRST).join(least, "query_id", "left").filter("bound >= coalesce(least, 0) - 1e-9").select("query_id", "cell")
        return _best(first.unionByName(chosen(rest)), k)

    def _together(self, queries: DataFrame, k: int) -> DataFrame:
        """``top`` of many queries (``lexical.PAIRS`` pairs at most): asked postings are dealt by cell, a task scores a cell's chunks and keeps its best."""
        ship(self.spark)
        named = self.asked(queries)
        postings = self._named(self._union("postings"), queries, named).drop("spots")
        kind = dict(postings.dtypes)["ids"].removeprefix("array<").removesuffix(">")
        weights = self.weights(queries, named).collect()
        if not weights:
            return _best(self.scores(queries), k)
        wanted = pa.array(sorted({r.term for r in weights}), pa.string())
        place = {t: j for j, t in enumerate(wanted.to_pylist())}
        shipped = self.spark.sparkContext.broadcast((wanted, lexical.asked([(place[r.term], r.query_id, r.weight) for r in weights], len(wanted)), weights[0].avg_len))
        width, size = PLACES // self.cells(), PIECE
        if len(self.segments) > 1:
            live = self.rows(postings)
            postings = live.select("term", *(F.array(c).alias(a) for c, a in (("key", "ids"), ("place", "places"), ("tf", "tfs"), ("len", "lens"))))
        postings = postings.select("term", "ids", "places", "tfs", "lens")

        def deal(batches):
            wanted = shipped.value[0]
            for whole in batches:
                for lo in range(0, len(whole), size // BLOCK):
                    batch = whole.slice(lo, size // BLOCK)
                    code = np.repeat(pa.compute.index_in(batch["term"], wanted).fill_null(-1).to_numpy(), np.asarray(batch["ids"].value_lengths()))
                    cell = batch["places"].flatten().to_numpy() // width
                    order = np.flatnonzero(code >= 0)  # a term without weight is in no live chunk
                    order = order[np.argsort(cell[order], kind="stable")]
                    cell = cell[order]
                    cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)) if len(cell) else np.zeros(1, np.int64)
                    flat = lambda c: batch[c].flatten().take(pa.array(order))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]], pa.int32()), _lists(cuts, flat("ids")), _lists(cuts, code[order]), _lists(cuts, flat("tfs")), _lists(cuts, flat("lens"))], names=["cell", "ids", "codes", "tfs", "lens"])

        def score(batches):
            _, asked, mean = shipped.value
            k1, b, found = vocab.BM25_K1, vocab.BM25_B, None

            def add(rows, found):
                """The chunks of one cell."""
                key = pa.concat_arrays([r["ids"].flatten() for r in rows]).to_numpy(zero_copy_only=False)
                code, tf, length = (np.concatenate([r[c].flatten().to_numpy() for r in rows]) for c in ("codes", "tfs", "lens"))
                keys, row = np.unique(key, return_inverse=True)
                found = found or ranking.start(len(asked.ids), k, keys.dtype)
                order = np.argsort(row, kind="stable")
                row, code, part = row[order], code[order], (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))[order]
                step = max(1, size // len(asked.ids))
                for lo in range(0, len(keys), step):
                    a, z = np.searchsorted(row, (lo, lo + step))
                    of, at, value, _ = asked.summed(row[a:z] - lo, code[a:z], part[a:z], min(step, len(keys) - lo))
                    near = value >= found[0][of, -1] - 1e-8
                    ranking.merge(*found, of[near], value[near], keys[lo + at[near]])
                return found

            held, last = [], None
            for batch in batches:
                cell = batch["cell"].to_numpy()
                cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi > lo:
                        if held and cell[lo] != last:
                            found, held = add(held, found), []
                        held.append(batch.slice(lo, hi - lo))
                        last = cell[lo]
            if held:
                found = add(held, found)
            if found is not None:
                best, names = found
                kept = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked.ids[:, None], best.shape)[kept]), pa.array(names[kept]), pa.array(best[kept])], names=["query_id", "key", "score"])

        dealt = postings.mapInArrow(deal, f"cell int, ids array<{kind}>, codes array<int>, tfs array<int>, lens array<int>")
        return _best(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(score, f"query_id bigint, key {kind}, score double"), k)

    def phrase(self, terms: list[str]) -> DataFrame:
        """key, hits: where the terms stand side by side, from positions alone."""
        wanted = list(dict.fromkeys(terms))
        asked = self.spark.createDataFrame([(t,) for t in wanted], "term string")
        held = self.rows(self._named(self._union("postings"), asked, self.asked(asked))).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "spots"))).alias("at")).filter(F.size("at") == len(wanted))
        starts = F.element_at("at", F.lit(terms[0]))

        def stands(x: Column) -> Column:
            out = F.lit(True)
            for k, t in enumerate(terms[1:], 1):
                out = out & F.array_contains(F.element_at("at", F.lit(t)), x + k)
            return out

        return held.select("key", F.size(F.filter(starts, stands)).cast("bigint").alias("hits")).filter("hits > 0")


def _best(scored: DataFrame, k: int) -> DataFrame:
    return lexical.top(scored, k, "key")
