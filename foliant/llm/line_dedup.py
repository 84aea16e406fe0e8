"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ASCII space and lower-cased in A-Z.  Keys of ``MIN_KEY`` code
points or more are referenced by documents; ``reference_counts`` holds, exactly, how many documents
refer to a key and the largest of their ids.  Keys that ``MIN_DOCS`` documents hold lose their lines
everywhere but in that largest document.

Keys are two 64-bit hashes of their bytes, computed for whole Arrow columns in time linear in the text,
one scan for all.  Each shard of the key space has cuckoo filters of the keys that must drop.  References
meet the filters of their shard (filters travel with the rows, so a task holds one shard's at a time) and
only those that pass, a few false ones among them, go on to the exact table.  There are as many shards as
keep a shard under ``SHARD_KEYS`` dropping keys, and as many salts as keep a task under ``TASK_REFS``
references, so both grow with the input.

``LineIndex`` is the incremental form: it keeps references, counts and filters as tables.  Inserting or
deleting documents changes the counts of the keys they touch, and keys whose count crosses ``MIN_DOCS``
are inserted into, or deleted from, the stored filters of their shards; a full filter gets a larger one
beside it.  Deleting what was inserted gives the index back as it was.

Hot keys: counts are combined before the shuffle, filters and counts are copied to the salts when they
meet the references.

Defined results: a null or empty text is one empty line and stays; each row is a document of its
own, so rows that repeat count as so many, and rows that share the largest doc_id all keep theirs;
rows without a doc_id count and lose nothing; an empty table gives an empty result; other columns pass
through ``dedup`` unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.storage import drop_table, keep, keep_while
from foliant.llm.tokens import BYTE_TABLES, SPACE_BYTES, U, mix, powers, slices, text_bytes
from foliant.session import ship

MIN_KEY, MIN_DOCS = 20, 3
#: The least shards and salts, dropping keys to a shard, references to a task.
SHARDS, SALTS, SHARD_KEYS, TASK_REFS = 64, 4, 1 << 18, 1 << 22
#: Cuckoo filter: slots per bucket, kicks before it is full, how full it may get.
SLOTS, KICKS, LOAD = 4, 200, 0.84


class CuckooFilter:
    """A set of 64-bit keys as 16-bit fingerprints, each in one of two buckets; it can delete."""

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * LOAD < max(1, capacity):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x).astype(np.uint64)
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def _places(self, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self._mix(np.asarray(keys).astype(np.int64).view(np.uint64) if np.asarray(keys).dtype != np.uint64 else keys)
        mask = np.uint64(len(self.table) - 1)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h & mask
        return mark, first, first ^ (self._mix(mark) & mask)

    def contains(self, keys) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def _fill(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets, all at once; which of them found none."""
        order = np.argsort(at, kind="stable")
        held = at[order]
        rank = np.arange(len(held)) - np.searchsorted(held, held, "left")
        free = SLOTS - np.count_nonzero(self.table[held], axis=1)
        fits = rank < free
        slots = np.argsort(self.table[held[fits]] != 0, axis=1, kind="stable")
        self.table[held[fits], slots[np.arange(len(slots)), rank[fits]]] = mark[order][fits]
        return order[~fits]

    def insert(self, keys) -> np.ndarray:
        """Which of the keys, by their position, found no place."""
        mark, a, b = self._places(keys)
        left = self._fill(mark, a)
        left = left[self._fill(mark[left], b[left])]
        rng, lost = np.random.default_rng(7), []
        for k in left.tolist():
            moved, at, path = mark[k], b[k], []
            for _ in range(KICKS):
                if (free := np.flatnonzero(self.table[at] == 0)).size:
                    self.table[at, free[0]] = moved
                    break
                slot = int(rng.integers(SLOTS))
                path.append((at, slot, self.table[at, slot]))
                moved, self.table[at, slot] = self.table[at, slot], moved
                at = np.uint64(at ^ (self._mix(moved) & np.uint64(len(self.table) - 1)))
            else:
                for at, slot, held in reversed(path):
                    self.table[at, slot] = held
                lost.append(k)
        return np.array(lost, np.int64)

    def delete(self, keys) -> np.ndarray:
        """Forgets keys; which of them, by their position, it did not hold."""
        lost = []
        for k, (mark, a, b) in enumerate(zip(*self._places(keys), strict=True)):
            for at in (a, b):
                if (held := np.flatnonzero(self.table[at] == mark)).size:
                    self.table[at, held[0]] = 0
                    break
            else:
                lost.append(k)
        return np.array(lost, np.int64)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out


class Filters:
    """A shard's filters: a larger one is added when the last is full."""

    def __init__(self, parts: list[CuckooFilter] | None = None):
        self.parts = parts or []

    def contains(self, keys) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for part in self.parts:
            out |= part.contains(keys)
        return out

    def insert(self, keys: np.ndarray) -> None:
        if self.parts:
            keys = keys[self.parts[-1].insert(keys)]
        while len(keys):
            size = 2 * self.parts[-1].table.size if self.parts else 0
            self.parts.append(CuckooFilter(max(size, len(keys))))
            keys = keys[self.parts[-1].insert(keys)]

    def delete(self, keys: np.ndarray) -> None:
        for part in reversed(self.parts):
            keys = keys[part.delete(keys)]


def lines_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of texts ``data[bounds[i]:bounds[i + 1]]``: start, end, and the text of each; two hashes of its
    key, 0 where that is short; ``long``, where it isn't."""
    lo = bounds[0]
    data, bounds = data[lo : bounds[-1]], bounds - lo
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, bounds[1:]]))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(breaks, bounds)) + 1)
    solid = np.flatnonzero(~SPACE_BYTES[data])
    a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = np.flatnonzero(a <= z)
    a, z = solid[a[some]], solid[z[some]] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    enough = points[z] - points[a] >= MIN_KEY
    some, a, z = some[enough], a[enough], z[enough]
    up, back = powers(len(data))
    hashes = np.zeros((2, len(starts)), np.uint64)
    for k, table in enumerate(BYTE_TABLES):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=total[1:])
        hashes[k, some] = mix((total[z] - total[a]) * back[a] + (z - a).astype(np.uint64))
    long = np.zeros(len(starts), bool)
    long[some] = True
    return starts, ends, text, hashes, long


def references(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2: each key of ``MIN_KEY`` code points once for every row that holds it."""

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch["text"])
            found = []
            for lo, hi in slices(bounds):
                _, _, text, (k1, k2), long = lines_of(data, bounds[lo : hi + 1])
                found.append((text[long] + lo, k1[long], k2[long]))
            if not found:
                continue
            text, k1, k2 = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((k2, k1, text))
            text, k1, k2 = text[order], k1[order], k2[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(text[new])), pa.array(k1[new].view(np.int64)), pa.array(k2[new].view(np.int64))], names=["doc_id", "k1", "k2"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint")


def reference_counts(refs: DataFrame) -> DataFrame:
    """k1, k2, n_docs, last_doc: the exact table."""
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def shard_of(shards: int) -> Column:
    return F.pmod("k2", F.lit(shards)).cast("int").alias("shard")


def shards_for(keys: int) -> int:
    """A power of two of shards, each of ``SHARD_KEYS`` keys at most on average."""
    return SHARDS << max(0, (max(keys, 1) - 1) // (SHARDS * SHARD_KEYS)).bit_length()


def salts_for(refs: int, shards: int) -> int:
    """Salts a shard, so that a task meets ``TASK_REFS`` references.  Keys and filters are copied once a salt: since a shard's keys are
    bounded, all copies together are in proportion to the references."""
    return max(SALTS, -(-refs // (shards * TASK_REFS)))


FILTERS = "shard int, data array<binary>"


def changed_filters(stored: DataFrame | None, changes: DataFrame) -> DataFrame:
    """``FILTERS`` rows of the shards that ``changes`` (shard, k1, add) touch: keys inserted where ``add``, else deleted."""
    rows = changes.select("shard", "k1", "add", F.lit(None).cast("array<binary>").alias("data"))
    if stored is not None:
        touched = stored.join(changes.select("shard").distinct(), "shard", "left_semi")
        rows = rows.unionByName(touched.select("shard", F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("boolean").alias("add"), "data"))

    def run(batches):
        shard, held, keys = None, [], ([], [])

        def made():
            filters = Filters([CuckooFilter.from_bytes(x) for x in held])
            for k, change in enumerate((filters.delete, filters.insert)):
                if keys[k]:
                    change(np.concatenate(keys[k]))
            return pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int32()), pa.array([[x.to_bytes() for x in filters.parts]], pa.list_(pa.binary()))], names=["shard", "data"])

        for batch in batches:
            shards = batch["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if shards[lo] != shard:
                    if shard is not None:
                        yield made()
                    shard, held, keys = shards[lo], [], ([], [])
                part = batch.slice(lo, hi - lo)
                own = part["data"].is_valid().to_numpy(zero_copy_only=False)
                held += [x for k in np.flatnonzero(own).tolist() for x in part["data"][k].as_py()]
                k1, add = part["k1"].fill_null(0).to_numpy(), part["add"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                for k, mine in enumerate((~own & ~add, ~own & add)):
                    if mine.any():
                        keys[k].append(k1[mine])
        if shard is not None:
            yield made()

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FILTERS)


def passing(refs: DataFrame, made: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """The references that the filters of their shard let through: all that must drop, few others."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    none = F.lit(None).cast("bigint")
    shipped = made.select("shard", spread, none.alias("doc_id"), none.alias("k1"), none.alias("k2"), "data")
    asked = refs.select(shard_of(shards), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "k1", "k2", F.lit(None).cast("array<binary>").alias("data"))
    both = shipped.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())

    def probe(batches):
        now, current = None, None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            has_data = batch["data"].is_valid().to_numpy(zero_copy_only=False)
            k1 = batch["k1"].fill_null(0).to_numpy()
            cuts = sorted({0, len(shard), *(np.flatnonzero(np.diff(shard)) + 1).tolist(), *np.flatnonzero(has_data).tolist(), *(np.flatnonzero(has_data) + 1).tolist()})
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if has_data[lo]:
                    now, current = shard[lo], Filters([CuckooFilter.from_bytes(x) for x in batch["data"][lo].as_py()])
                elif shard[lo] == now:
                    hit = np.flatnonzero(current.contains(k1[lo:hi])) + lo
                    if hit.size:
                        yield batch.take(pa.array(hit)).select(["doc_id", "k1", "k2"])

    return both.mapInArrow(probe, "doc_id bigint, k1 bigint, k2 bigint")


def drops(refs: DataFrame, heavy: DataFrame, made: DataFrame, shards: int, salts: int = SALTS) -> DataFrame:
    """doc_id, gone: the keys, as an array of (k1, k2), that each document must drop; ``heavy`` are counts that suffice."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    candidates = passing(refs, made, shards, salts).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    exact = candidates.join(heavy.select("k1", "k2", "last_doc", spread), ["k1", "k2", "salt"])
    return exact.filter("doc_id < last_doc").groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """``text`` without its lines whose keys are among ``gone``, and how many those are; null where ``gone`` is.

    Linear in the text but for sorting its lines' keys.
    """
    ship(SparkSession.active())

    @F.arrow_udf("t string, d bigint")
    def run(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out: list[tuple] = [(None, None)] * len(texts)
        for row in np.flatnonzero(first.is_valid().to_numpy(zero_copy_only=False)).tolist():
            raw = texts[row].as_buffer().to_pybytes()
            starts, ends, _, (k1, k2), long = lines_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            keys = np.rec.fromarrays([x[row].values.to_numpy() for x in (first, second)])
            mine = np.rec.fromarrays([k1.view(np.int64), k2.view(np.int64)])
            drop = long & np.isin(mine, keys)
            out[row] = b"\n".join([raw[a:z] for a, z in zip(starts[~drop].tolist(), ends[~drop].tolist(), strict=True)]).decode(), int(drop.sum())
        return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([d for _, d in out], pa.int64())], ["t", "d"])

    return run(F.when(gone.isNotNull(), F.coalesce(text, F.lit(""))), F.transform(gone, lambda k: k["k1"]), F.transform(gone, lambda k: k["k2"]))


def rewritten(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` as ``row``, with ``n`` lines and ``cut``: the text without lines, and how many went; null where none do."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    met = row.join(gone.select(F.col("doc_id").alias("id"), "gone"), "id", "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    n = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    return met.select("row", n.alias("n"), without(F.col("row.text"), F.col("gone")).alias("cut"))


def to_drop(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, gone: what each document must drop, kept."""
    refs = keep(references(docs), "line_refs")
    heavy = keep_while(lambda: reference_counts(refs).filter(F.col("n_docs") >= min_docs), "line_counts")
    shards = shards_for(heavy.count())
    salts = salts_for(refs.count(), shards)
    made = keep_while(lambda: changed_filters(None, heavy.select(shard_of(shards), "k1", F.lit(True).alias("add"))), "line_filters")
    return keep_while(lambda: (drops(refs, heavy, made, shards, salts), refs, heavy, made), "line_drops")


def _reported(docs: DataFrame, gone: DataFrame) -> DataFrame:
    out = rewritten(docs.select("doc_id", "text"), gone)
    return out.select("row.doc_id", F.col("n").alias("n_lines"), F.coalesce("cut.d", F.lit(0)).cast("bigint").alias("n_dropped"), F.coalesce("cut.t", "row.text", F.lit("")).alias("kept_text"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without its repeated lines; texts that lose none stay as they were, null too."""
    out = rewritten(docs, to_drop(docs, min_docs))
    return out.select(*[(F.when(F.col("cut.d") > 0, F.col("cut.t")).otherwise(F.col("row.text")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text."""
    return _reported(docs, to_drop(docs, min_docs))


class LineIndex:
    """An incremental index in the shared folder: references, counts, and the filters of keys that must drop.

    ``insert`` adds references; ``delete`` rewrites the references without those of the deleted ids, which count again only if they
    are inserted once more.  Either one renews the counts of the keys that it touches and changes the filters by the keys whose
    count crosses ``min_docs``; filters of other shards stay as they are.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, shards: int = SHARDS):
        self.min_docs, self.shards = min_docs, shards
        self.refs = spark.createDataFrame([], "doc_id bigint, k1 bigint, k2 bigint")
        self.counts = spark.createDataFrame([], "k1 bigint, k2 bigint, n_docs bigint, last_doc bigint")
        self.filters = spark.createDataFrame([], FILTERS)

    def _change(self, renewed: DataFrame, touched: DataFrame) -> None:
        """New counts for touched keys, and the filters by the keys that cross."""
        renewed = keep(renewed, "line_renewed")
        now = F.coalesce(renewed["n_docs"], F.lit(0)) >= self.min_docs
        before = F.coalesce(self.counts["n_docs"], F.lit(0)) >= self.min_docs
        both = touched.join(renewed, ["k1", "k2"], "left").select("k1", "k2", now.alias("now")).join(self.counts, ["k1", "k2"], "left").select("k1", "k2", "now", before.alias("before"))
        crossed = keep(both.filter("now != before").select(shard_of(self.shards), "k1", F.col("now").alias("add")), "line_crossed")
        old_counts, old_filters = self.counts, self.filters
        rest = old_filters.join(crossed.select("shard").distinct(), "shard", "left_anti")
        self.filters = keep_while(lambda: rest.unionByName(changed_filters(old_filters, crossed)), "line_filters")
        self.counts = keep_while(lambda: old_counts.join(touched, ["k1", "k2"], "left_anti").unionByName(renewed), "line_counts")
        for old in (old_counts, old_filters, renewed, crossed, touched):
            drop_table(old)

    def insert(self, docs: DataFrame) -> None:
        new = keep(references(docs), "line_refs")
        touched = keep(new.select("k1", "k2").distinct(), "line_touched")
        held = self.counts.join(touched, ["k1", "k2"], "left_semi")
        renewed = held.unionByName(reference_counts(new)).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        self._change(renewed, touched)
        self.refs = self.refs.unionByName(new)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents whose ``doc_id`` is in ``ids`` out of the index."""
        ids = keep(ids.select("doc_id").distinct(), "line_deleted")
        touched = keep(self.refs.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "line_touched")
        old = self.refs
        self.refs = keep(old.join(ids, "doc_id", "left_anti"), "line_refs")
        self._change(reference_counts(self.refs.join(touched, ["k1", "k2"], "left_semi")), touched)
        for table in (old, ids):
            drop_table(table)

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of indexed documents, through the stored filters."""
        heavy = self.counts.filter(F.col("n_docs") >= self.min_docs)
        return _reported(docs, keep(drops(references(docs), heavy, self.filters, self.shards), "line_drops"))
