"""Benchmark decontamination by spaced-seed hashing.

``MASKS`` are patterns of word positions; the hash of a place under a mask ignores the positions the
mask leaves out.  The two masks are lossless for their purpose: of any 13 words of which any 2 are
substituted, at least one mask finds a place that it hashes as in the original (a test tries every
case).  Hashes of the benchmark meet those of every place of every document; around each hit the two
texts are aligned and the document is contaminated if ``WINDOW`` aligned words differ in at most
``SUBSTITUTIONS``.  Items of ``SPAN`` to 12 words must be found whole with at most one word changed, for which
runs of ``HALF`` words are lossless (one half of the item is unchanged); shorter items whole and unchanged.

Words are runs of bytes other than ASCII space and punctuation, A-Z lower-cased.

The benchmark side is broadcast in blocks: ``BLOCK_WORDS`` bounds what one block holds, the number of
blocks follows from a count, and every block meets all documents.  With several blocks, what a block finds
is written before the next one is built, so driver and workers hold one block at a time.  Documents are
read and never shuffled.

Defined results: null or empty texts and items hold nothing and match nothing; repeated rows are
judged row by row; items that share an item_id are one item with several texts, an item_id or doc_id
of null is reported as such; an empty table gives an empty result; other columns are not read and
``clean`` keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import drop_table, keep
from foliant.llm.tokens import MARK_BYTES, runs, slices, text_bytes, word_hashes
from foliant.session import ship

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW, SUBSTITUTIONS = 13, 2
#: The run of words that finds items between the mask's span and the window.
HALF = SPAN // 2
BLOCK_WORDS = 1_000_000
#: Bits of the table that most places fail at once.
FILTER_BITS = 22


class SeedIndex:
    """Seeds of a block of benchmark texts."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        data, bounds = text_bytes(pa.array(texts, pa.large_string()))
        hashes, cuts = word_hashes(data, bounds, MARK_BYTES)
        self.items = [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.tables = []
        shapes = [(mask, [k for k, w in enumerate(self.items) if len(w) >= SPAN]) for mask in MASKS]
        shapes.append((tuple(range(HALF)), [k for k, w in enumerate(self.items) if SPAN <= len(w) < WINDOW]))
        shapes += [(tuple(range(n)), [k for k, w in enumerate(self.items) if len(w) == n]) for n in range(1, SPAN)]
        for mask, held in shapes:
            if held:
                found = [runs(self.items[k], mask) for k in held]
                seeds = np.concatenate(found)
                item = np.repeat(np.array(held), [len(x) for x in found])
                place = np.concatenate([np.arange(len(x)) for x in found])
                order = np.argsort(seeds, kind="stable")
                sieve = np.zeros(1 << FILTER_BITS, bool)
                sieve[seeds >> np.uint64(64 - FILTER_BITS)] = True
                self.tables.append((mask, sieve, seeds[order], item[order], place[order]))

    def matches(self, words: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, matched words, first word) of the verified overlaps, the best one per text and item."""
        ways = []
        for mask, sieve, seeds, item, place in self.tables:
            here = runs(words, mask)
            at = np.flatnonzero(sieve[here >> np.uint64(64 - FILTER_BITS)])
            low, high = np.searchsorted(seeds, here[at], "left"), np.searchsorted(seeds, here[at], "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            if at.size:
                hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                ways.append(np.stack([np.repeat(at, count) - place[hit], item[hit], np.repeat(at, count)]))
        if not ways:
            return []
        start, item, at = np.concatenate(ways, axis=1)
        text = np.searchsorted(cuts, at, "right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for t, k, s in np.unique(np.stack([text, item, start]), axis=1).T.tolist():
            if (found := self._verified(words, int(cuts[t]), int(cuts[t + 1]), k, s)) and found > best.get((t, k), (0, 0)):
                best[t, k] = found
        return [(t, k, matched, -first) for (t, k), (matched, first) in best.items()]

    def _verified(self, words: np.ndarray, low: int, high: int, k: int, start: int) -> tuple[int, int] | None:
        item = self.items[k]
        a, z = max(start, low), min(start + len(item), high)
        window = min(WINDOW, len(item))
        if z - a < window:
            return None
        same = words[a:z] == item[a - start : z - start]
        sums = np.concatenate([[0], np.cumsum(same)])
        allowed = SUBSTITUTIONS if len(item) >= WINDOW else int(len(item) >= SPAN)
        return (int(same.sum()), low - a) if (sums[window:] - sums[:-window]).max() >= window - allowed else None


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast seed indexes over all items, each of about ``block_words`` words, and whether another one follows.

    A block goes when the next one is asked for."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).filter("text != ''")
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = -(-total // block_words)
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        shipped = spark.sparkContext.broadcast(SeedIndex([r[0] for r in rows], [r[1] for r in rows]))
        del rows
        yield shipped, b + 1 < n
        if b + 1 < n:
            shipped.destroy()


def _found(index: SeedIndex, column: pa.Array):
    data, bounds = text_bytes(column)
    for lo, hi in slices(bounds):
        words, cuts = word_hashes(data, bounds[lo : hi + 1], MARK_BYTES)
        for t, *rest in index.matches(words, cuts):
            yield lo + t, *rest


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, first_word: a row for each document and item found in it."""
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, matched_words bigint, item_words bigint, first_word bigint"

    def one(shipped):
        def run(batches):
            index = shipped.value
            for batch in batches:
                found = list(_found(index, batch["text"]))
                if found:
                    t, k, matched, first = zip(*found, strict=True)
                    item_ids = pa.array([index.ids[x] for x in k])
                    words = pa.array([len(index.items[x]) for x in k], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(t)), item_ids, pa.array(matched, pa.int64()), words, pa.array(first, pa.int64())], names=["doc_id", "item_id", "matched_words", "item_words", "first_word"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = []
    for shipped, more in blocks(benchmark, block_words):
        found = one(shipped)
        parts.append(keep(found, "found") if more else found)
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def holds(text: Column, shipped) -> Column:
    """Whether a text holds an item of a block."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for t, *_ in _found(shipped.value, texts):
            out[t] = True
        return pa.array(out)

    return run(text)


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage."""
    kept = None
    for shipped, more in blocks(benchmark, block_words):
        docs = docs.filter(~holds(F.coalesce(F.col("text"), F.lit("")), shipped))
        if more:
            before, docs = kept, keep(docs, "clean")
            kept = docs
            if before is not None:
                drop_table(before)
    return docs
