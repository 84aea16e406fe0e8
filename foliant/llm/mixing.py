"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Targets are water-filled: sources share ``share`` of all words by weight, no source takes over
``most`` times its words, and what it can't take is shared again.  Each source's documents, in the
order of a keyed hash, form a line of words that is passed twice and cut in equal blocks.  Van der
Corput points order the slots of the mix: with n slots due and 2**k >= n, slot i has the point that is
i's k bits reversed; the cumulative weights map points under n to a source (others are left out), and the
slots of a source, ranked by i, take its blocks in order.  A source thus gets exactly the slots it is due
and they are spread evenly over the mix.

``mixture`` returns the mix itself: the pieces of documents that stand in each slot, in order.  What is taken
of a document, and the first slot that holds it, are sums over those rows.

Prefix sums and ranks are computed in two levels (sums per hash bucket, then inside the bucket), so
a source with a third of all rows never meets in one task.

Defined results: null text has size 0; null is a source of its own, after all others; documents of
size 0 take 0; repeated rows are documents of their own and equal doc_ids of equal size may swap
places, which gives the same rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.storage import keep
from foliant.llm.text import words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Slots the schedule aims for, and the smallest and largest block in words.
SLOTS, LEAST_BLOCK, LARGEST_BLOCK = 1 << 20, 16, 1 << 16
#: Documents a bucket of a source's line aims for, the least hex digits of the hash that tell it, slots per bucket of the schedule.
BUCKET_DOCS, BUCKET_DIGITS, SLOT_BUCKET = 1 << 16, 3, 1 << 14


def _source_key() -> Column:
    """A join key that tells null from every string."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the source's key and the place of the document in its shuffle."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("sig")).select("*", _source_key().alias("key"), F.md5(F.concat_ws("-", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("place"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: key, source_size, weight, target.

    With sources ordered by cap / weight, the level shared by those not at their cap is the first
    (wanted - caps before) / (weights from here on) that lies under the own cap.
    """
    per = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("ratio", "nth")
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("nth", F.row_number().over(by_name)).withColumn("weight", F.array(*[F.lit(w) for w in weights])[(F.col("nth") - 1) % len(weights)].cast("bigint"))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = per.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(whole)["level"]
    return per.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(first * F.col("weight"), F.col("cap").cast("double")))).select("key", "source", "source_size", "weight", "target")


def bucket_digits(rows: int) -> int:
    """Hex digits that cut ``rows`` documents of one source to buckets of about ``BUCKET_DOCS``; they change no result."""
    digits = BUCKET_DIGITS
    while rows >> 4 * digits > BUCKET_DOCS:
        digits += 1
    return digits


def lines(sized: DataFrame, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``sized`` with ``start``, the words before a document on its source's line."""
    bucketed = sized.withColumn("bucket", F.substring("place", 1, digits))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size", "sig").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("key", "bucket").agg(F.sum("size").alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return bucketed.join(offsets, ["key", "bucket"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("offset", "bucket", "place")


def block_words(total: int) -> int:
    """Words in a block: as few as give ``SLOTS`` slots, within the bounds."""
    return max(LEAST_BLOCK, min(LARGEST_BLOCK, -(-total // SLOTS)))


def schedule(goal: DataFrame, block: int) -> DataFrame:
    """key, slot, rank: the slots of the mix and the block of its source's line that each takes."""
    spark = goal.sparkSession
    due = goal.select("key", F.ceil(F.floor("target") / block).cast("bigint").alias("due")).filter("due > 0")
    n = due.agg(F.sum("due")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], "key string, slot bigint, rank bigint")
    bits = max(1, (n - 1).bit_length())
    starts = due.withColumn("low", F.sum("due").over(Window.orderBy("key")) - F.col("due"))
    chunks = starts.select("key", "low", "due", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(due - 1) div {SLOT_BUCKET}"))).alias("c"))
    chunks = chunks.repartition("key", "c")
    points = chunks.select("key", F.explode(F.sequence(F.expr(f"low + c * {SLOT_BUCKET}"), F.expr(f"low + least(due, (c + 1) * {SLOT_BUCKET}) - 1"))).alias("v"))
    slots = points.select("key", F.conv(F.reverse(F.lpad(F.bin("v"), bits, "0")), 2, 10).cast("bigint").alias("slot")).withColumn("part", F.expr(f"slot div {SLOT_BUCKET}"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("key", "part").orderBy("slot")
    offsets = slots.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return slots.join(offsets, ["key", "part"]).select("key", "slot", (F.col("offset") + F.row_number().over(inside) - 1).cast("bigint").alias("rank"))


def pieces(lined: DataFrame, goal: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """key, start, doc_id, rank, position, first_word, words: what of a document each block of its source's line holds, up to the target."""
    ends = goal.select("key", "source_size", F.floor("target").alias("end"))
    laid = lined.filter("size > 0").join(ends, "key").select("key", "start", "doc_id", "size", "end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: p * F.col("source_size"))).alias("shift"))
    laid = laid.select("key", "start", "doc_id", (F.col("start") + F.col("shift")).alias("a"), F.least(F.col("start") + F.col("shift") + F.col("size"), F.col("end")).alias("z")).filter("a < z")
    cut = laid.select("*", F.explode(F.expr(f"sequence(a div {block}, (z - 1) div {block})")).alias("rank")).withColumn("from", F.expr(f"greatest(a, rank * {block})"))
    return cut.select("key", "start", "doc_id", "rank", F.expr(f"from - rank * {block}").alias("position"), F.expr("from - a").alias("first_word"), F.expr(f"least(z, (rank + 1) * {block}) - from").alias("words"))


def _scheduled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents on their lines, targets, and the rows of the mix."""
    sized = keep(sizes(docs), "sizes")
    goal = keep(targets(sized), "targets")
    block = block_words(int(goal.agg(F.sum("target")).first()[0] or 0))
    lined = lines(sized, bucket_digits(sized.count()))
    return lined, goal, pieces(lined, goal, block).join(schedule(goal, block), ["key", "rank"])


def mixture(docs: DataFrame) -> DataFrame:
    """slot, position, source, block, doc_id, first_word, words: the mix.  Its text reads by slot, then position: a row
    is the ``words`` words of a document from ``first_word`` on (from 0), and begins ``position`` words into its slot's block."""
    _, goal, placed = _scheduled(docs)
    return placed.join(goal.select("key", "source"), "key").select("slot", "position", "source", F.col("rank").alias("block"), "doc_id", "first_word", "words")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, sig, size, source, source_size, target, of every document; taken, the words that the mix takes of it; first_slot, null where it takes none."""
    lined, goal, placed = _scheduled(docs)
    used = placed.groupBy("key", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumn("some", F.lit(1))
    out = lined.withColumn("some", F.when(F.col("size") > 0, 1).otherwise(0)).join(used, ["key", "start", "some"], "left").join(goal.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "sig", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with size, target, taken and first_slot beside their columns (their own of these names give way); rows that share doc_id and text may swap theirs."""
    added = ["size", "target", "taken", "first_slot"]
    same = Window.partitionBy("id", "sig").orderBy(F.lit(0))
    key = F.when(F.col("doc_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key, F.xxhash64("text").alias("sig")).withColumn("nth", F.row_number().over(same))
    told = keep(mix(docs).select(key, "sig", *added), "mix").withColumn("nth", F.row_number().over(same))
    met = rows.join(told, ["id", "sig", "nth"])
    return met.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in added], *added)
