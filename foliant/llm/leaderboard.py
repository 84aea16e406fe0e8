"""A change feed of leaderboards, kept by a stateful Structured Streaming query.

Lines (see ``LINE``) arrive in batches.  A start of the query reads one batch's files, drops what is late by the stream's
own watermark and adds revenue by nation and item.  State is held by nation and shard of its items, so that no
nation's dictionary is one task's: a serialized dictionary of revenue, over which a max-heap with lazy deletion
finds the ten best after every arrival day (entries that the dictionary contradicts are skipped, the ten are pushed back).  A
shard tells only how its ten changed.  ``foreachBatch`` merges those few rows into the nations' boards with a second
heap of the same kind, and writes the changes of ranks and the boards' members in a folder numbered by the
micro-batch: a batch that is run again after a failure writes the same folder anew.

Equal lines are lines of their own.  Lines that are not counted (no nation, no item) carry nothing but their day, which moves the
watermark.  An empty table gives an empty feed.  Items tie by the smaller id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.llm.storage import drop_path, forget, new_path
from foliant.session import ship

#: Places on a board, and days that a line may be older than the newest line of earlier batches.
PLACES, LATE_DAYS = 10, 3
#: Batches, the first arrival day and the days that the batches share.
BATCHES, FIRST_DAY, DAYS = 10, 19723, 180
#: Lines that a task adds up before it sends them.
COMBINED = 200_000

LINE = "nation_id int, item_id bigint, event_day int, arrival_day int, cents bigint, counted boolean, batch int"
FEED = "nation_id int, arrival_day bigint, item_id bigint, batch int, change string, old_rank int, new_rank int, revenue bigint"
_DELTA = "nation_id int, arrival_day int, batch int, item_id bigint, revenue bigint, listed boolean"
_STATE = "items binary, revenue binary, listed_items binary, listed_revenue binary"


def cut(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """Sale lines as the feed's lines.  Of repeated vendors and items the smallest nation and price hold; other columns are ignored.

    Items grow with the lines, so they meet by sorting at every size, and a hot item is split; vendors are broadcast only while
    Spark counts them small."""
    nations = vendors.filter("vendor_id IS NOT NULL").groupBy(F.col("vendor_id").alias("v")).agg(F.min("nation_id").alias("nation_id"))
    prices = items.filter("item_id IS NOT NULL").groupBy(F.col("item_id").alias("i")).agg(F.min(F.floor(100 * F.col("price") + 0.5).cast("double")).alias("price_cents"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]
    h = F.crc32(F.concat_ws(",", *parts))
    day = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")), (F.lit(FIRST_DAY) + F.col("h") % 150).cast("int"))
    arrival = F.col("event_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    own = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", "shipped_at", h.alias("h")).withColumn("event_day", day).withColumn("arrival_day", arrival.cast("int"))
    batch = F.least(F.lit(BATCHES), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * BATCHES / DAYS)).cast("int")
    joined = own.join(nations, F.col("vendor_id") == F.col("v"), "left").join(prices.hint("merge"), F.col("item_id") == F.col("i"), "left")
    counted = F.col("nation_id").isNotNull() & F.col("i").isNotNull()
    cents = F.coalesce(F.floor(100 * F.col("amount") + 0.5).cast("double"), F.col("quantity") * F.col("price_cents"), F.lit(0.0))
    cents = F.when(F.col("flag") == "swapped", -cents).otherwise(cents).cast("bigint")
    only = lambda value, kind: F.when(counted, value).otherwise(F.lit(0)).cast(kind)
    return joined.select(
        only(F.col("nation_id"), "int").alias("nation_id"), only(F.col("item_id"), "bigint").alias("item_id"), "event_day",
        only(F.col("arrival_day"), "int").alias("arrival_day"), only(cents, "bigint").alias("cents"), counted.alias("counted"), batch.alias("batch"),
    )


def _combined(batches):
    """Lines of one nation, item and day added up, as far as a task meets them."""
    keys = ["nation_id", "item_id", "event_day", "arrival_day", "counted", "batch"]

    def closed(held):
        done = pa.Table.from_batches(held).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])
        return done.select(["nation_id", "item_id", "event_day", "arrival_day", "cents", "counted", "batch"]).combine_chunks().to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= COMBINED:
            yield from closed(held)
            held, n = [], 0
    if n:
        yield from closed(held)


class Board:
    """Revenue by item, and a max-heap over it whose stale entries are skipped when they surface."""

    def __init__(self, revenue: dict[int, int]):
        self.revenue = revenue
        self.heap = [(-r, item) for item, r in revenue.items() if r > 0]
        heapq.heapify(self.heap)

    def put(self, item: int, revenue: int) -> None:
        self.revenue[item] = revenue
        if revenue > 0:
            heapq.heappush(self.heap, (-revenue, item))

    def best(self, places: int = PLACES) -> dict[int, int]:
        """The first items and their revenue, in order."""
        found: dict[int, int] = {}
        while self.heap and len(found) < places:
            negative, item = heapq.heappop(self.heap)
            if item not in found and self.revenue.get(item) == -negative:
                found[item] = -negative
        for item, revenue in found.items():
            heapq.heappush(self.heap, (-revenue, item))
        return found


def _pairs(items: bytes, revenue: bytes) -> dict[int, int]:
    return dict(zip(np.frombuffer(items, np.int64).tolist(), np.frombuffer(revenue, np.int64).tolist(), strict=True))


def _packed(pairs: dict[int, int]) -> tuple[bytes, bytes]:
    return np.fromiter(pairs.keys(), np.int64, len(pairs)).tobytes(), np.fromiter(pairs.values(), np.int64, len(pairs)).tobytes()


def shard_changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A shard's ten best after each arrival day: the items whose place among them, or revenue there, has changed."""
    nation, shard = key
    if shard < 0:
        for _ in frames:
            pass
        return
    rows = [tuple(f[c].to_numpy() for c in ("arrival_day", "item_id", "cents", "batch")) for f in frames]
    if not rows:
        return
    day, item, cents, batch = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((item, day))
    day, item, cents, batch = day[order], item[order], cents[order], batch[order]
    first = np.flatnonzero(np.concatenate(([True], (day[1:] != day[:-1]) | (item[1:] != item[:-1]))))
    day, item, batch, cents = day[first], item[first], batch[first], np.add.reduceat(cents, first)
    bounds = np.flatnonzero(np.concatenate(([True], day[1:] != day[:-1], [True])))

    held = state.get if state.exists else (b"", b"", b"", b"")
    board, listed = Board(_pairs(held[0], held[1])), _pairs(held[2], held[3])
    out: list[tuple] = []
    for a, z in zip(bounds, bounds[1:], strict=False):
        for i, c in zip(item[a:z].tolist(), cents[a:z].tolist(), strict=True):
            board.put(i, board.revenue.get(i, 0) + c)
        best, when = board.best(), (nation, int(day[a]), int(batch[a]))
        out += [(*when, i, r, True) for i, r in best.items() if listed.get(i) != r]
        out += [(*when, i, board.revenue[i], False) for i in listed if i not in best]
        listed = best
    state.update((*_packed(board.revenue), *_packed(listed)))
    yield pd.DataFrame(out, columns=["nation_id", "arrival_day", "batch", "item_id", "revenue", "listed"])


_MERGED = pa.schema([
    ("nation_id", pa.int32()), ("arrival_day", pa.int64()), ("item_id", pa.int64()), ("batch", pa.int32()), ("change", pa.string()),
    ("old_rank", pa.int32()), ("new_rank", pa.int32()), ("revenue", pa.int64()), ("kind", pa.string()),
])


def _merged(batches):
    """Members of the nations' boards, then the shards' changes by day: the changes of ranks, and the members afterwards."""

    def rows():
        nation, day, board, ranks = None, None, Board({}), {}
        gone: dict[int, int] = {}
        batch_no = 0

        def day_over():
            nonlocal ranks
            if day is None:
                return
            new = {item: k + 1 for k, item in enumerate(board.best())}
            for item in sorted(ranks.keys() | new.keys()):
                old_rank, new_rank = ranks.get(item), new.get(item)
                if old_rank != new_rank:
                    change = "enter" if old_rank is None else "exit" if new_rank is None else "move"
                    yield nation, day, item, batch_no, change, old_rank, new_rank, board.revenue.get(item, gone.get(item)), "feed"
            ranks = new

        def nation_over():
            for item, revenue in board.revenue.items():
                yield nation, None, item, None, None, None, ranks.get(item), revenue, "member"

        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("nation_id", "arrival_day", "batch", "item_id", "revenue", "listed", "rank")), strict=True):
                if r[0] != nation or r[1] != day:
                    yield from day_over()
                    if r[0] != nation:
                        yield from nation_over()
                        nation, board, ranks = r[0], Board({}), {}
                    day, gone = r[1], {}
                _, _, batch_no, item, revenue, listed, rank = r
                if listed:
                    board.put(item, revenue)
                else:
                    board.revenue.pop(item, None)
                    gone[item] = revenue
                if rank is not None:
                    ranks[item] = rank
        yield from day_over()
        yield from nation_over()

    held = []
    for r in rows():
        held.append(r)
        if len(held) >= 8192:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MERGED, strict=True)], schema=_MERGED)


def _merge(boards: str):
    """The ``foreachBatch`` step: batch ``n`` reads the members that batch ``n - 1`` left."""

    def run(changes: DataFrame, n: int) -> None:
        spark = changes.sparkSession
        rows = changes.withColumn("rank", F.lit(None).cast("int"))
        if n:
            members = spark.read.schema(f"{FEED}, kind string").parquet(f"{boards}/n={n - 1}").filter("kind = 'member'")
            rows = members.select("nation_id", F.lit(None).cast("int").alias("arrival_day"), F.lit(0).alias("batch"), "item_id", "revenue", F.lit(True).alias("listed"), F.col("new_rank").alias("rank")).unionByName(rows)
        ordered = rows.repartition("nation_id").sortWithinPartitions("nation_id", "arrival_day", "item_id")
        ordered.mapInArrow(_merged, f"{FEED}, kind string").write.mode("overwrite").partitionBy("kind").parquet(f"{boards}/n={n}")

    return run


def shards_for(n_lines: int) -> int:
    """Shards of a nation's items.  They grow with the square root of the lines, as do, then, a shard's items and a board's members."""
    return max(8, math.ceil(math.sqrt(n_lines) / 200))


def start(spark: SparkSession, source: str, boards: str, checkpoint: str, shards: int):
    """The query over the files that ``source`` has by now; the next start on the same checkpoint goes on from there."""
    lines = spark.readStream.schema(LINE).parquet(source).select([c.split()[0] for c in LINE.split(", ")]).mapInArrow(_combined, LINE)
    shard = F.when(F.col("counted"), F.pmod(F.xxhash64("item_id"), F.lit(shards))).otherwise(F.lit(-1)).cast("int")
    timed = lines.withColumn("event_time", F.timestamp_seconds(F.col("event_day").cast("bigint") * 86400)).withColumn("shard", shard)
    # a line is late when its day is at most the newest day less the delay: half a day more than whole days, so that the third day before counts
    timely = timed.withWatermark("event_time", f"{24 * LATE_DAYS + 12} hours")
    changes = timely.groupBy("nation_id", "shard").applyInPandasWithState(shard_changes, _DELTA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(_merge(boards)).trigger(availableNow=True).start()


#: Session settings of the starts: a micro-batch a start, lines late by the watermark of the last batch (with several stateful operators
#: in a query it would be that of the batch before), and no versions of state beyond the last two.
SETTINGS = {"spark.sql.streaming.statefulOperator.allowMultiple": "false", "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.minBatchesToRetain": "2"}


def feed(lines: DataFrame, shards: int) -> DataFrame:
    """The changes of all boards, from lines that are written by batch and fed in order to a query started anew for each."""
    spark = lines.sparkSession
    ship(spark)
    root = new_path(spark, "leaderboard")
    lines.write.partitionBy("batch").parquet(f"{root}/cut")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waiting = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(fs_path(f"{root}/cut")) if s.getPath().getName().startswith("batch="))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    files.mkdirs(fs_path(f"{root}/in"))
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        for n in waiting:
            files.rename(fs_path(f"{root}/cut/batch={n}"), fs_path(f"{root}/in/batch={n}"))
            query = start(spark, f"{root}/in", f"{root}/boards", f"{root}/checkpoint", shards)
            query.awaitTermination()
            forget(spark)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not waiting:
        return spark.createDataFrame([], FEED)
    for used in ("cut", "in", "checkpoint"):
        drop_path(spark, f"{root}/{used}")
    return spark.read.schema(f"{FEED}, n int, kind string").parquet(f"{root}/boards").filter("kind = 'feed'").drop("n", "kind")
