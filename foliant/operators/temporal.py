"""Time: origins, dated events at places, anachronisms and their verdict, spans and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab


def origins(facts: DataFrame, attributes=vocab.ORIGIN_ATTRIBUTES) -> DataFrame:
    """subject_id, attribute, year: the earliest year under an attribute of coming into being."""
    dated = facts.filter(F.col("attribute").isin(*attributes)).withColumn("year", C.parse_year(F.col("value_text"))).filter("year IS NOT NULL")
    first = dated.groupBy("subject_id").agg(F.min(F.struct("year", "attribute")).alias("o"))
    return first.select("subject_id", "o.attribute", "o.year")


def events(facts: DataFrame, attributes=vocab.EVENT_ATTRIBUTES) -> DataFrame:
    """subject_id, attribute, place_id, year: the dated places of event facts."""
    rows = facts.filter(F.col("attribute").isin(*attributes)).select("subject_id", "attribute", F.explode(C.dated_places(F.col("value_text"))).alias("e"))
    return rows.select("subject_id", "attribute", C.entity_id(F.col("e.place")).alias("place_id"), F.col("e.place").alias("place"), F.col("e.year").alias("year")).distinct()


def anachronisms(subjects: DataFrame, dated: DataFrame) -> DataFrame:
    """key, event, gap, impossible, from subjects (key, year) and events (key, event, event_year): a year later than the event's rules presence out, an equal one does not."""
    met = subjects.join(dated, "key")
    gap = F.col("year") - F.col("event_year")
    return met.select("key", "event", gap.alias("gap"), (gap > 0).alias("impossible"))


#: A key is heavy from this share of all rows and this number of rows on; its rows are then cut into this many spans of time.
HEAVY_SHARE, HEAVY_ROWS, SPANS = 1 / 1024, 1_000_000, 256


def heavy_cuts(rows: DataFrame, key: str, at: str, share: float = HEAVY_SHARE, least: int = HEAVY_ROWS, spans: int = SPANS) -> DataFrame | None:
    """key, cuts: times that part a heavy key's rows into spans of about equal size, or None where no key is heavy.

    At most ``1 / share`` keys can be heavy, so what is gathered here and broadcast later has that many rows of ``spans`` times."""
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bound = max(least, int(total * share))
    if total <= bound:
        return None
    heavy = sizes.filter(F.col("n") > bound).select(key)
    held = heavy.collect()  # fewer than 1 / share rows
    if not held:
        return None
    heavy = rows.sparkSession.createDataFrame(held, heavy.schema)
    parts = F.array(*[F.lit(k / spans) for k in range(1, spans)])
    cuts = rows.join(F.broadcast(heavy), key, "left_semi").groupBy(key).agg(F.percentile_approx(at, parts, F.lit(4 * spans)).alias("cuts"))
    return rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, keep: list[str], share: float = HEAVY_SHARE, least: int = HEAVY_ROWS) -> DataFrame:
    """``rows`` with the columns ``keep`` of the last state of their key at or before their time; null where there is none.

    One union and one window by key: no row meets more than its own key's rows.  A heavy key's rows (``heavy_cuts``) are windowed by
    span of time, each of which begins with the last state of the spans before it.  Of states of one key and time the one
    that sorts last counts.  Rows without a key, which have no state, are spread.
    """
    state = F.struct(*[F.col(c) for c in keep])
    both = rows.select(F.col(key).alias("as_key"), F.col(at).alias("as_at"), F.lit(1).alias("as_row"), F.struct("*").alias("as_mine"))
    both = both.unionByName(states.select(F.col(key).alias("as_key"), F.col(at).alias("as_at"), F.lit(0).alias("as_row"), state.alias("as_state")), allowMissingColumns=True)
    loose = F.when(F.col("as_key").isNull(), F.pmod(F.xxhash64("as_at"), F.lit(SPANS)).cast("int"))
    cuts = heavy_cuts(both.select("as_key", "as_at"), "as_key", "as_at", share, least)
    if cuts is None:
        both = both.withColumn("as_span", F.coalesce(loose, F.lit(0)))
    else:
        both = both.join(F.broadcast(cuts.withColumnRenamed("as_key", "as_heavy")), F.col("as_key") == F.col("as_heavy"), "left")
        later = F.size(F.filter("cuts", lambda c: c < F.col("as_at")))
        both = both.withColumn("as_span", F.coalesce(loose, F.when(F.col("cuts").isNotNull(), later), F.lit(0)))
        ends = both.filter("cuts IS NOT NULL").groupBy("as_key", "as_span").agg(F.max(F.when(F.col("as_row") == 0, F.struct("as_at", "as_state")))["as_state"].alias("as_state"))
        before = Window.partitionBy("as_key").orderBy("as_span").rowsBetween(Window.unboundedPreceding, -1)
        begun = ends.select("as_key", "as_span", F.last("as_state", ignorenulls=True).over(before).alias("as_state"), F.lit(0).alias("as_row")).filter("as_state IS NOT NULL")
        both = both.drop("cuts", "as_heavy").unionByName(begun, allowMissingColumns=True)
    upto = Window.partitionBy("as_key", "as_span").orderBy("as_at", "as_row", "as_state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("as_last", F.when(F.col("as_key").isNotNull(), F.last("as_state", ignorenulls=True).over(upto))).filter("as_row = 1")
    return met.select("as_mine.*", *[F.col(f"as_last.{c}").alias(f"as_of_{c}") for c in keep])


def verdicts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("key").agg(F.count("*").alias("events"), F.bool_and("impossible").alias("all_impossible"), F.bool_or("impossible").alias("any_impossible")).withColumn("mixed", F.col("any_impossible") & ~F.col("all_impossible"))


def custody(facts: DataFrame, place: str) -> DataFrame:
    """Facts that name a place, and whether they say where a thing is kept."""
    return facts.filter(C.mentions(F.col("value_text"), F.lit(place))).select("subject_id", "attribute", "value_text", F.col("attribute").isin(*vocab.CUSTODY_ATTRIBUTES).alias("is_custody"))


def duration(start: Column, end: Column) -> Column:
    return end - start


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether spans overlap; null where an open end leaves it undecided."""
    return (a_start <= b_end) & (b_start <= a_end)


def ordering(items: DataFrame, group: str, name: str, year: str) -> DataFrame:
    """Per group the items by year as ``A (225 AS), then B (227 AS)``."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col(name).alias("n"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["n"], F.lit(" ("), x["y"].cast("string"), F.lit(" AS)"))), ", then ")
    return items.groupBy(group).agg(text.alias("ordering"), F.count("*").alias("n")).filter("n >= 2")
