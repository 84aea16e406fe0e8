"""The fact table: extraction from table chunks, conflicts, best values, lookups and hops.

Facts are rows (subject_id, subject_name, attribute, value_text, value_key, value_number, document_id,
chunk_id, page, source_class, reliability, ord); ``ord`` is the place of first mention and breaks ties.
Lookups take a frame of requests, so that one job answers many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab

ROW = r"^\s*([^|]{1,60}?)\s*\|\s*(.+?)\s*$"
KEY = ["subject_id", "attribute"]


def kv_rows(chunks: DataFrame, text: str = "content") -> DataFrame:
    """A row (…, line, label, value) for each ``label | value`` line of the chunks' text."""
    lines = chunks.select("*", F.posexplode(F.split(text, "\n")).alias("line", "row_text"))
    found = lines.withColumns({"label": F.regexp_extract("row_text", ROW, 1), "value": F.regexp_extract("row_text", ROW, 2)})
    return found.filter("label != ''").drop("row_text")


def subject_name(section_path: Column, title: Column) -> Column:
    """The first heading, unless it names a field; then the document's title."""
    first = C.display_name(F.regexp_replace(F.coalesce(F.get(section_path, F.lit(0)), F.lit("")), C.WIKILINK, "$1"))
    labels = (*vocab.SKIP_LABELS, *vocab.ATTRIBUTES, *vocab.FIELD_WORDS, "infobox", "")
    return F.when(F.lower(first).isin(*labels) | F.lower(first).startswith("infobox"), C.display_name(title)).otherwise(first)


def extract(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts from the table chunks of current documents; the first of equal (subject, attribute, key, chunk) stays.

    Equal ones share their chunk, so facts are dealt by it first: what a task sorts is a partition of facts, not all that its chunks hold."""
    current = documents.filter("superseded_by IS NULL").select("document_id", "title", "reliability")
    tables = chunks.filter("content_type = 'table'").join(current, "document_id")
    rows = kv_rows(tables).withColumns({"attribute": C.attribute(F.col("label")), "value_text": C.clean_value(F.col("value"))})
    rows = rows.withColumn("value_text", F.when(F.col("attribute") == "timeline_event", F.concat_ws(" ", C.clean_value(F.col("label")), "value_text")).otherwise(F.col("value_text")))
    rows = rows.filter("attribute IS NOT NULL AND value_text != '' AND length(value_text) <= 200")
    rows = rows.withColumn("subject_name", subject_name(F.col("section_path"), F.col("title")))
    rows = rows.select(
        C.entity_id(F.col("subject_name")).alias("subject_id"), "subject_name", "attribute", "value_text", C.value_key(F.col("value_text")).alias("value_key"),
        C.numeric_value(F.col("value_text")).alias("value_number"), "document_id", "chunk_id", F.col("page_start").alias("page"), "source_class", "reliability", F.struct("document_id", "chunk_id", "line").alias("ord"),
    )
    return deduplicated(rows.repartition("chunk_id"))


def deduplicated(facts: DataFrame, unique: tuple[str, ...] = ("subject_id", "attribute", "value_key", "chunk_id")) -> DataFrame:
    """The first fact of each unique key: an aggregation with map-side combine, not a sort of every key."""
    rest = [c for c in facts.columns if c not in unique]
    first = facts.groupBy(*unique).agg(F.min_by(F.struct(*rest), "ord").alias("r"))
    return first.select(*[F.col(c) if c in unique else F.col(f"r.{c}") for c in facts.columns])


def report(facts: DataFrame) -> DataFrame:
    per = facts.groupBy(*KEY).agg(F.count("*").alias("n"), F.countDistinct("value_key").alias("keys"))
    return per.agg(F.sum("n").alias("facts"), F.countDistinct("subject_id").alias("subjects"), F.count_if(F.col("keys") > 1).alias("conflicts"))


def groups(facts: DataFrame) -> DataFrame:
    """A row for each distinct value of a (subject, attribute)."""
    return facts.groupBy(*KEY, "value_key").agg(
        F.max("reliability").alias("reliability"), F.countDistinct("document_id").alias("documents"), F.count("*").alias("rows"), F.min("ord").alias("ord"),
        F.min_by("value_text", "ord").alias("value_text"), F.array_sort(F.collect_set("source_class")).alias("sources"),
    )


def conflicts(facts: DataFrame) -> DataFrame:
    """(subject, attribute) with more than one distinct value."""
    return facts.groupBy(*KEY).agg(F.countDistinct("value_key").alias("values")).filter("values > 1")


def best(facts: DataFrame) -> DataFrame:
    """The value to believe: by reliability, then documents, then rows, then first mention."""
    of = groups(facts)
    pick = F.struct((-F.col("reliability")).alias("r"), (-F.col("documents")).alias("d"), (-F.col("rows")).alias("n"), "ord")
    return of.groupBy(*KEY).agg(F.min_by(F.struct("value_key", "value_text", "reliability", "documents"), pick).alias("b"), F.count("*").alias("values")).select(*KEY, "b.*", "values")


def ranked(facts: DataFrame) -> DataFrame:
    """``groups`` with their rank, the value to believe first, the number of values, and the gap to the next one's reliability."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("reliability"), F.desc("documents"), F.desc("rows"), "ord")
    gap = F.round(F.col("reliability") - F.lead("reliability").over(order), 6)
    return groups(facts).withColumns({"rank": F.row_number().over(order), "values": F.count("*").over(Window.partitionBy(*KEY)), "gap": gap})


def conflict_positions(facts: DataFrame) -> DataFrame:
    """Per conflict its positions, best first, the gap between the top two, and whether that decides it."""
    ranked = groups(facts).withColumn("gap", F.col("reliability") - F.lead("reliability").over(Window.partitionBy(*KEY).orderBy(F.desc("reliability"), "ord")))
    top = F.min_by(F.struct("value_key", "gap"), F.struct((-F.col("reliability")).alias("r"), "ord")).alias("top")
    out = ranked.groupBy(*KEY).agg(F.count("*").alias("positions"), top).filter("positions > 1")
    gap = F.round("top.gap", 6)
    return out.select(*KEY, "positions", F.col("top.value_key").alias("preferred"), gap.alias("gap"), (gap >= vocab.DECISIVE_GAP).alias("resolvable"))


def scored(facts: DataFrame, hops: int = 0) -> DataFrame:
    """Confidence in the best value of each (subject, attribute)."""
    b = best(facts)
    score = C.confidence(F.col("reliability"), F.col("documents"), F.lit(hops), F.col("values") > 1)
    return b.select(*KEY, "value_key", "values", F.round(score, 6).alias("confidence"), C.confidence_label(score).alias("label"))


def lookup(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """``groups`` of the requested (subject_id, attribute)."""
    return groups(facts.join(requests.select(*KEY).distinct(), KEY, "left_semi"))


def attributes_of(facts: DataFrame, subjects: DataFrame) -> DataFrame:
    return facts.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi").select(*KEY).distinct()


def inverse_lookup(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Subjects whose (attribute) value holds the wanted key as whole words: an equi-join on word n-grams, no nested loop."""
    words = F.split("value_key", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))
    parts = facts.select("subject_id", "attribute", "document_id", F.explode(F.array_distinct(spans)).alias("wanted_key"))
    return parts.join(wanted.select("attribute", "wanted_key").distinct(), ["attribute", "wanted_key"]).select("attribute", "wanted_key", "subject_id").distinct()


def naming(facts: DataFrame, attributes: list[str], subject_id: str) -> DataFrame:
    """Facts of other subjects whose value under one of the attributes is, or lists, a subject."""
    return facts.filter(F.col("attribute").isin(attributes) & (F.col("subject_id") != subject_id) & F.array_contains(C.hop_targets(F.col("value_text")), subject_id))


def two_hop(facts: DataFrame, bridge: str, target: str) -> DataFrame:
    """subject –bridge→ other subject –target→ value, over all subjects."""
    first = facts.filter(F.col("attribute") == bridge).select("subject_id", F.explode(C.hop_targets(F.col("value_text"))).alias("via")).distinct()
    second = best(facts.filter(F.col("attribute") == target)).select(F.col("subject_id").alias("via"), "value_key", "reliability")
    return first.join(second, "via").select("subject_id", "via", "value_key", "reliability")


def inverse_fallback(facts: DataFrame, attribute: str, subjects: DataFrame) -> DataFrame:
    """The best value of an attribute or, for subjects without one, who names them under its inverse."""
    own = best(facts.filter(F.col("attribute") == attribute)).select("subject_id", F.col("value_key").alias("own"))
    inverse = vocab.INVERSE_ATTRIBUTES.get(attribute, attribute)
    other = facts.filter(F.col("attribute") == inverse).select(F.explode(C.hop_targets(F.col("value_text"))).alias("subject_id"), F.col("subject_id").alias("other")).groupBy("subject_id").agg(F.min("other").alias("other"))
    met = subjects.select("subject_id").distinct().join(own, "subject_id", "left").join(other, "subject_id", "left")
    return met.select("subject_id", F.coalesce("own", "other").alias("value"), F.when(F.col("own").isNotNull(), "stated").when(F.col("other").isNotNull(), "inverse").otherwise("none").alias("found"))


def fallback_chain(requests: DataFrame, *sources: DataFrame) -> DataFrame:
    """The first source, in order, that has a value for a request: one union, one aggregation."""
    union = None
    for priority, source in enumerate(sources):
        rows = source.select(*KEY, "value", F.lit(priority).alias("priority"))
        union = rows if union is None else union.unionByName(rows)
    first = union.groupBy(*KEY).agg(F.min(F.struct("priority", "value")).alias("f"))
    return requests.select(*KEY).distinct().join(first, KEY, "left").select(*KEY, "f.priority", "f.value")
