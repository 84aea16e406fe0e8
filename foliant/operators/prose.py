"""Facts from sentences: about whom a sentence speaks, and what it states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab


def sentences(passages: DataFrame, key: str, text: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s*\n\s*", " "), r"(?<=[.!?])\s+"), lambda s: s != "")
    return passages.select(key, F.posexplode(parts).alias("at", "sentence"))


def about(rows: DataFrame, subject, key: str) -> DataFrame:
    """Sentences about a subject: those that name it, and pronoun openers while the chain from one holds."""
    named, pronoun = C.mentions(F.col("sentence"), subject), F.col("sentence").rlike(vocab.PRONOUN)
    flags = rows.withColumns({"named": named, "pronoun": pronoun & ~named})
    last = F.last(F.when(~F.col("pronoun"), F.col("named")), ignorenulls=True).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flags.withColumn("about", F.coalesce(last, F.lit(False))).filter("about").drop("named", "pronoun", "about")


def stated(rows: DataFrame, key: str) -> DataFrame:
    """key, attribute, value: the first statement of each attribute; hedged sentences state nothing."""
    read = [F.struct(F.lit(attribute).alias("attribute"), F.coalesce(*[F.nullif(F.regexp_extract("sentence", f"(?i){p}", 1), F.lit("")) for p in patterns]).alias("value")) for attribute, patterns in vocab.PROSE.items()]
    found = rows.filter(~F.col("sentence").rlike(vocab.HEDGE)).select(key, "at", F.explode(F.filter(F.array(*read), lambda r: r["value"].isNotNull())).alias("r"))
    return found.groupBy(key, F.col("r.attribute").alias("attribute")).agg(F.min_by("r.value", "at").alias("value"))


def search_queries(subject: str, attribute: str) -> list[str]:
    """What to search for to meet a sentence that states an attribute: with the archive's phrases, then the bare name."""
    return [*(f"{subject} {phrase}" for phrase in vocab.SEARCH_PHRASES.get(attribute, ())), subject]


def caption_subject(caption):
    """What a plate shows: the caption after its first colon, else all of it."""
    return F.trim(F.when(F.contains(caption, F.lit(":")), F.regexp_extract(caption, r"^[^:]*:(.*)$", 1)).otherwise(caption))


def plate_facts(chunks: DataFrame, figures: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts, as of ``facts.extract``, that figure plates of current documents print beside their labels; names as the entities spell them."""
    current = documents.filter("superseded_by IS NULL").select("document_id", "reliability")
    plates = chunks.filter("content_type = 'figure'").join(current, "document_id").withColumn("figure_id", F.get("figure_ids", F.lit(0)))
    plates = plates.join(figures.select("figure_id", F.col("caption").alias("said")).dropDuplicates(["figure_id"]), "figure_id", "left")
    caption = F.coalesce(F.nullif(F.col("said"), F.lit("")), F.split("content", "\n")[0])
    plates = plates.withColumn("caption", caption).withColumn("shown", caption_subject(F.col("caption"))).withColumn("subject_id", C.entity_id(F.col("shown"))).filter("subject_id != ''")
    read = plate_values(plates.withColumn("words", F.concat_ws(" ", "caption", "content")), "chunk_id", "words")
    named = plates.join(read, "chunk_id").join(entities.select(F.col("entity_id").alias("subject_id"), "name"), "subject_id", "left")
    return named.select(
        "subject_id", C.display_name(F.coalesce("name", "shown")).alias("subject_name"), "attribute", F.col("value").alias("value_text"), C.value_key(F.col("value")).alias("value_key"),
        C.numeric_value(F.col("value")).alias("value_number"), "document_id", "chunk_id", F.col("page_start").alias("page"), "source_class", "reliability", F.struct("document_id", "chunk_id", F.lit(0).alias("line")).alias("ord"),
    )


def plate_values(plates: DataFrame, key: str, text: str) -> DataFrame:
    """key, attribute, value: numbers printed after a plate's labels; charts, whose numbers are scales, give none."""
    labels = sorted(vocab.PLATE_LABELS.items(), key=lambda x: -len(x[0]))
    read = [F.struct(F.lit(a).alias("attribute"), F.regexp_extract(text, rf"(?i){label}[^\d]{{0,40}}?(\d[\d,]*)", 1).alias("value")) for label, a in labels]
    plain = plates.filter(F.size(F.regexp_extract_all(text, F.lit(vocab.CHART_LEGEND), 1)) < 2)
    rows = plain.select(key, F.posexplode(F.array(*read)).alias("nth", "r")).filter("r.value != ''")
    return rows.groupBy(key, F.col("r.attribute").alias("attribute")).agg(F.min_by("r.value", "nth").alias("value"))
