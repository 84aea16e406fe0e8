"""Evidence: excerpts, claim gates, run status, graph paths, evaluation, operation cues and entity matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab


def unmarked(text: Column) -> Column:
    """Links as their targets, without emphasis marks, spaces as one."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[\[([^\]]+)\]\]", "$1"), r"[*_`]{1,3}", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def shortened(text: Column) -> Column:
    return F.when(F.length(text) <= vocab.EXCERPT, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, vocab.EXCERPT - 1)), F.lit("…")))


def excerpt(content: Column, value: Column, subject: Column | None = None) -> Column:
    """The shortest table line that holds a value; else the first sentence that does; else what stands around it; else the
    first sentence about the subject; else nothing."""
    holds = lambda x: C.mentions(x, value)
    lines = F.filter(F.split(content, "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"(?i)^\s*columns\s*:") & holds(x))
    rows = F.transform(lines, lambda x: F.btrim(F.regexp_replace(unmarked(F.btrim(F.trim(x), F.lit("|"))), r"\s*\|\s*", " — "), F.lit(" —")))
    rows = F.filter(rows, lambda x: ~C.fold(x).isin("", "field value", "columns field value"))
    shortest = F.get(F.array_sort(F.transform(rows, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), F.lit(0))["x"]
    plain = unmarked(content)
    first = lambda of: F.trim(F.get(F.filter(F.split(plain, r"(?<=[.!?])\s+"), of), F.lit(0)))
    at = F.instr(C.fold(plain), C.fold(value)) - 1
    start = F.greatest(F.lit(0), at - 80)
    window = F.when(at >= 0, F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(plain, start + 1, at - start + F.length(value) + 120))))
    about = [first(lambda x: C.mentions(x, subject))] if subject is not None else []
    found = shortened(F.coalesce(shortest, first(holds), window, *about, F.lit("")))
    return F.when(C.fold(value) == "", F.lit("")).otherwise(F.coalesce(found, F.lit("")))


def gated(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims (claim_id, evidence_id, subject, value) with ``kept`` and ``reason``: the passage must be known and hold both."""
    met = claims.join(passages.select("evidence_id", "content"), "evidence_id", "left")
    reason = F.when(F.col("content").isNull(), "unknown evidence").when(~C.mentions(F.col("content"), F.col("subject")), "subject not in passage").when(~C.mentions(F.col("content"), F.col("value")), "value not in passage")
    return met.select("claim_id", "evidence_id", reason.isNull().alias("kept"), reason.alias("reason"))


def status(stop: Column, supported: Column, unmet: Column, visual_gaps: Column, rate_limited: Column, unresolved: Column, unevidenced: Column) -> Column:
    """The verdict on a run, first rule that applies."""
    budget = stop.isin("iteration_budget", "query_budget", "time_budget")
    return (
        F.when(stop == "no_entity", "no_entity")
        .when((supported == 0) & (visual_gaps > 0), "partial_visual").when((supported == 0) & budget, "partial_budget").when((supported == 0) & (rate_limited > 0), "partial_rate_limited").when(supported == 0, "insufficient_evidence")
        .when(budget, "partial_budget").when((unmet > 0) & (rate_limited > 0), "partial_rate_limited").when(unmet > 0, "partial_no_progress")
        .when(unresolved > 0, "unresolved_conflict").when(visual_gaps > 0, "partial_visual").when(unevidenced > 0, "partial_no_progress").otherwise("completed")
    )


def collapsed_path(steps: DataFrame, group: str, order: str, node: str) -> DataFrame:
    """Per group the nodes in order, equal neighbours as one."""
    w = Window.partitionBy(group).orderBy(order)
    fresh = steps.withColumn("before", F.lag(node).over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col(node)))
    return fresh.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(node).alias("n")))), lambda x: x["n"]), " > ").alias("path"))


def judged(answers: DataFrame) -> DataFrame:
    """Answers (answer, expect, status, expect_none) with ``passed``: containment without digit commas, or a refusal."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"(\d),(\d)", "$1$2"))
    refusal = F.col("status").isin("no_entity", "insufficient_evidence", "partial_visual", "partial_no_progress")
    return answers.withColumn("passed", F.when(F.col("expect_none"), refusal).otherwise(F.coalesce(F.contains(plain(F.col("answer")), plain(F.col("expect"))), F.lit(False))))


def evaluation(rows: DataFrame) -> DataFrame:
    """category, status, n, passed with subtotals."""
    return rows.rollup("category", "status").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.grouping_id().alias("level"))


def failure_stage(rows: DataFrame) -> DataFrame:
    """Where a missed question (understood, stored, cited, retrieved: boolean) went wrong."""
    stage = F.when(~F.col("understood"), "UNDERSTANDING").when(~F.col("stored"), "INGESTION").when(F.col("retrieved") & ~F.col("cited"), "VERIFICATION").otherwise("RETRIEVAL")
    return rows.withColumn("stage", stage)


def entity_matches(questions: DataFrame, names: DataFrame, text: str = "question") -> DataFrame:
    """question_id, name, at: dictionary names of any length in texts, the longest first, then the leftmost, none over another.

    A name meets a text by its rarest word (counted over all names, so that "the" anchors a name only where it has nothing else) and is
    then compared where that word puts it."""
    cut = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    parts = names.select(cut(F.col("name")).alias("parts")).filter(F.size("parts") > 0).distinct()
    each = parts.select("parts", F.posexplode("parts").alias("off", "word"))
    anchored = each.join(each.groupBy("word").agg(F.count("*").alias("held")), "word").groupBy("parts").agg(F.min_by(F.struct("word", "off"), F.struct("held", "off")).alias("a")).select("parts", "a.word", "a.off")
    rows = questions.select("question_id", cut(F.col(text)).alias("w"))
    met = rows.select("question_id", "w", F.posexplode("w").alias("place", "word")).join(anchored, "word").withColumn("at", F.col("place") - F.col("off") + 1)
    n = F.size("parts")
    hits = met.filter((F.col("at") > 0) & (F.slice("w", F.greatest("at", F.lit(1)), n) == F.col("parts")))
    found = hits.groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct((-n).alias("less"), "at", F.array_join("parts", " ").alias("name")))).alias("found"))
    over = lambda x, y: (x["at"] < y["at"] - y["less"]) & (y["at"] < x["at"] - x["less"])
    kept = F.reduce("found", F.slice("found", 1, 0), lambda held, x: F.when(F.exists(held, lambda y: over(x, y)), held).otherwise(F.concat(held, F.array(x))))
    return found.select("question_id", F.explode(kept).alias("k")).select("question_id", "k.name", F.col("k.at").cast("int").alias("at"))
