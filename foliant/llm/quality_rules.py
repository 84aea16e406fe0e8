"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is an expression over the text, every rule a range on a measure, and
``compile_rules`` folds the table into a single ``select``: no joins, no shuffles and no
user functions, so the operator streams at scan speed at any size.

Defined results: null and empty texts have no words, count 0 everywhere and fail the base
rule; repeated rows and ties are judged row by row; an empty table gives an empty result;
extra columns, whatever their names, are neither read nor returned by ``measure``, and
``keep_good`` returns the input's columns unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.text import SPACES, WORD, let

WINDOW = 8

#: Function words of the four languages the rules know.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "dans", "pour", "du", "en",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "ein", "eine", "im", "nicht",
    "el", "los", "las", "y", "una", "por", "con", "para", "del", "se", "su",
)


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` must hold; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table of production.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_ratio", 0.04, None),
    Rule("stutter_ratio", None, 0.3),
    Rule("dup_line_ratio", None, 0.5),
    Rule("capital_ratio", None, 0.4),
    Rule("shout_ratio", None, 0.3),
)


def _shifted(values: Column, by: int, body) -> Column:
    """``body(v[i], v[i + by])`` for every i that has both."""
    size = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, 1, size), F.slice(values, by + 1, size), body)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more.

    Windows are compared by 64-bit hashes, built by doubling (pairs, fours, eights).  Sorting
    (hash, place) pairs puts equal windows side by side; the places of those with an equal
    neighbour, sorted again, cover min(8, gap) words each.
    """

    def places(pairs: Column) -> Column:
        size = F.size(pairs)
        null = F.array(F.lit(None).cast("bigint"))
        left = F.concat(null, F.slice(pairs["h"], 1, size - 1))
        right = F.concat(F.slice(pairs["h"], 2, size), null)
        beside = F.arrays_zip(pairs["h"].alias("h"), pairs["i"].alias("i"), left.alias("l"), right.alias("r"))
        marked = F.filter(beside, lambda z: F.coalesce(z["h"] == z["l"], F.lit(False)) | F.coalesce(z["h"] == z["r"], F.lit(False)))
        return F.sort_array(F.transform(marked, lambda z: z["i"]))

    def covered(at: Column) -> Column:
        nexts = F.concat(F.slice(at, 2, F.size(at)), F.array(F.element_at(at, -1) + WINDOW))
        return F.aggregate(F.zip_with(at, nexts, lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda acc, x: acc + x)

    def total(h: Column) -> Column:
        repeated = F.size(F.array_distinct(h)) < F.size(h)
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(repeated, let(let(pairs, places), covered)).otherwise(F.lit(0))

    both = lambda x, y: F.xxhash64(x, y)
    eights = let(let(_shifted(hashes, 1, both), lambda p: _shifted(p, 2, both)), lambda q: _shifted(q, 4, both))
    return let(eights, total).cast("bigint")


def measures(text: Column) -> dict[str, Column]:
    """Counts over one text, as closed expressions that share the split into words or lines."""
    body = F.coalesce(text, F.lit(""))
    found = F.filter(F.split(body, SPACES), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    stop = [w + end for w in (*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)) for end in ("", ",", ".")]
    count = lambda array: F.size(array).cast("bigint")
    without = lambda what: (F.length(body) - F.length(what)).cast("bigint")
    return {
        "from_words": let(
            found,
            lambda w: F.struct(
                count(w).alias("n_words"),
                F.length(F.concat_ws("", w)).cast("bigint").alias("word_chars"),
                let(
                    F.transform(w, lambda x: F.xxhash64(x)),
                    lambda h: F.struct(
                        _repeat_words(h).alias("repeat"),
                        count(F.filter(_shifted(h, 1, lambda x, y: x == y), lambda same: same)).alias("stutter"),
                    ),
                ).alias("hashed"),
                count(F.filter(w, lambda x: x.isin(stop))).alias("n_stop_words"),
            ),
        ),
        "from_lines": let(
            lines,
            lambda x: F.struct(
                count(x).alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            ),
        ),
        "n_symbols": without(F.regexp_replace(body, r"[#*$%&|<>]", "")),
        "n_capitals": without(F.regexp_replace(body, r"[A-Z]", "")),
        "n_shouts": (without(F.replace(body, F.lit("!!"), F.lit(""))) / 2).cast("bigint"),
    }


def ratios() -> dict[str, Column]:
    """What rules may bound, over the counts; empty texts give 0 by division by at least 1."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "stutter_ratio": per("n_stutters", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "capital_ratio": per("n_capitals", "word_chars"),
        "shout_ratio": per("n_shouts", "n_words"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression over the counts."""
    verdict = F.lit(True)
    known = ratios()
    for r in rules:
        if r.low is not None:
            verdict = verdict & (known[r.measure] >= F.lit(float(r.low)))
        if r.high is not None:
            verdict = verdict & (known[r.measure] <= F.lit(float(r.high)))
    return verdict


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters", "n_stop_words", "n_capitals", "n_shouts", "n_lines")


def judged(docs: DataFrame, rules: tuple[Rule, ...], carry: list[str]) -> DataFrame:
    """``carry`` columns as struct ``row``, the counts, ``base_failed`` and ``kept``."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *[c.alias(n) for n, c in measures(F.col("text")).items()])
    at = {"n_repeat_words": "from_words.hashed.repeat", "n_stutters": "from_words.hashed.stutter"}
    at |= {c: f"from_words.{c}" for c in ("n_words", "word_chars", "n_stop_words")} | {c: f"from_lines.{c}" for c in ("n_lines", "n_dup_lines")}
    out = found.select("row", *[F.col(at.get(c, c)).alias(c) for c in COUNTS])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id with every count, ``base_failed`` and ``kept``."""
    return judged(docs, rules, ["doc_id"]).select("row.doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came."""
    return judged(docs, rules, docs.columns).filter("kept").select("row.*")
