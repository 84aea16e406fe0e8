"""Column functions: normal forms, values, dates, scores.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import vocab

WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def choose(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """``table[value]`` for a fixed table of at most a few dozen entries."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]
    return found if default is None else F.coalesce(found, default)


# names and links


def entity_id(name: Column) -> Column:
    bare = F.regexp_replace(F.trim(name), r"\s*\([^)]*\)\s*$", "")
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(bare, r"(?U)[^\w]+", " "))), r"\s+", "_")


def display_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), r"\s*\([^)]*\)\s*$", ""))


def type_hint(name: Column) -> Column:
    return choose(F.lower(F.trim(F.regexp_extract(F.trim(name), r"\(([^)]*)\)\s*$", 1))), vocab.TYPE_HINTS, F.lit("unknown"))


def wikilinks(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), 1), lambda x: F.trim(x)))


def fold(text: Column) -> Column:
    """Lower-case letters and digits, one space between runs of them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def mentions(text: Column, name: Column) -> Column:
    return F.contains(fold(text), fold(name))


def alike(a: Column, b: Column) -> Column:
    """Whether two names are one but for case and punctuation, or one holds the other."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")
    x, y = bare(a), bare(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


# ids and provenance


def document_id(path: Column, size: Column, file_hash: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat_ws("|", F.lower(path), size.cast("string"), F.substring(file_hash, 1, 12)), 256), 1, 16))


def chunk_id(document: Column, page: Column, section: Column, nth: Column) -> Column:
    pages = F.when(page.isNull(), F.lit("pxxx")).otherwise(F.concat(F.lit("p"), F.lpad(page.cast("string"), 4, "0")))
    return F.concat(document, F.lit("-"), pages, F.lit("-s"), F.lpad(section.cast("string"), 2, "0"), F.lit("-c"), F.lpad(nth.cast("string"), 3, "0"))


def source_format(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ends = F.when(name.endswith(".scan.pdf"), "pdf_scan").when(name.endswith(".pdf"), "pdf").when(name.endswith(".docx"), "docx")
    ends = ends.when(name.endswith(".md") | name.endswith(".markdown"), "markdown").when(name.endswith(".txt"), "text")
    return ends.when(F.element_at(F.split(name, r"\."), -1).isin(*vocab.IMAGE_SUFFIXES), "image")


def source_class(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name, top = F.element_at(parts, -1), parts[0]
    out = F.when(F.array_contains(parts, "images"), "figure_plate")
    for folder, kind in vocab.TOP_FOLDERS.items():
        out = out.when(top == folder, kind)
    for prefix, kind in vocab.EPHEMERA_CLASSES.items():
        out = out.when((top == "ephemera") & name.startswith(prefix), kind)
    return out.otherwise("unknown")


def reliability(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.RELIABILITY.items() for x in pair])
    return F.coalesce(table[kind], F.lit(vocab.RELIABILITY["unknown"]))


def title(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)(\.scan)?\.[^.]+$", "")
    return F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))


# values


def attribute(label: Column) -> Column:
    """The attribute that a table label names; null for labels that name none."""
    clean = F.trim(F.regexp_replace(F.trim(label), r"^[|*]+|[|*]+$", ""))
    low = F.lower(clean)
    snake = F.nullif(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(""))
    known = choose(low, vocab.ATTRIBUTES)
    return F.when(clean.rlike(r"(?i)^columns\s*:"), None).when(clean.rlike(r"(?i)^\d{1,4}\s*AS$"), "timeline_event").when(low.isin("", *vocab.SKIP_LABELS), None).otherwise(F.coalesce(known, snake))


def clean_value(raw: Column) -> Column:
    plain = F.replace(F.replace(F.regexp_replace(raw, WIKILINK, "$1"), F.lit("**"), F.lit("")), F.lit("|"), F.lit(" "))
    return F.trim(F.regexp_replace(F.btrim(plain, F.lit(" .;")), r"\s+", " "))


def value_key(value: Column) -> Column:
    joined = F.regexp_replace(F.regexp_replace(F.lower(value), r"(\d),(\d)", "$1$2"), r"(\d),(\d)", "$1$2")
    key = F.regexp_replace(F.trim(F.regexp_replace(joined, r"[^a-z0-9]+", " ")), r"^(the|a|an)\s+", "")
    units = "|".join(vocab.UNIT_NOUNS)
    for _ in range(2):
        key = F.regexp_replace(key, rf"\s+({units})$", "")
    return F.trim(key)


def parse_year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(\d{1,4})\s*AS\b", 1).try_cast("int")


def all_years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(\d{1,4})\s*AS\b"), 1), lambda y: y.cast("int"))


def numeric_value(value: Column) -> Column:
    year = F.regexp_extract(value, r"(?i)\b(\d{1,4})\s*AS\b", 1).try_cast("double")
    bare = F.trim(F.replace(value, F.lit(","), F.lit("")))
    return F.coalesce(year, F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare.try_cast("double")))


def dated_places(value: Column) -> Column:
    """Structs (place, year) of each part of a value that says where and when."""
    parts = F.split(value, r"\s*;\s*")
    dated = F.transform(parts, lambda p: F.struct(
        F.trim(F.regexp_replace(F.regexp_extract(p, r"(?i)([^;,]*?)\s+(?:in|since|at|during)\s+(\d{1,4})\s*AS\b", 1), r"(?i)^\s*(?:devastated|waged(?:\s+at)?|fought(?:\s+at)?|wields?|held|besieged|destroyed|razed|sacked|founded|forged)\s+", "")).alias("place"),
        F.regexp_extract(p, r"(?i)([^;,]*?)\s+(?:in|since|at|during)\s+(\d{1,4})\s*AS\b", 2).try_cast("int").alias("year"),
    ))
    return F.filter(dated, lambda d: d["year"].isNotNull() & (d["place"] != ""))


def hop_targets(value: Column) -> Column:
    """Entity ids that a value names, parts split at ``;`` without their dates."""
    return F.filter(F.transform(F.split(value, r"\s*;\s*"), lambda p: entity_id(F.btrim(F.regexp_replace(p, r"(?i)\s+in\s+\d{1,4}\s*AS.*$", ""), F.lit(" .,;")))), lambda x: x != "")


# blocks


def is_heading(text: Column) -> Column:
    t = F.trim(text)
    found = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(found, lambda w: w.rlike(r"^\p{Lu}")))
    return (t != "") & (F.length(t) <= 80) & ~F.contains(t, F.lit("\n")) & ~t.rlike(r"[.,;:?!]$") & F.size(found).between(1, 10) & (capital >= F.greatest(F.lit(1), F.size(found) - 2))


def row_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def table_text(caption: Column, columns: Column, rows: Column) -> Column:
    lines = F.transform(rows, lambda r: F.array_join(r, " | "))
    return F.array_join(F.concat(F.array(caption, F.concat(F.lit("Columns: "), F.array_join(columns, " | "))), lines), "\n")


# arithmetic and scores


def calculation(kind: Column, a: Column, b: Column) -> Column:
    of = {"percentage": F.try_divide(a * 100, b), "ratio": F.try_divide(a, b), "difference": a - b, "average": (a + b) / 2, "total": a + b}
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, value in of.items():
        out = out.when(kind == name, value)
    return out


def format_result(kind: Column, result: Column) -> Column:
    ratio = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", result), r"0+$", ""), r"\.$", "")
    whole = F.abs(result - F.round(result)) < 1e-9
    return F.when(kind == "percentage", F.concat(F.format_string("%.2f", result), F.lit("%"))).when(kind == "ratio", ratio).when(whole, F.format_number(F.round(result), 0)).otherwise(F.format_number(result, 2))


def confidence(best: Column, documents: Column, hops: Column, conflicting: Column) -> Column:
    base = F.least(best, F.lit(0.92)) + F.least((documents - 1) * 0.04, F.lit(0.08)) - hops * 0.12
    return F.when(documents < 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.when(conflicting, F.least(base, F.lit(0.55))).otherwise(base))))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.80, "high").when(score >= 0.55, "medium").when(score > 0, "low").otherwise("none")
