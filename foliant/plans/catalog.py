"""Named queries over the star-schema tables, one for each relational operator, with DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab
from foliant.operators import chunking, evidence, facts, graph, inverted, lexical, prose, reasoning, temporal, vector
from foliant.plans import language, operations
from foliant.plans import views as V
from foliant.session import ship
from foliant.sources import archive, gateway, parsers, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL fragments

TIER_CASE = "(CASE source_class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.RELIABILITY.items()) + " ELSE 0.5 END)::DOUBLE"
TIER_LIST = "[" + ", ".join(f"'{t}'" for t in V.TIERS) + "]"
SOURCE_TIER = f"coalesce({TIER_LIST}[TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) AS INT) % {len(V.TIERS)} + 1], 'unknown')"
UNITS = "|".join(vocab.UNIT_NOUNS)


def key_sql(c: str) -> str:
    joined = rf"regexp_replace(regexp_replace(lower({c}), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g')"
    key = rf"regexp_replace(trim(regexp_replace({joined}, '[^a-z0-9]+', ' ', 'g')), '^(the|a|an)\s+', '')"
    return rf"trim(regexp_replace(regexp_replace({key}, '\s+({UNITS})$', ''), '\s+({UNITS})$', ''))"


def id_sql(c: str) -> str:
    return rf"regexp_replace(trim(lower(regexp_replace(regexp_replace(trim({c}), '\s*\([^)]*\)\s*$', ''), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))), '\s+', '_', 'g')"


def fold_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


CLAIMS = f"""claims AS (SELECT *, {TIER_CASE} AS reliability FROM (SELECT 'customer_' || o_custkey AS subject_id, 'order_priority' AS attribute, o_orderpriority AS value_text, {key_sql("o_orderpriority")} AS value_key,
  'doc-' || o_orderkey AS document_id, 'doc-' || (o_orderkey % 7) AS chunk_id, CASE o_orderstatus WHEN 'F' THEN 'codex' WHEN 'O' THEN 'wiki' ELSE 'ballad' END AS source_class, year(o_orderdate)::INT AS year, o_orderkey AS ord, o_totalprice AS value_number FROM orders))"""
GROUPS = CLAIMS + """, groups AS (SELECT subject_id, attribute, value_key, max(reliability) AS reliability, count(DISTINCT document_id) AS documents, count(*) AS n, min(ord) AS ord FROM claims GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id, attribute ORDER BY reliability DESC, documents DESC, n DESC, ord) AS rank, count(*) OVER (PARTITION BY subject_id, attribute) AS vals FROM groups)"""
EDGES = f"""nat AS (SELECT n_nationkey, n_regionkey, {id_sql("n_name")} AS nation_id FROM nation),
edges AS (SELECT 'customer_' || c_custkey AS subject_id, 'located_in' AS predicate, nation_id AS object_id, 'infobox' AS method, 0.9::DOUBLE AS confidence FROM customer JOIN nat ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier_' || s_suppkey, 'located_in', nation_id, 'infobox', 0.9 FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT nation_id, 'located_in', {id_sql("r_name")}, 'infobox', 0.9 FROM nat JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'part_' || l_partkey, 'related_to', 'supplier_' || l_suppkey, 'wikilink', 0.6 FROM lineitem)"""
ATTRS = """attrs AS (SELECT 'part_' || p_partkey AS subject_id, attribute, value_text FROM (SELECT p_partkey, p_brand, p_type, p_size::VARCHAR AS p_size FROM part) UNPIVOT (value_text FOR attribute IN (p_brand, p_type, p_size))
  UNION ALL SELECT 'customer_' || c_custkey, 'c_mktsegment', c_mktsegment FROM customer)"""
CHUNKS = f"""chunks AS (SELECT *, {TIER_CASE} AS reliability FROM (SELECT doc_id, {SOURCE_TIER} AS source_class, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::INT - 1 AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS content FROM documents) WHERE trim(content) <> '')"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# sources and identity


@query("store_stats", "SELECT count(*) AS documents, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS blank, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM embeddings) AS vectors FROM documents")
def store_stats(spark, sf):
    d = V.table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    one = lambda t, c: V.table(spark, sf, t).agg(F.count("*").alias(c))
    return d.join(one("pages", "pages")).join(one("embeddings", "vectors"))


@query("document_ids", "SELECT doc_id, 'doc-' || substr(sha256('documents/' || doc_id || '.txt|' || strlen(coalesce(text, '')) || '|' || substr(sha256(coalesce(text, '')), 1, 12)), 1, 16) AS document_id FROM documents")
def document_ids(spark, sf):
    text = F.coalesce("text", F.lit(""))
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", C.document_id(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.octet_length(text), F.sha2(text, 256)).alias("document_id"))


@query("chunk_ids", "SELECT conv_id, turn, printf('conv-%d-pxxx-s%02d-c%03d', conv_id, turn // 10, turn) AS chunk_id FROM conversations")
def chunk_ids(spark, sf):
    t = V.table(spark, sf, "conversations")
    return t.select("conv_id", "turn", C.chunk_id(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.lit(None).cast("int"), F.expr("turn div 10"), F.col("turn")).alias("chunk_id"))


#: Documents as files whose names differ by format alone, three to a stem.
FILES = "f AS (SELECT 'd' || doc_id AS document_id, 'wiki/f' || (doc_id // 3) || ['.txt', '.scan.pdf', '.md'][doc_id % 3 + 1] AS relative_path, CASE WHEN doc_id % 3 = 1 THEN 1 WHEN doc_id % 3 = 2 THEN 3 ELSE 4 END AS rank, doc_id // 3 AS stem FROM documents)"


@query("twin_resolution", f"WITH {FILES}, w AS (SELECT stem, arg_min(document_id, (rank, relative_path)) AS winner FROM f GROUP BY stem HAVING count(*) > 1) SELECT document_id, winner AS superseded_by FROM f JOIN w USING (stem) WHERE document_id <> winner")
def twin_resolution(spark, sf):
    return archive.twins(V.files(spark, sf))


@query("source_reliability", f"SELECT source_class, {TIER_CASE}::DOUBLE AS reliability, count(*) AS documents FROM (SELECT {SOURCE_TIER} AS source_class FROM documents) GROUP BY source_class")
def source_reliability(spark, sf):
    d = V.table(spark, sf, "documents").groupBy(V.source_tier(F.col("source")).alias("source_class")).agg(F.count("*").alias("documents"))
    return d.select("source_class", C.reliability(F.col("source_class")).alias("reliability"), "documents")


@query("unchanged_anti_join", "SELECT 'd' || doc_id AS document_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) = 0")
def unchanged(spark, sf):
    """What an ingestion finds new: documents without a label, and those stored with another text, here those of quality 0."""
    found = V.files(spark, sf)
    stored = found.join(V.table(spark, sf, "labels"), "doc_id").withColumn("file_hash", F.when(F.col("quality") == 1, F.col("file_hash")).otherwise(F.lit("another")))
    return archive.unchanged(found, stored).select("document_id")


@query("ingest_report", "WITH d AS (SELECT *, 'd' || doc_id AS document_id, coalesce(quality, -1) AS q FROM documents LEFT JOIN labels USING (doc_id)) SELECT count(*) AS discovered, 0::BIGINT AS superseded, count(*) FILTER (WHERE q >= 0) AS ingested, count(*) FILTER (WHERE q = 0) AS failed, coalesce(sum(len(string_split(coalesce(text, ''), chr(10)))) FILTER (WHERE q = 1), 0)::BIGINT AS chunks, 0::BIGINT AS tables, 0::BIGINT AS figures, count(*) FILTER (WHERE q = 0 AND doc_id % 2 = 0) AS pages_needing_ocr, count(*) FILTER (WHERE q = 0) AS errors, count(*) FILTER (WHERE q < 0) AS unchanged FROM d")
def ingest_report(spark, sf):
    """The report of a run that parsed the labelled documents, of which those of quality 0 failed."""
    found = V.files(spark, sf).withColumn("superseded_by", F.lit(None).cast("string"))
    met = found.join(V.table(spark, sf, "labels"), "doc_id", "left")
    none, bad = F.array().cast("array<string>"), F.col("quality") == 0
    said = F.when(bad, F.array(F.when(F.col("doc_id") % 2 == 0, "no OCR is available").otherwise("no parser"))).otherwise(none)
    done = met.filter("quality IS NOT NULL").select("document_id", F.when(bad, none).otherwise(F.split(F.coalesce("text", F.lit("")), "\n")).alias("chunks"), none.alias("tables"), none.alias("figures"), said.alias("warnings"))
    return archive.report(found, found, done, met.filter("quality IS NULL"))


# blocks and links

HREF = 'href="([^"]*)"'


@query("link_extract", f"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{HREF}', 1))) AS link FROM pages")
def link_extract(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("link"))


@query("link_edges", f"SELECT link AS raw, count(DISTINCT page_id) AS sources, max(page_id)::INT AS last_page FROM (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM pages) WHERE link <> '' AND NOT contains(link, '|') AND NOT contains(link, ']') GROUP BY link")
def link_edges(spark, sf):
    """Pages as chunks whose links are written the archive's way."""
    links = F.filter(F.regexp_extract_all("html", F.lit(HREF), 1), lambda x: (x != "") & ~F.contains(x, F.lit("|")) & ~F.contains(x, F.lit("]")))
    content = F.array_join(F.transform(links, lambda x: F.concat(F.lit("see [["), x, F.lit("|there]]"))), " ")
    page = F.col("page_id").cast("string")
    base = V.table(spark, sf, "pages").select(F.concat(F.lit("Page "), page).alias("subject_name"), page.alias("chunk_id"), page.alias("document_id"), F.col("page_id").cast("int").alias("page_start"), content.alias("content"))
    return graph.link_edges(base).groupBy("raw").agg(F.countDistinct("chunk_id").alias("sources"), F.max("page").alias("last_page"))


@query("wikilinks", r"SELECT item_id, trim(regexp_extract(t, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) AS first_link FROM (SELECT item_id, '[[' || text || '|alias]] and [[' || item_id || ']]' AS t FROM benchmark)")
def wikilinks(spark, sf):
    t = F.concat(F.lit("[["), F.col("text"), F.lit("|alias]] and [["), F.col("item_id").cast("string"), F.lit("]]"))
    return V.table(spark, sf, "benchmark").select("item_id", C.wikilinks(t)[0].alias("first_link"))


HEADING_SQL = r"""trim(content) <> '' AND length(trim(content)) <= 80 AND NOT regexp_matches(trim(content), '[.,;:?!]$') AND len(w) BETWEEN 1 AND 10 AND len([x FOR x IN w IF regexp_matches(x, '^\p{Lu}')]) >= greatest(1, len(w) - 2)"""


@query("heading_heuristic", f"WITH {CHUNKS}, ws AS (SELECT *, [x FOR x IN regexp_split_to_array(trim(content), '\\s+') IF x <> ''] AS w FROM chunks) SELECT doc_id, line, content FROM ws WHERE {HEADING_SQL}")
def heading_heuristic(spark, sf):
    return V.chunks(spark, sf).filter(C.is_heading(F.col("content"))).select("doc_id", "line", "content")


@query("stanza_blocks", r"WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS content FROM documents), s AS (SELECT *, sum(CASE WHEN regexp_matches(content, '[^\s]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS stanza FROM l), b AS (SELECT doc_id, min(line) AS line_start, max(line) AS line_end, count(*) AS lines FROM s WHERE regexp_matches(content, '[^\s]') GROUP BY doc_id, stanza) SELECT doc_id, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM b")
def stanza_blocks(spark, sf):
    """The blocks of the plain text parser."""

    def run(batches):
        for batch in batches:
            found = [(doc, b["line_start"], b["line_end"]) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for b in parsers.plain_text((text or "").encode(), str(doc)).blocks]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], names=["doc_id", "line_start", "line_end"])

    ship(spark)
    return V.table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, line_start bigint, line_end bigint")


@query("table_text", "SELECT n_regionkey, 'nations of region ' || n_regionkey || chr(10) || 'Columns: key | name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS table_text FROM nation GROUP BY n_regionkey")
def table_text(spark, sf):
    rows = V.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.select("n_regionkey", C.table_text(F.concat(F.lit("nations of region "), F.col("n_regionkey").cast("string")), F.array(F.lit("key"), F.lit("name")), cells).alias("table_text"))


ROW_SQL = r"'^\s*([^|]{1,60}?)\s*\|\s*(.+?)\s*$'"
KV = f"{CHUNKS}, kv AS (SELECT doc_id, line, regexp_extract(content, {ROW_SQL}, 1) AS label, regexp_extract(content, {ROW_SQL}, 2) AS value FROM chunks)"


@query("kv_rows", f"WITH {KV} SELECT * FROM kv WHERE label <> ''")
def kv_rows(spark, sf):
    return V.chunks(spark, sf).select("doc_id", "line", F.regexp_extract("content", facts.ROW, 1).alias("label"), F.regexp_extract("content", facts.ROW, 2).alias("value")).filter("label != ''")


ALIAS_SQL = "CASE low " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.ATTRIBUTES.items()) + " END"
ATTRIBUTE_SQL = rf"CASE WHEN regexp_matches(clean, '(?i)^columns\s*:') THEN NULL WHEN regexp_matches(clean, '(?i)^\d{{1,4}}\s*AS$') THEN 'timeline_event' WHEN low IN ({', '.join(repr(x) for x in ('', *vocab.SKIP_LABELS))}) THEN NULL ELSE coalesce({ALIAS_SQL}, nullif(regexp_replace(regexp_replace(low, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')) END"


@query("attribute_canonical", rf"WITH {KV}, labels AS (SELECT DISTINCT label FROM kv WHERE label <> '' UNION SELECT unnest([{', '.join(repr(x) for x in (*vocab.ATTRIBUTES, 'Columns: a', '225 AS', 'Field', 'Odd Label!'))}])), l AS (SELECT label, trim(regexp_replace(trim(label), '^[|*]+|[|*]+$', '', 'g')) AS clean, lower(trim(regexp_replace(trim(label), '^[|*]+|[|*]+$', '', 'g'))) AS low FROM labels) SELECT label, {ATTRIBUTE_SQL} AS attribute FROM l")
def attribute_canonical(spark, sf):
    fixed = spark.createDataFrame([(x,) for x in (*vocab.ATTRIBUTES, "Columns: a", "225 AS", "Field", "Odd Label!")], "label string")
    return kv_rows(spark, sf).select("label").union(fixed).distinct().select("label", C.attribute(F.col("label")).alias("attribute"))


SAMPLES = ("The Gloaming Reach", "gloaming reach", "3,107 troops", "1,234,567", "235 AS", "-4.5", "Contested; no year is stated", "5805 souls under arms", "An Oath", "1,,2", "Greyfell in 337 AS; Palewell in 338 AS", "")


@query("value_keys", f"WITH v AS (SELECT unnest([{', '.join(repr(x) for x in SAMPLES)}]) AS value UNION SELECT p_type FROM part UNION SELECT o_orderpriority FROM orders) SELECT value, {key_sql('value')} AS value_key FROM v")
def value_keys(spark, sf):
    v = spark.createDataFrame([(x,) for x in SAMPLES], "value string").union(V.table(spark, sf, "part").select("p_type")).union(V.table(spark, sf, "orders").select("o_orderpriority")).distinct()
    return v.select("value", C.value_key(F.col("value")).alias("value_key"))


@query("numeric_values", rf"WITH v AS (SELECT unnest([{', '.join(repr(x) for x in SAMPLES)}]) AS value UNION SELECT (c_acctbal::DECIMAL(12,2))::VARCHAR FROM customer) SELECT value, coalesce(TRY_CAST(regexp_extract(value, '(?i)\b(\d{{1,4}})\s*AS\b', 1) AS DOUBLE), CASE WHEN regexp_matches(trim(replace(value, ',', '')), '^-?\d+(\.\d+)?$') THEN TRY_CAST(trim(replace(value, ',', '')) AS DOUBLE) END) AS number FROM v")
def numeric_values(spark, sf):
    v = spark.createDataFrame([(x,) for x in SAMPLES], "value string").union(V.table(spark, sf, "customer").select(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))).distinct()
    return v.select("value", C.numeric_value(F.col("value")).alias("number"))


TURNS = "t AS (SELECT conv_id, turn, trim(coalesce(text, ''), chr(10) || chr(9) || chr(13) || chr(11) || chr(12) || ' ') AS body FROM conversations)"


@query("chunk_offsets", f"WITH {TURNS} SELECT conv_id, turn::INT AS page, (sum(length(body)) OVER (PARTITION BY conv_id ORDER BY turn) - length(body))::BIGINT AS char_start, (sum(length(body)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS char_end FROM t WHERE body <> ''")
def chunk_offsets(spark, sf):
    """Turns as blocks, each of which fills a chunk."""
    cut = chunking.chunked(V.turns(spark, sf), 1, 1 << 30)
    return cut.select(F.col("document_id").cast("bigint").alias("conv_id"), F.col("page_start").alias("page"), "char_start", "char_end")


@query("page_ranges", f"WITH {TURNS} SELECT conv_id, min(turn)::INT AS page_start, max(turn)::INT AS page_end, round(min(1.0 / (2 + turn)), 3)::DOUBLE AS ocr_confidence, (sum(length(body)) + 2 * (count(*) FILTER (WHERE body <> '') - 1))::BIGINT AS chars FROM t GROUP BY conv_id")
def page_ranges(spark, sf):
    """Conversations as one chunk each: its pages, and the least confidence."""
    cut = chunking.chunked(V.turns(spark, sf), 1 << 30, 1 << 30)
    return cut.select(F.col("document_id").cast("bigint").alias("conv_id"), "page_start", "page_end", "ocr_confidence", F.length("content").cast("bigint").alias("chars"))


# entities and graph


@query("entity_normalise", f"WITH n AS (SELECT n_name || ' (location)' AS raw FROM nation UNION ALL SELECT p_name FROM part UNION ALL SELECT ' ' || r_name || ' (Creature) ' FROM region) SELECT raw, {id_sql('raw')} AS entity_id, trim(regexp_replace(trim(raw), '\\s*\\([^)]*\\)\\s*$', '')) AS name, CASE lower(trim(regexp_extract(trim(raw), '\\(([^)]*)\\)\\s*$', 1))) WHEN 'location' THEN 'place' WHEN 'creature' THEN 'creature' ELSE 'unknown' END AS kind FROM n")
def entity_normalise(spark, sf):
    n = V.table(spark, sf, "nation").select(F.concat("n_name", F.lit(" (location)")).alias("raw")).union(V.table(spark, sf, "part").select("p_name")).union(V.table(spark, sf, "region").select(F.concat(F.lit(" "), "r_name", F.lit(" (Creature) "))))
    return n.select("raw", C.entity_id(F.col("raw")).alias("entity_id"), C.display_name(F.col("raw")).alias("name"), C.type_hint(F.col("raw")).alias("kind"))


@query("entity_collect", f"WITH m AS (SELECT p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' (artifact)' ELSE '' END AS raw, p_partkey AS ord FROM part), e AS (SELECT {id_sql('raw')} AS entity_id, trim(regexp_replace(raw, '\\s*\\([^)]*\\)\\s*$', '')) AS name, CASE WHEN raw LIKE '%(artifact)' THEN 'artifact' END AS kind, ord FROM m) SELECT entity_id, arg_min(name, ord) AS name, coalesce(arg_min(kind, ord) FILTER (WHERE kind IS NOT NULL), 'unknown') AS entity_type, count(*) AS mention_count FROM e GROUP BY entity_id")
def entity_collect(spark, sf):
    p = V.table(spark, sf, "part")
    return graph.collect_entities(p.select(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, " (artifact)").otherwise("")).alias("raw"), F.col("p_partkey").alias("ord")))


BOXES = "nation JOIN region ON n_regionkey = r_regionkey"


@query("typed_edges", f"SELECT n_name AS subject_name, predicate, raw, 'infobox' AS method, 0.9::DOUBLE AS confidence FROM (SELECT n_name, 'located_in' AS predicate, r_name AS raw FROM {BOXES} UNION ALL SELECT n_name, 'ruled_by', 'House ' || n_nationkey FROM {BOXES} UNION ALL SELECT n_name, 'ruled_by', 'The ' || upper(n_name[1:1]) || lower(n_name[2:3]) || ' Court' FROM {BOXES})")
def typed_edges(spark, sf):
    """Nations as articles with an infobox: a linked region, two ruling powers of which one is plain text, and a row that is no relation."""
    n = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    court = F.concat(F.lit("The "), F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 2)), F.lit(" Court"))
    content = F.concat(F.lit("Infobox\nColumns: Field | Value\nRegion | [["), "r_name", F.lit("]]\nRuled by | [[House "), F.col("n_nationkey").cast("string"), F.lit("|the house]]; "), court, F.lit("\nGarrison | 40 men"))
    key = F.col("n_nationkey").cast("string")
    base = n.select(F.col("n_name").alias("subject_name"), key.alias("chunk_id"), key.alias("document_id"), F.lit(1).alias("page_start"), F.lit("table").alias("content_type"), content.alias("content"))
    return graph.typed_edges(base).select("subject_name", "predicate", "raw", "method", "confidence")


BOX_SQL = "SELECT p_partkey, p_size, floor(p_retailprice)::BIGINT AS price FROM part"


@query("fact_extract", f"WITH p AS ({BOX_SQL}) SELECT 'part_' || p_partkey AS subject_id, attribute, value_text, value_key, value_number, 'codex' AS source_class, 1.0::DOUBLE AS reliability FROM (SELECT p_partkey, 'threat_rating' AS attribute, p_size::VARCHAR AS value_text, p_size::VARCHAR AS value_key, p_size::DOUBLE AS value_number FROM p UNION ALL SELECT p_partkey, 'garrison_strength', price || ' troops', price::VARCHAR, NULL FROM p UNION ALL SELECT p_partkey, 'timeline_event', '225 AS Razed', '225 as razed', 225 FROM p WHERE p_partkey % 2 = 0)")
def fact_extract(spark, sf):
    """Facts of parts as articles: an infobox with a repeated row, links, labels that name no attribute, and a dated event."""
    p = V.table(spark, sf, "part").filter("p_partkey IS NOT NULL")
    key, size, price = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string")
    event = F.when(F.col("p_partkey") % 2 == 0, "\n225 AS | Razed.").otherwise("")
    content = F.concat(F.lit("Infobox\nColumns: Field | Value\nName | Part\n**Threat rating** | **"), size, F.lit("**\nThreat rating | "), size, F.lit(" .\nGarrison | [["), price, F.lit(" troops|many]]"), event)
    chunks = p.select(F.concat(F.lit("c"), key).alias("chunk_id"), key.alias("document_id"), F.lit("table").alias("content_type"), F.array(F.lit("Infobox")).alias("section_path"), F.lit(1).alias("page_start"), F.lit("codex").alias("source_class"), content.alias("content"))
    documents = p.select(key.alias("document_id"), F.concat(F.lit("Part "), key).alias("title"), F.lit(1.0).alias("reliability"), F.lit(None).cast("string").alias("superseded_by"))
    return facts.extract(chunks, documents).select("subject_id", "attribute", "value_text", "value_key", "value_number", "source_class", "reliability")


@query("plate_facts", "SELECT 'keep_' || p_partkey AS subject_id, CASE WHEN p_partkey % 2 = 0 THEN 'The Keep ' || p_partkey ELSE 'Keep ' || p_partkey END AS subject_name, 'threat_rating' AS attribute, p_size::VARCHAR AS value_text, p_size::DOUBLE AS value_number FROM part WHERE p_partkey % 3 <> 0")
def plate_facts(spark, sf):
    """Facts printed on plates; every third is a chart, which prints a scale, and every second subject has a name of its own."""
    p = V.table(spark, sf, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    caption = F.concat(F.lit("Rating plate: Keep "), key)
    chunks = p.select(F.concat(F.lit("c"), key).alias("chunk_id"), key.alias("document_id"), F.lit("figure").alias("content_type"), F.array(F.concat(F.lit("f"), key)).alias("figure_ids"), F.lit(1).alias("page_start"), F.lit("figure_plate").alias("source_class"), F.concat(caption, F.lit("\nThreat rating: "), size, F.when(F.col("p_partkey") % 3 == 0, " minimum standard").otherwise("")).alias("content"))
    figures_ = p.select(F.concat(F.lit("f"), key).alias("figure_id"), caption.alias("caption"))
    documents = p.select(key.alias("document_id"), F.lit(0.95).alias("reliability"), F.lit(None).cast("string").alias("superseded_by"))
    named = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("keep_"), key).alias("entity_id"), F.concat(F.lit("The Keep "), key).alias("name"))
    return prose.plate_facts(chunks, figures_, documents, named).select("subject_id", "subject_name", "attribute", "value_text", "value_number")


@query("neighbours", f"WITH {EDGES}, nodes AS (SELECT nation_id AS node FROM nat) SELECT node, direction, predicate, count(*) AS n, max(confidence) AS confidence FROM (SELECT subject_id AS node, 'out' AS direction, * FROM edges UNION ALL SELECT object_id, 'in', * FROM edges) WHERE node IN (SELECT node FROM nodes) GROUP BY ALL")
def neighbours(spark, sf):
    nodes = V.table(spark, sf, "nation").select(C.entity_id(F.col("n_name")).alias("node"))
    return graph.neighbours(V.edges(spark, sf), nodes).groupBy("node", "direction", "predicate").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@query("two_hop", f"WITH {EDGES} SELECT s.subject_id AS start, r.object_id AS node FROM edges s JOIN edges r ON s.object_id = r.subject_id WHERE s.subject_id LIKE 'supplier\\_%' ESCAPE '\\' AND s.predicate = 'located_in' AND r.predicate = 'located_in'")
def two_hop(spark, sf):
    located = V.edges(spark, sf).filter("predicate = 'located_in'")
    starts = located.filter(F.col("subject_id").startswith("supplier_")).select(F.col("subject_id").alias("node"))
    return graph.walk(located, starts, 2).filter("hops = 2").select("start", "node")


@query("k_hop", f"WITH RECURSIVE {EDGES}, w AS (SELECT subject_id AS start, object_id AS node, 1 AS hops FROM edges WHERE subject_id LIKE 'part\\_%' ESCAPE '\\' UNION SELECT start, object_id, hops + 1 FROM w JOIN edges ON node = subject_id WHERE hops < 3), d AS (SELECT start, node, min(hops) AS hops FROM w GROUP BY ALL) SELECT hops, count(*) AS pairs FROM d GROUP BY hops")
def k_hop(spark, sf):
    e = V.edges(spark, sf)
    starts = e.filter(F.col("subject_id").startswith("part_")).select(F.col("subject_id").alias("node"))
    return graph.walk(e, starts, 3).filter("hops > 0").groupBy("hops").agg(F.count("*").alias("pairs"))


@query("hop_orientation", f"WITH {ATTRS} SELECT subject_id, bool_or(attribute = 'p_brand') AS has_bridge, bool_or(attribute = 'c_mktsegment') AS has_target, (NOT bool_or(attribute = 'p_brand')) AND bool_or(attribute = 'c_mktsegment') AS swapped FROM attrs GROUP BY subject_id")
def hop_orientation(spark, sf):
    a = V.attributes(spark, sf).groupBy("subject_id").agg(F.bool_or(F.col("attribute") == "p_brand").alias("has_bridge"), F.bool_or(F.col("attribute") == "c_mktsegment").alias("has_target"))
    return a.withColumn("swapped", ~F.col("has_bridge") & F.col("has_target"))


MEMBERS = """f AS (SELECT 'customer_' || c_custkey AS subject_id, 'member_of' AS attribute, c_mktsegment AS value_text, c_custkey AS ord FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT lower(c_mktsegment), 'has_member', 'customer ' || c_custkey, c_custkey FROM customer WHERE c_custkey % 3 = 0)"""


def _members(spark, sf):
    c = V.table(spark, sf, "customer")
    own = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("subject_id"), F.lit("member_of").alias("attribute"), F.col("c_mktsegment").alias("value_text"), F.col("c_custkey").alias("ord"))
    other = c.filter("c_custkey % 3 = 0").select(F.lower("c_mktsegment"), F.lit("has_member"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")), F.col("c_custkey"))
    return own.union(other).select("*", C.value_key(F.col("value_text")).alias("value_key"), F.lit(0.7).alias("reliability"), F.concat(F.lit("d"), F.col("ord").cast("string")).alias("document_id"), F.lit("wiki").alias("source_class"))


@query("inverse_fallback", f"WITH {MEMBERS}, s AS (SELECT 'customer_' || c_custkey AS subject_id FROM customer) SELECT subject_id, CASE WHEN o.value_text IS NOT NULL THEN lower(o.value_text) ELSE i.subject END AS value, CASE WHEN o.value_text IS NOT NULL THEN 'stated' WHEN i.subject IS NOT NULL THEN 'inverse' ELSE 'none' END AS found FROM s LEFT JOIN (SELECT * FROM f WHERE attribute = 'member_of') o USING (subject_id) LEFT JOIN (SELECT replace(value_text, ' ', '_') AS subject_id, min(subject_id) AS subject FROM f WHERE attribute = 'has_member' GROUP BY 1) i USING (subject_id)")
def inverse_fallback(spark, sf):
    subjects = V.table(spark, sf, "customer").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("subject_id"))
    return facts.inverse_fallback(_members(spark, sf), "member_of", subjects)


@query("fallback_chain", f"WITH {ATTRS} SELECT s.subject_id, s.attribute, CASE WHEN a.value_text IS NOT NULL THEN 0 WHEN c.c_custkey IS NOT NULL THEN 1 END AS priority, coalesce(a.value_text, CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' END) AS value FROM (SELECT 'customer_' || c_custkey AS subject_id, 'p_brand' AS attribute, c_custkey AS k FROM customer UNION SELECT 'part_' || p_partkey, 'p_brand', NULL FROM part) s LEFT JOIN attrs a USING (subject_id, attribute) LEFT JOIN customer c ON c.c_custkey = s.k")
def fallback_chain(spark, sf):
    a = V.attributes(spark, sf)
    customers = a.filter(F.col("attribute") == "c_mktsegment").select("subject_id", F.lit("p_brand").alias("attribute"), F.lit("customer").alias("value"))
    brands = a.filter(F.col("attribute") == "p_brand").select("subject_id", "attribute", F.col("value_text").alias("value"))
    requests = a.select("subject_id", F.lit("p_brand").alias("attribute")).distinct()
    return facts.fallback_chain(requests, brands, customers)


# facts


@query("facts_dedup", f"WITH {CLAIMS} SELECT subject_id, attribute, value_key, chunk_id, arg_min(document_id, ord) AS document_id, min(ord) AS ord FROM claims GROUP BY ALL")
def facts_dedup(spark, sf):
    return facts.deduplicated(V.claims(spark, sf)).select("subject_id", "attribute", "value_key", "chunk_id", "document_id", "ord")


@query("fact_report", f"WITH {CLAIMS}, p AS (SELECT subject_id, attribute, count(*) AS n, count(DISTINCT value_key) AS k FROM claims GROUP BY ALL) SELECT sum(n)::BIGINT AS facts, count(DISTINCT subject_id) AS subjects, count(*) FILTER (WHERE k > 1) AS conflicts FROM p")
def fact_report(spark, sf):
    return facts.report(V.claims(spark, sf))


@query("attributes_of", f"WITH {ATTRS} SELECT DISTINCT subject_id, attribute FROM attrs")
def attributes_of(spark, sf):
    a = V.attributes(spark, sf)
    return facts.attributes_of(a, a)


@query("fact_lookup", f"WITH {GROUPS} SELECT subject_id, value_key, reliability, documents, n AS rows FROM groups")
def fact_lookup(spark, sf):
    c = V.claims(spark, sf)
    return facts.lookup(c, c.select("subject_id", "attribute")).select("subject_id", "value_key", "reliability", "documents", "rows")


@query("conflicts", f"WITH {CLAIMS} SELECT subject_id, attribute, count(DISTINCT value_key) AS values FROM claims GROUP BY ALL HAVING count(DISTINCT value_key) > 1")
def conflicts(spark, sf):
    return facts.conflicts(V.claims(spark, sf))


@query("conflict_best_value", f"WITH {GROUPS} SELECT subject_id, attribute, value_key, reliability, documents, vals AS values FROM ranked WHERE rank = 1")
def conflict_best_value(spark, sf):
    return facts.best(V.claims(spark, sf)).select("subject_id", "attribute", "value_key", "reliability", "documents", "values")


@query("conflict_positions", f"WITH {GROUPS}, o AS (SELECT *, reliability - lead(reliability) OVER w AS gap, row_number() OVER w AS r FROM groups WINDOW w AS (PARTITION BY subject_id, attribute ORDER BY reliability DESC, ord)), n AS (SELECT subject_id, attribute, count(*) AS positions FROM groups GROUP BY ALL) SELECT subject_id, attribute, positions, value_key AS preferred, round(gap, 6) AS gap, round(gap, 6) >= {vocab.DECISIVE_GAP} AS resolvable FROM o JOIN n USING (subject_id, attribute) WHERE r = 1 AND positions > 1")
def conflict_positions(spark, sf):
    return facts.conflict_positions(V.claims(spark, sf))


CONFIDENCE_SQL = "greatest(0.05, least(0.99, CASE WHEN vals > 1 THEN least(least(reliability, 0.92) + least((documents - 1) * 0.04, 0.08), 0.55) ELSE least(reliability, 0.92) + least((documents - 1) * 0.04, 0.08) END))"


@query("confidence_scores", f"WITH {GROUPS}, c AS (SELECT *, {CONFIDENCE_SQL}::DOUBLE AS score FROM ranked WHERE rank = 1) SELECT subject_id, attribute, value_key, vals AS values, round(score, 6) AS confidence, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS label FROM c")
def confidence_scores(spark, sf):
    return facts.scored(V.claims(spark, sf))


@query("inverse_lookup", f"WITH {ATTRS}, w AS (SELECT DISTINCT attribute, split_part({key_sql('value_text')}, ' ', 1) AS wanted_key FROM attrs WHERE attribute = 'p_type') SELECT DISTINCT attribute, wanted_key, subject_id FROM (SELECT *, {key_sql('value_text')} AS k FROM attrs) JOIN w USING (attribute) WHERE contains(' ' || k || ' ', ' ' || wanted_key || ' ')")
def inverse_lookup(spark, sf):
    a = V.attributes(spark, sf).withColumns({"value_key": C.value_key(F.col("value_text")), "document_id": F.col("subject_id")})
    return facts.inverse_lookup(a, a.filter("attribute = 'p_type'").select("attribute", F.substring_index("value_key", " ", 1).alias("wanted_key")))


@query("fact_two_hop", f"WITH {MEMBERS}, seg AS (SELECT subject_id, min(value_text) AS first FROM f WHERE attribute = 'has_member' GROUP BY ALL HAVING true) SELECT m.subject_id, lower(m.value_text) AS via, s.value_key FROM f m JOIN (SELECT subject_id, arg_min(value_text, ord) AS value_key FROM f WHERE attribute = 'has_member' GROUP BY subject_id) s ON lower(m.value_text) = s.subject_id WHERE m.attribute = 'member_of'")
def fact_two_hop(spark, sf):
    return facts.two_hop(_members(spark, sf), "member_of", "has_member").select("subject_id", "via", "value_key")


# time


@query("origin_of", f"WITH {CLAIMS} SELECT subject_id, min(year) AS year FROM claims GROUP BY subject_id")
def origin_of(spark, sf):
    c = V.claims(spark, sf).withColumns({"attribute": F.lit("founded"), "value_text": F.concat(F.lit("in "), F.col("year").cast("string"), F.lit(" AS"))})
    return temporal.origins(c).select("subject_id", "year")


@query("events_at", "WITH e AS (SELECT DISTINCT 'part_' || p_partkey AS subject_id, lower(replace(p_brand, '#', '_')) AS b, 100 + p_size AS year, p_brand FROM part) SELECT subject_id, 'devastated' AS attribute, regexp_replace(trim(regexp_replace(lower(p_brand), '[^a-z0-9_]+', ' ', 'g')), '\\s+', '_', 'g') AS place_id, year::INT AS year FROM e UNION SELECT subject_id, 'devastated', 'far_keep', (year + 1)::INT FROM e")
def events_at(spark, sf):
    p = V.table(spark, sf, "part")
    rows = p.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("subject_id"), F.lit("devastated").alias("attribute"), F.concat(F.lit("Devastated "), F.col("p_brand"), F.lit(" in "), (100 + F.col("p_size")).cast("string"), F.lit(" AS; Far Keep in "), (101 + F.col("p_size")).cast("string"), F.lit(" AS")).alias("value_text"))
    return temporal.events(rows).select("subject_id", "attribute", "place_id", "year")


ANACHRONISM = "o AS (SELECT user_id AS key, median(event_id)::BIGINT AS year FROM events GROUP BY user_id), d AS (SELECT user_id AS key, event_id AS event, event_id AS event_year FROM events WHERE event_type = 'error'), a AS (SELECT key, event, year - event_year AS gap, year > event_year AS impossible FROM o JOIN d USING (key))"


def _anachronisms(spark, sf):
    e = V.table(spark, sf, "events")
    subjects = e.groupBy(F.col("user_id").alias("key")).agg(F.round(F.median("event_id"), 0).cast("bigint").alias("year"))
    return temporal.anachronisms(subjects, e.filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("event"), F.col("event_id").alias("event_year")))


@query("anachronism", f"WITH {ANACHRONISM.replace('median(event_id)::BIGINT', 'round(median(event_id), 0)::BIGINT')} SELECT * FROM a")
def anachronism(spark, sf):
    return _anachronisms(spark, sf)


@query("temporal_verdict", f"WITH {ANACHRONISM.replace('median(event_id)::BIGINT', 'round(median(event_id), 0)::BIGINT')} SELECT key, count(*) AS events, bool_and(impossible) AS all_impossible, bool_or(impossible) AS any_impossible, bool_or(impossible) AND NOT bool_and(impossible) AS mixed FROM a GROUP BY key")
def temporal_verdict(spark, sf):
    return temporal.verdicts(_anachronisms(spark, sf))


@query("as_of", "WITH b AS (SELECT user_id, ts, max({'event_id': event_id, 'value': value}) AS s FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL) SELECT e.event_id, b.s.event_id AS as_of_event_id, b.s.value AS as_of_value FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts")
def as_of(spark, sf):
    """Each event with its user's last event of the first type until then."""
    e = V.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    first = e.agg(F.min("event_type")).first()[0]
    return temporal.as_of(e.select("event_id", "user_id", "ts"), e.filter(F.col("event_type") == first), "user_id", "ts", ["event_id", "value"]).select("event_id", "as_of_event_id", "as_of_value")


@query("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey AS k, c_mktsegment AS s FROM customer INTERSECT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT 'rest', count(*) FROM (SELECT c_nationkey, c_mktsegment FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT 'rows', count(*) FROM (SELECT c_nationkey, c_mktsegment FROM customer EXCEPT ALL SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000)")
def set_operations(spark, sf):
    """Segments of nations that rich customers have, that none has, and the customers that are not rich."""
    c = V.table(spark, sf, "customer")
    pairs = lambda d: d.select("c_nationkey", "c_mktsegment")
    rich = pairs(c.filter("c_acctbal > 5000"))
    parts = {"both": pairs(c).intersect(rich), "rest": pairs(c).subtract(rich), "rows": pairs(c).exceptAll(rich)}
    counted = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, d in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("custody", "SELECT 'customer_' || c_custkey AS subject_id, CASE WHEN c_custkey % 3 = 0 THEN 'housed_in' WHEN c_custkey % 3 = 1 THEN 'ruled_by' ELSE 'seat' END AS attribute, 'the vaults of ' || n_name || ', below' AS value_text, c_custkey % 3 <> 1 AS is_custody FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1)")
def custody(spark, sf):
    """Who keeps what at a place, and other relations that name it."""
    n = V.table(spark, sf, "nation")
    at = F.col("c_custkey") % 3
    rows = V.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("subject_id"), F.when(at == 0, "housed_in").when(at == 1, "ruled_by").otherwise("seat").alias("attribute"), F.concat(F.lit("the vaults of "), "n_name", F.lit(", below")).alias("value_text"))
    return temporal.custody(rows, n.orderBy("n_nationkey").first()["n_name"])


@query("all_years", r"SELECT p_partkey, [x::INT FOR x IN regexp_extract_all('in ' || p_size || ' AS and ' || (p_size + 7) || ' as', '(?i)(\d{1,4})\s*AS\b', 1)] AS years FROM part")
def all_years(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", C.all_years(F.concat(F.lit("in "), F.col("p_size").cast("string"), F.lit(" AS and "), (F.col("p_size") + 7).cast("string"), F.lit(" as"))).alias("years"))


SPANS = "SELECT o_custkey AS c, min(year(o_orderdate))::INT AS a, max(year(o_orderdate))::INT AS z FROM orders GROUP BY o_custkey"


def _spans(spark, sf):
    return V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("z"))


@query("duration", f"SELECT c, z - a AS years FROM ({SPANS})")
def duration(spark, sf):
    return _spans(spark, sf).select("c", temporal.duration(F.col("a"), F.col("z")).alias("years"))


@query("span_overlap", f"SELECT c, (a <= 1997 AND CASE WHEN c % 5 = 0 THEN NULL ELSE 1996 END <= z) AS overlaps FROM ({SPANS})")
def span_overlap(spark, sf):
    start = F.when(F.col("c") % 5 != 0, 1996)
    return _spans(spark, sf).select("c", temporal.overlaps(F.col("a"), F.col("z"), start, F.lit(1997)).alias("overlaps"))


@query("ordering", "SELECT n_regionkey, string_agg(n_name || ' (' || n_nationkey || ' AS)', ', then ' ORDER BY n_nationkey, n_name) AS ordering, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= 2")
def ordering(spark, sf):
    return temporal.ordering(V.table(spark, sf, "nation"), "n_regionkey", "n_name", "n_nationkey")


@query("date_difference", "SELECT l_orderkey, l_linenumber, abs(date_diff('day', o_orderdate, l_shipdate)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_difference(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return V.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.abs(F.date_diff("l_shipdate", "o_orderdate")).cast("bigint").alias("days"))


# arithmetic

STRONGEST = CLAIMS + ", s AS (SELECT subject_id, arg_max(value_number, (reliability, value_number)) AS value FROM claims GROUP BY subject_id)"


def _strongest(spark, sf):
    return reasoning.strongest(V.claims(spark, sf))


@query("aggregate_scan", f"WITH {STRONGEST} SELECT * FROM s")
def aggregate_scan(spark, sf):
    return _strongest(spark, sf)


@query("superlative", f"WITH {STRONGEST} SELECT * FROM s ORDER BY value DESC, subject_id LIMIT 5")
def superlative(spark, sf):
    return reasoning.superlative(_strongest(spark, sf), 5)


@query("superlative_least", f"WITH {STRONGEST} SELECT * FROM s ORDER BY value, subject_id LIMIT 5")
def superlative_least(spark, sf):
    return reasoning.superlative(_strongest(spark, sf), 5, least=True)


@query("comparison", "WITH r AS (SELECT c_nationkey, 'customer_' || c_custkey AS s, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, 'customer_' || c_custkey) AS k FROM customer) SELECT c_nationkey, arg_max(s, v) AS first, max(v) AS high, min(v) AS low, max(v) - min(v) AS gap FROM r WHERE k <= 2 GROUP BY c_nationkey HAVING count(*) = 2")
def comparison(spark, sf):
    c = V.table(spark, sf, "customer").select("c_nationkey", F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("subject_id"), F.col("c_acctbal").alias("value"))
    return reasoning.comparison(c, "c_nationkey")


def _calculations(kind: str):
    sql = {"percentage": "CASE WHEN b <> 0 THEN a * 100 / b END", "ratio": "CASE WHEN b <> 0 THEN a / b END", "difference": "a - b", "total": "a + b", "average": "(a + b) / 2"}[kind]

    @query(f"calc_{kind}", f"SELECT p_partkey, round({sql}, 6) AS result FROM (SELECT p_partkey, p_retailprice AS a, (p_size - 1)::DOUBLE AS b FROM part)")
    def run(spark, sf):
        p = V.table(spark, sf, "part")
        return p.select("p_partkey", F.round(C.calculation(F.lit(kind), F.col("p_retailprice"), (F.col("p_size") - 1).cast("double")), 6).alias("result"))


for _kind in ("percentage", "ratio", "difference", "total", "average"):
    _calculations(_kind)


@query("formatted_results", "SELECT p_partkey, printf('%,d', p_partkey * 1000) AS total, printf('%.2f', p_size / 4.0) || '%' AS percentage, regexp_replace(regexp_replace(printf('%.3f', p_size / 3.0), '0+$', ''), '\\.$', '') AS ratio, CASE WHEN (p_size - 25) % 2 = 0 THEN ((p_size - 25) * 3 // 2)::VARCHAR ELSE printf('%.2f', (p_size - 25) * 1.5) END AS difference FROM part")
def formatted_results(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select("p_partkey", C.format_result(F.lit("total"), (F.col("p_partkey") * 1000).cast("double")).alias("total"), C.format_result(F.lit("percentage"), F.col("p_size") / 4.0).alias("percentage"), C.format_result(F.lit("ratio"), F.col("p_size") / 3.0).alias("ratio"), C.format_result(F.lit("difference"), (F.col("p_size") - 25) * 1.5).alias("difference"))


# Charts drawn from parts, six to a chart: four bars print their part's size, one misprints it, and one prints nothing, or a number beside it.
_LENGTH = "(4.5::DOUBLE * p_size + 3::DOUBLE + (p_partkey % 5)::DOUBLE + (p_partkey % 6)::DOUBLE / 64)"
_BARS = f"""b AS (SELECT p_partkey // 6 AS figure_id, {_LENGTH} AS length, CASE p_partkey % 6 WHEN 5 THEN 0 WHEN 4 THEN p_size + 40 ELSE p_size END::DOUBLE AS printed,
  CASE WHEN p_partkey % 6 = 5 THEN CASE p_partkey // 6 % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 30 END END::DOUBLE AS seen FROM part)"""
_FIT = f"""{_BARS}, r AS (SELECT * FROM b WHERE printed > 0),
l AS (SELECT x.figure_id, x.printed AS pa, y.printed AS pb, (y.length - x.length) / (y.printed - x.printed) AS slope, x.length - (y.length - x.length) / (y.printed - x.printed) * x.printed AS intercept FROM r x JOIN r y ON x.figure_id = y.figure_id AND x.printed < y.printed),
m AS (SELECT l.* FROM l JOIN (SELECT figure_id, max(length) AS longest FROM b GROUP BY figure_id) USING (figure_id) WHERE slope > 0 AND abs(intercept) <= 0.06::DOUBLE * longest),
v AS (SELECT m.*, (SELECT count(*) FROM r WHERE r.figure_id = m.figure_id AND abs(r.length - (slope * r.printed + intercept)) <= 12) AS inliers FROM m),
fit AS (SELECT * FROM v WHERE inliers >= 2 QUALIFY row_number() OVER (PARTITION BY figure_id ORDER BY inliers DESC, abs(intercept), pa, pb) = 1)"""
_NEAR = "x < 100 AND abs(x - round(x)) <= 0.2::DOUBLE"
_AGREES = "abs(seen - x) <= greatest(0.5::DOUBLE, 0.03::DOUBLE * abs(x))"
READ_SQL = f"""WITH {_FIT}, p AS (SELECT figure_id, seen, (length - intercept) / slope AS x FROM b JOIN fit USING (figure_id) WHERE printed <= 0)
SELECT figure_id, CASE WHEN {_AGREES} THEN seen WHEN {_NEAR} THEN round(x) END AS value, CASE WHEN {_AGREES} THEN 0.93::DOUBLE WHEN {_NEAR} THEN 0.78::DOUBLE END AS confidence FROM p"""


def _bars(spark, sf):
    key, size, at = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_partkey") % 6
    length = F.lit(4.5) * size + F.lit(3.0) + (key % 5).cast("double") + at.cast("double") / 64
    chart = F.floor(key / 6).cast("bigint")
    printed = F.when(at == 5, 0.0).when(at == 4, size + 40).otherwise(size)
    seen = F.when(at == 5, F.when(chart % 3 == 0, size).when(chart % 3 == 1, size + 30))
    return V.table(spark, sf, "part").select(chart.alias("figure_id"), length.alias("length"), printed.alias("printed"), seen.alias("seen"))


@query("chart_line_fit", f"WITH {_FIT} SELECT figure_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept, inliers FROM fit")
def chart_line_fit(spark, sf):
    fit = reasoning.line_fit(_bars(spark, sf))
    return fit.select("figure_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "inliers")


@query("chart_readoff", READ_SQL)
def chart_readoff(spark, sf):
    bars = _bars(spark, sf)
    met = bars.filter("printed IS NULL OR printed <= 0").join(reasoning.line_fit(bars), "figure_id")
    read = reasoning.read_off(F.col("length"), F.col("seen"), F.col("slope"), F.col("intercept"))
    return met.select("figure_id", read["value"].alias("value"), read["confidence"].alias("confidence"))


# retrieval

TOKENS = r"[t FOR t IN regexp_extract_all(strip_accents(lower(coalesce(content, ''))), '[\p{L}\p{N}_''-]+') IF length(t) > 1]"
#: The words of every benchmark item are a query.
TERMS = f"qt AS (SELECT query_id, unnest({TOKENS}) AS term FROM (SELECT item_id AS query_id, text AS content FROM benchmark)), qa AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL)"
DOCS = f"c AS (SELECT doc_id, text AS content, {TIER_CASE} AS reliability FROM (SELECT *, {SOURCE_TIER} AS source_class FROM documents)), w AS (SELECT doc_id, unnest({TOKENS}) AS term FROM c), size AS (SELECT doc_id, len({TOKENS})::BIGINT AS len FROM c), whole AS (SELECT count(*) AS n, avg(len) AS avg_len FROM size)"
BM25 = f"{TERMS}, {DOCS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), bm AS (SELECT query_id, doc_id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))) AS score FROM tf JOIN df USING (term) JOIN size USING (doc_id) JOIN qa USING (term), whole GROUP BY query_id, doc_id)"


def _queries(spark, sf):
    return V.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(lexical.tokens(F.col("text"))).alias("term"))


def _documents(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), C.reliability(V.source_tier(F.col("source"))).alias("reliability"))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM bm QUALIFY rank <= 30")
def bm25_topk(spark, sf):
    return lexical.best(_documents(spark, sf), _queries(spark, sf), 30, "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("index_topk", ORACLES["bm25_topk"])
def index_topk(spark, sf):
    """As ``bm25_topk``, from an index that is stored first."""
    index = inverted.build(shared.new_folder(spark, "index"), _documents(spark, sf), "doc_id", "content")
    return index.top(_queries(spark, sf), 30).select("query_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("bm25_all", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_all(spark, sf):
    return lexical.bm25(_documents(spark, sf), _queries(spark, sf), "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"))


POOL = f"{BM25}, pool AS (SELECT query_id, doc_id, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 90), norm AS (SELECT query_id, doc_id, coalesce((score - min(score) OVER q) / nullif(max(score) OVER q - min(score) OVER q, 0), 0) AS norm FROM pool WINDOW q AS (PARTITION BY query_id)), lx AS (SELECT query_id, doc_id, norm, round(0.8 * norm + 0.2 * reliability, 6) AS blend FROM norm JOIN c USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.8 * norm + 0.2 * reliability, 9) DESC, doc_id) <= 30)"


def _pool(spark, sf):
    return lexical.best(_documents(spark, sf), _queries(spark, sf), vocab.POOL * vocab.DEPTH, "doc_id")


@query("bm25_quality_rerank", f"WITH {POOL} SELECT query_id, doc_id, blend FROM lx")
def bm25_quality_rerank(spark, sf):
    out = lexical.reranked(_pool(spark, sf), _documents(spark, sf).select("doc_id", "reliability"), vocab.DEPTH, "doc_id")
    return out.select("query_id", "doc_id", F.round("blend", 6).alias("blend"))


@query("bm25_and", f"WITH {BM25}, two AS (SELECT doc_id, count(DISTINCT term) AS n FROM w WHERE term IN ('the', 'of') GROUP BY doc_id) SELECT doc_id FROM two WHERE n = 2")
def bm25_and(spark, sf):
    q = spark.createDataFrame([(0, "the"), (0, "of")], "query_id bigint, term string")
    return lexical.bm25(_documents(spark, sf), q, "doc_id", every=True).select("doc_id")


@query("phrase_match", f"WITH {DOCS}, t AS (SELECT doc_id, {TOKENS} AS t FROM c) SELECT doc_id, len([i FOR i IN range(1, len(t)) IF t[i] = 'of' AND t[i + 1] = 'the'])::BIGINT AS hits FROM t WHERE len([i FOR i IN range(1, len(t)) IF t[i] = 'of' AND t[i + 1] = 'the']) > 0")
def phrase_match(spark, sf):
    return lexical.phrase(_documents(spark, sf), ["of", "the"], "doc_id")


@query("phrase_accented", f"WITH {DOCS}, t AS (SELECT doc_id, {TOKENS} AS t FROM c) SELECT doc_id, len([i FOR i IN range(1, len(t)) IF t[i] = 'eneina' AND t[i + 1] = 'eneina'])::BIGINT AS hits FROM t WHERE len([i FOR i IN range(1, len(t)) IF t[i] = 'eneina' AND t[i + 1] = 'eneina']) > 0")
def phrase_accented(spark, sf):
    """A phrase whose first word has marks in the texts and none in the question, from stored positions."""
    index = inverted.build(shared.new_folder(spark, "index"), _documents(spark, sf), "doc_id", "content")
    return index.phrase(["eneina", "eneina"]).withColumnRenamed("key", "doc_id")


@query("postings", f"WITH {DOCS}, p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY term")
def postings(spark, sf):
    return lexical.postings(_documents(spark, sf), "doc_id", "content").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


VTERMS = r"vt AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]{1,}')) AS term FROM documents), vc AS (SELECT doc_id, term, count(*) AS c FROM vt GROUP BY ALL), vm AS (SELECT *, max(c) OVER (PARTITION BY doc_id) AS most FROM vc), vn AS (SELECT count(*) AS n FROM documents), voc AS (SELECT term, count(*) AS df FROM vc, vn GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.5 * n ORDER BY df DESC, term LIMIT 4000), vi AS (SELECT term, df, ln(n::DOUBLE / (1 + df)) + 1 AS idf FROM voc, vn)"


def _vocabulary(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    counted = vector.terms(docs, "doc_id", "text")
    return counted, vector.vocabulary(counted, docs.count())


@query("vocab_idf", f"WITH {VTERMS} SELECT term, df, round(idf, 6) AS idf FROM vi")
def vocab_idf(spark, sf):
    return _vocabulary(spark, sf)[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_weights", f"WITH {VTERMS} SELECT doc_id, count(*) AS terms, round(sum((0.5 + 0.5 * c / most) * idf), 4) AS weight FROM vm JOIN vi USING (term) GROUP BY doc_id")
def tfidf_weights(spark, sf):
    return vector.tfidf(*_vocabulary(spark, sf), "doc_id").groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


COSINE = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0), cs AS (SELECT query_id, vec_id, list_cosine_similarity(a, embedding::DOUBLE[]) AS cosine FROM q, embeddings)"


@query("cosine_topk", f"WITH {COSINE} SELECT query_id, vec_id, round(cosine, 6) AS cosine FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) <= 10")
def cosine_topk(spark, sf):
    e = V.table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.cosine_topk(e, asked, 10).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


#: Each item's query has the vector of its own number, where there is one.
VECTORS = "v9 AS (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark)), v0 AS (SELECT * FROM v9 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, doc_id) <= 30)"
FUSED = f"{POOL}, {VECTORS}, f AS (SELECT query_id, doc_id, norm, CASE WHEN cosine IS NOT NULL THEN greatest(cosine, 0) END AS vec FROM lx FULL JOIN v0 USING (query_id, doc_id))"


def _channels(spark, sf):
    docs = _documents(spark, sf)
    lex = lexical.reranked(_pool(spark, sf), docs.select("doc_id", "reliability"), vocab.DEPTH, "doc_id").select("query_id", "doc_id", "norm")
    e = V.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = e.join(V.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    vec = vector.cosine_topk(e, asked.select(F.col("doc_id").alias("query_id"), "embedding"), vocab.DEPTH, "doc_id")
    traits = docs.select("doc_id", "reliability", vector.entity_overlap(F.col("content"), ["the", "und", "que"]).alias("entity_overlap"))
    return lex, vec, traits


OVERLAP = "((contains(lower(content), 'the')::INT + contains(lower(content), 'und')::INT + contains(lower(content), 'que')::INT) / 3)"


@query("hybrid_fusion", f"WITH {FUSED} SELECT f.query_id, f.doc_id, round(0.5 * coalesce(norm, 0) + 0.3 * coalesce(vec, 0) + 0.1 * coalesce({OVERLAP}, 0) + 0.1 * coalesce(reliability, 0), 6) AS score, concat_ws('+', CASE WHEN norm IS NOT NULL THEN 'keyword' END, CASE WHEN vec IS NOT NULL THEN 'vector' END) AS channels FROM f LEFT JOIN c USING (doc_id)")
def hybrid_fusion(spark, sf):
    return vector.fused(*_channels(spark, sf), "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "channels")


@query("entity_overlap", f"WITH {DOCS} SELECT doc_id, round({OVERLAP}, 6) AS overlap FROM c")
def entity_overlap(spark, sf):
    return _documents(spark, sf).select("doc_id", F.round(vector.entity_overlap(F.coalesce("content", F.lit("")), ["the", "und", "que"]), 6).alias("overlap"))


GRID = ((0.0, 0.8), (0.2, 0.6), (0.35, 0.45), (0.4, 0.4), (0.5, 0.3), (0.6, 0.2), (0.8, 0.0))


@query("weight_sweep", f"WITH {FUSED}, g AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in GRID)}) t(wb, wv)), e AS (SELECT item_id AS query_id, doc_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)), r AS (SELECT wb, wv, f.query_id, f.doc_id, row_number() OVER (PARTITION BY wb, wv, f.query_id ORDER BY round(wb * coalesce(norm, 0) + wv * coalesce(vec, 0) + 0.1 * coalesce({OVERLAP}, 0) + 0.1 * coalesce(reliability, 0), 6) DESC, f.doc_id) AS rank FROM f LEFT JOIN c USING (doc_id), g), h AS (SELECT wb, wv, query_id, min(rank) AS first FROM r JOIN e USING (query_id, doc_id) GROUP BY ALL), n AS (SELECT count(DISTINCT query_id) AS n FROM e) SELECT wb AS bm25_weight, wv AS vector_weight, k::INT AS k, round(count(*) FILTER (WHERE first <= k) / max(n), 6) AS recall FROM g LEFT JOIN h USING (wb, wv), n, (SELECT unnest([1, 3, 5]) AS k) GROUP BY ALL")
def weight_sweep(spark, sf):
    """Recall of the documents that hold an item, over the shares of words and vectors."""
    grid = [{"bm25": a, "vector": b} for a, b in GRID]
    swept = vector.swept(vector.candidates(*_channels(spark, sf), "doc_id"), grid, "doc_id", 5)
    expected = evidence_containment(spark, sf).select(F.col("item_id").alias("query_id"), "doc_id")
    return vector.swept_recall(swept, expected, [1, 3, 5], "doc_id", grid).select(F.col("bm25").alias("bm25_weight"), F.col("vector").alias("vector_weight"), "k", F.round("recall", 6).alias("recall"))


@query("recall_at_k", f"WITH {COSINE}, r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM cs), l AS (SELECT r.query_id, r.rank FROM r JOIN embeddings x ON x.vec_id = r.vec_id JOIN embeddings y ON y.vec_id = r.query_id WHERE x.label = y.label AND x.vec_id <> y.vec_id), k AS (SELECT unnest([1, 3, 5]) AS k) SELECT k::INT AS k, round((SELECT count(DISTINCT query_id) FROM l WHERE rank <= k) / (SELECT count(DISTINCT y.vec_id) FROM embeddings y JOIN embeddings x ON x.label = y.label AND x.vec_id <> y.vec_id WHERE y.vec_id % 20 = 0), 6) AS recall FROM k")
def recall_at_k(spark, sf):
    """A neighbour counts as found if it has the query's label; labels are compared on what was ranked."""
    e = V.table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    ranked = vector.cosine_topk(e, asked.select("query_id", "embedding"), 5).select("query_id", "vec_id", "rank")
    labels = ranked.join(e.select("vec_id", F.col("label").alias("own")), "vec_id").join(asked.select("query_id", "label"), "query_id")
    marked = labels.withColumn("ok", F.coalesce(F.expr("own = label AND vec_id != query_id"), F.lit(False)))
    many = e.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")
    return vector.recall_of(marked, [1, 3, 5], asked.join(many, "label", "left_semi")).select("k", F.round("recall", 6).alias("recall"))


@query("lsa_topk")
def lsa_topk(spark, sf):
    """Every benchmark item against all documents, in the space of the full vocabulary and dimensions."""
    vectors, index, idf, parts = vector.lsa(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    probes = V.table(spark, sf, "benchmark").collect()  # a benchmark's items
    if not index:
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, cosine double, rank int")
    asked = spark.createDataFrame([(r["item_id"], x.tolist()) for r, x in zip(probes, vector.embed([r["text"] or "" for r in probes], index, idf, parts), strict=True)], "query_id bigint, embedding array<double>")
    return vector.cosine_topk(vectors, asked, 10, "doc_id")


# evidence


ROW_TEXT = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(trim(content, chr(9) || chr(10) || chr(13) || ' '), '|'), '\[\[([^\]]+)\]\]', '\1', 'g'), '[*_`]{1,3}', '', 'g'), '\s+', ' ', 'g')), '\s*\|\s*', ' — ', 'g'), ' —')"


@query("excerpt_lines", f"WITH {CHUNKS}, k AS (SELECT doc_id, {ROW_TEXT} AS row_text FROM chunks WHERE contains(content, '|') AND contains({fold_sql('content')}, 'the') AND NOT regexp_matches(content, '(?i)^\\s*columns\\s*:')), p AS (SELECT doc_id, arg_min(row_text, (length(row_text), row_text)) AS x FROM k WHERE {fold_sql('row_text')} NOT IN ('', 'field value', 'columns field value') GROUP BY doc_id) SELECT doc_id, CASE WHEN length(x) <= 220 THEN x ELSE rtrim(x[1:219]) || '…' END AS excerpt FROM p")
def excerpt_lines(spark, sf):
    d = _documents(spark, sf).filter(F.contains("content", F.lit("|")))
    lines = F.exists(F.split("content", "\n"), lambda x: F.contains(x, F.lit("|")) & C.mentions(x, F.lit("the")) & ~x.rlike(r"(?i)^\s*columns\s*:"))
    return d.filter(lines).select("doc_id", evidence.excerpt(F.col("content"), F.lit("the")).alias("excerpt"))


@query("evidence_containment", "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def evidence_containment(spark, sf):
    """Passages inside documents: an equi-join on each passage's longest word, then a containment test."""
    b = V.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    word = F.element_at(F.array_sort(F.transform(F.slice(F.split("passage", r"\s+"), 2, F.greatest(F.size(F.split("passage", r"\s+")) - 2, F.lit(1))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    texts = V.table(spark, sf, "documents").select("doc_id", "text")
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    met = words.join(b.withColumn("word", word), "word").select("doc_id", "item_id", "passage")
    return texts.join(met, "doc_id").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id")


@query("claim_gate", f"WITH p AS (SELECT item_id AS evidence_id, text AS content FROM benchmark), c AS (SELECT item_id AS claim_id, CASE WHEN item_id % 3 = 0 THEN -1 ELSE item_id END AS evidence_id, split_part(text, ' ', 1) AS subject, CASE WHEN item_id % 2 = 0 THEN split_part(text, ' ', 2) ELSE 'absentword' END AS value FROM benchmark), j AS (SELECT claim_id, c.evidence_id, CASE WHEN content IS NULL THEN 'unknown evidence' WHEN NOT contains({fold_sql('content')}, {fold_sql('subject')}) THEN 'subject not in passage' WHEN NOT contains({fold_sql('content')}, {fold_sql('value')}) THEN 'value not in passage' END AS reason FROM c LEFT JOIN p USING (evidence_id)) SELECT claim_id, evidence_id, reason IS NULL AS kept, reason FROM j")
def claim_gate(spark, sf):
    b = V.table(spark, sf, "benchmark")
    claims = b.select(F.col("item_id").alias("claim_id"), F.when(F.col("item_id") % 3 == 0, -1).otherwise(F.col("item_id")).alias("evidence_id"), F.substring_index("text", " ", 1).alias("subject"), F.when(F.col("item_id") % 2 == 0, F.split("text", " ")[1]).otherwise("absentword").alias("value"))
    return evidence.gated(claims, b.select(F.col("item_id").alias("evidence_id"), F.col("text").alias("content")))


STOPS = ("all_supported", "no_entity", "iteration_budget", "insufficient_evidence")


@query("status_decision", "WITH s AS (SELECT event_id, ['all_supported', 'no_entity', 'iteration_budget', 'insufficient_evidence'][(event_id % 4 + 1)::BIGINT] AS stop, event_id % 3 AS supported, event_id % 5 // 4 AS unmet, event_id % 7 // 6 AS visual, event_id % 11 // 10 AS limited, event_id % 13 // 12 AS conflict, event_id % 17 // 16 AS bare FROM events) SELECT event_id, CASE WHEN stop = 'no_entity' THEN 'no_entity' WHEN supported = 0 AND visual > 0 THEN 'partial_visual' WHEN supported = 0 AND stop = 'iteration_budget' THEN 'partial_budget' WHEN supported = 0 AND limited > 0 THEN 'partial_rate_limited' WHEN supported = 0 THEN 'insufficient_evidence' WHEN stop = 'iteration_budget' THEN 'partial_budget' WHEN unmet > 0 AND limited > 0 THEN 'partial_rate_limited' WHEN unmet > 0 THEN 'partial_no_progress' WHEN conflict > 0 THEN 'unresolved_conflict' WHEN visual > 0 THEN 'partial_visual' WHEN bare > 0 THEN 'partial_no_progress' ELSE 'completed' END AS status FROM s")
def status_decision(spark, sf):
    e = V.table(spark, sf, "events")
    n = lambda m: F.expr(f"event_id % {m} div {m - 1}")
    stop = F.array(*[F.lit(s) for s in STOPS])[(F.col("event_id") % 4).cast("int")]
    return e.select("event_id", evidence.status(stop, F.col("event_id") % 3, n(5), n(7), n(11), n(13), n(17)).alias("status"))


@query("graph_path_collapse", "SELECT conv_id, string_agg(role, ' > ' ORDER BY turn) AS path FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'user' ELSE role END AS role FROM conversations)) WHERE before IS NULL OR before <> role GROUP BY conv_id")
def graph_path_collapse(spark, sf):
    t = V.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "user").otherwise(F.col("role")).alias("role"))
    return evidence.collapsed_path(t, "conv_id", "turn", "role")


@query("eval_rollup", "SELECT category, status, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, grouping(category, status)::BIGINT AS level FROM (SELECT lang AS category, source AS status, quality = 1 AS passed FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (category, status)")
def eval_rollup(spark, sf):
    rows = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("category"), F.col("source").alias("status"), (F.col("quality") == 1).alias("passed"))
    return evidence.evaluation(rows)


@query("answer_judge", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size % 2 = 0 ELSE contains('about ' || (p_size * 1000), (p_size * 1000)::VARCHAR) END AS passed FROM part")
def answer_judge(spark, sf):
    p = V.table(spark, sf, "part")
    rows = p.select("p_partkey", F.concat(F.lit("about "), F.format_number(F.col("p_size") * 1000, 0)).alias("answer"), (F.col("p_size") * 1000).cast("string").alias("expect"), F.when(F.col("p_size") % 2 == 0, "no_entity").otherwise("completed").alias("status"), (F.col("p_size") % 5 == 0).alias("expect_none"))
    return evidence.judged(rows).select("p_partkey", "passed")


@query("failure_stage", "SELECT CASE WHEN event_id % 2 = 0 THEN 'UNDERSTANDING' WHEN event_id % 3 = 0 THEN 'INGESTION' WHEN event_id % 5 = 0 THEN 'VERIFICATION' ELSE 'RETRIEVAL' END AS stage, count(*) AS n FROM events GROUP BY 1")
def failure_stage(spark, sf):
    e = V.table(spark, sf, "events").select((F.col("event_id") % 2 != 0).alias("understood"), (F.col("event_id") % 3 != 0).alias("stored"), (F.col("event_id") % 5 == 0).alias("retrieved"), F.lit(False).alias("cited"))
    return evidence.failure_stage(e).groupBy("stage").agg(F.count("*").alias("n"))


@query("json_schema_gate", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 1 WHEN event_id % 4 = 2 THEN 0 ELSE 1 END::BIGINT AS claims, CASE WHEN event_id % 2 = 0 THEN 'open_question' END AS intent FROM events")
def json_schema_gate(spark, sf):
    """Payloads of a model, fenced, wrapped in prose, short of a field or broken, through the gateway's validators."""
    claim = F.concat(F.lit('{"claims": [{"subject": "u'), F.col("user_id").cast("string"), F.lit('", "attribute": "did", "value": "'), "event_type")
    at = F.col("event_id") % 4
    said = F.when(at == 0, F.concat(claim, F.lit('"}]}'))).when(at == 1, F.concat(F.lit("```json\n"), claim, F.lit('", "evidence_id": "e"}]}\n```'))).when(at == 2, claim).otherwise(F.concat(F.lit("Here it is: "), claim, F.lit('", "evidence_id": "e"}]} as asked')))
    meant = F.when(F.col("event_id") % 2 == 0, '{"intent": "open_question"}').otherwise('{"intent": "guess", "entities": 7}')

    @F.pandas_udf("claims bigint, intent string")
    def checked(claims: pd.Series, intents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(len(gateway.extracted_claims(gateway.json_of(c))), (gateway.understanding(gateway.json_of(i)) or {}).get("intent")) for c, i in zip(claims, intents, strict=True)], columns=["claims", "intent"])

    ship(spark)
    return V.table(spark, sf, "events").select("event_id", checked(said, meant).alias("x")).select("event_id", "x.*")


QUESTIONS = ("How long did the war last?", "What percentage of the garrison fell?", "Which came first?", "Which keep has the highest threat rating?", "What is the total of both?", "Do the sources disagree?", "Who ruled it?")
def _meaning_sql(meaning: str) -> str:
    """A meaning in SQL: its alternatives, each of features that are shown or not."""
    shows = lambda f: ("NOT " if f.startswith("-") else "") + "regexp_matches(question, '" + language.feature(f.removeprefix("-")).replace("'", "''") + "')"
    return " OR ".join("(" + " AND ".join(map(shows, features)) + ")" for features in language.MEANINGS[meaning])


_ASKED = f"SELECT p_partkey AS question_id, replace(list_value({', '.join(chr(39) + q.replace(chr(39), chr(39) * 2) + chr(39) for q in QUESTIONS)})[(p_partkey % {len(QUESTIONS)} + 1)::INT], 'the', p_name) AS question FROM part"


@query("operation_detect", f"WITH q AS ({_ASKED}) " + " UNION ALL ".join(f"SELECT question_id, '{o.name}' AS operation FROM q WHERE " + " OR ".join(map(_meaning_sql, o.meanings)) for o in operations.OPERATIONS))
def operation_detect(spark, sf):
    """Operations of a question about every part: the questions' shapes, with its name in place of an article."""
    shapes = F.array(*map(F.lit, QUESTIONS))
    asked = F.replace(F.get(shapes, (F.col("p_partkey") % len(QUESTIONS)).cast("int")), F.lit("the"), F.col("p_name"))
    return operations.told(V.table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), asked.alias("question")))


@query("entity_match", "WITH q AS (SELECT n_nationkey AS question_id, 'Who rules ' || n_name || ' and ' || r_name || '?' AS question FROM nation JOIN region ON n_regionkey = r_regionkey), names AS (SELECT DISTINCT trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS name FROM (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region)) SELECT question_id, name FROM q JOIN names ON contains(' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || name || ' ')")
def entity_match(spark, sf):
    n, r = V.table(spark, sf, "nation"), V.table(spark, sf, "region")
    q = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Who rules "), "n_name", F.lit(" and "), "r_name", F.lit("?")).alias("question"))
    names = n.select(F.col("n_name").alias("name")).union(r.select("r_name"))
    return evidence.entity_matches(q, names).select("question_id", "name")


@query("prose_facts", "SELECT * FROM (SELECT p_partkey, 'forging_date' AS attribute, p_size || ' AS' AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'garrison_strength', (p_size * 10)::VARCHAR FROM part) ORDER BY 1")
def prose_facts(spark, sf):
    p = V.table(spark, sf, "part")
    say = F.concat(F.lit("The Blade is old. "), F.when(F.col("p_partkey") % 2 == 0, "It was forged in ").otherwise("Its year is contested: it was forged in "), F.col("p_size").cast("string"), F.lit(" AS. It has a garrison of "), (F.col("p_size") * 10).cast("string"), F.lit(" men. Nothing else matters. It was founded in 9 AS."))
    rows = prose.sentences(p.select("p_partkey", say.alias("text")), "p_partkey", "text")
    return prose.stated(prose.about(rows, F.lit("Blade"), "p_partkey"), "p_partkey")


@query("plate_values", "SELECT p_partkey, 'threat_rating' AS attribute, p_size::VARCHAR AS value FROM part WHERE p_partkey % 3 <> 0")
def plate_values(spark, sf):
    p = V.table(spark, sf, "part")
    text = F.concat(F.lit("Plate: Keep\nThreat rating: "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " minimum standard tolerance").otherwise(""))
    return prose.plate_values(p.select("p_partkey", text.alias("text")), "p_partkey", "text")
