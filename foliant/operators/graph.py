"""The knowledge graph: entities, edges and mentions from chunks, neighbours and bounded walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab
from foliant.operators.facts import kv_rows, subject_name

#: Edges, and nodes, that are broadcast.
NEAR = 1_000_000
PLAIN_NAME = r"^(?:The\s+)?(?:[A-Z][\w'-]*)(?:\s+(?:of|the|and|[A-Z][\w'-]*))*$"


def collect_entities(mentions: DataFrame) -> DataFrame:
    """entity_id, name, entity_type, mention_count from (raw, ord): first name, first known type."""
    rows = mentions.select(C.entity_id(F.col("raw")).alias("entity_id"), C.display_name(F.col("raw")).alias("name"), C.type_hint(F.col("raw")).alias("kind"), "ord").filter("entity_id != ''")
    known = F.min_by(F.when(F.col("kind") != "unknown", F.col("kind")), F.when(F.col("kind") != "unknown", F.col("ord")))
    return rows.groupBy("entity_id").agg(F.min_by("name", "ord").alias("name"), F.coalesce(known, F.lit("unknown")).alias("entity_type"), F.count("*").alias("mention_count"))


def _base(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    current = documents.filter("superseded_by IS NULL").select("document_id", "title")
    return chunks.join(current, "document_id").withColumn("subject_name", subject_name(F.col("section_path"), F.col("title")))


def link_edges(base: DataFrame) -> DataFrame:
    links = base.select("subject_name", "chunk_id", "document_id", F.col("page_start").alias("page"), F.explode(C.wikilinks(F.col("content"))).alias("raw"))
    return links.withColumns({"predicate": F.lit("related_to"), "method": F.lit("wikilink"), "confidence": F.lit(0.6)})


def typed_edges(base: DataFrame) -> DataFrame:
    """Edges that infobox rows state: the field is the predicate, parts of the value the targets."""
    rows = kv_rows(base.filter("content_type = 'table'")).withColumn("predicate", C.choose(F.lower(F.trim("label")), vocab.PREDICATES)).filter("predicate IS NOT NULL")
    parts = rows.select("subject_name", "chunk_id", "document_id", F.col("page_start").alias("page"), "predicate", F.explode(F.split("value", r"\s*;\s*")).alias("part"))
    plain = F.btrim("part", F.lit(" *"))
    targets = F.when(F.size(C.wikilinks(F.col("part"))) > 0, C.wikilinks(F.col("part"))).when(plain.rlike(PLAIN_NAME), F.array(plain))
    return parts.select("subject_name", "chunk_id", "document_id", "page", F.explode(targets).alias("raw"), "predicate", F.lit("infobox").alias("method"), F.lit(0.9).alias("confidence"))


def _stated(base: DataFrame) -> DataFrame:
    rows = link_edges(base).unionByName(typed_edges(base))
    return rows.withColumns({"subject_id": C.entity_id(F.col("subject_name")), "object_id": C.entity_id(F.col("raw"))}).filter("object_id != ''")


def entities(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The entities that chunks name or are about."""
    base = _base(chunks, documents)
    ord_ = F.struct("document_id", "chunk_id")
    return collect_entities(_stated(base).select("raw", ord_.alias("ord")).unionByName(base.select(F.col("subject_name").alias("raw"), ord_.alias("ord"))))


def build(chunks: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """entities, edges and mentions of a set of chunks; edges and mentions belong to their chunk."""
    base = _base(chunks, documents)
    stated = _stated(base)
    unique = ["subject_id", "predicate", "object_id", "chunk_id"]
    edges = stated.filter("subject_id != object_id").groupBy(*unique).agg(F.max_by(F.struct("document_id", "page", "method", "confidence"), "confidence").alias("e")).select(*unique, "e.*")
    named = stated.select(F.col("object_id").alias("entity_id"), "chunk_id", "document_id")
    mentions = named.unionByName(base.select(C.entity_id(F.col("subject_name")).alias("entity_id"), "chunk_id", "document_id")).distinct()
    return {"entities": entities(chunks, documents), "edges": edges, "mentions": mentions}


def neighbours(edges: DataFrame, nodes: DataFrame, predicates: list[str] | None = None, entities: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """node, direction, predicate, other, method, confidence: one hop either way; with ``entities`` the other's name and
    type too; with ``limit`` the first so many of a node, stated edges before links, then by confidence."""
    kept = edges.filter(F.col("predicate").isin(predicates)) if predicates else edges
    out = kept.select(F.col("subject_id").alias("node"), F.lit("out").alias("direction"), "predicate", F.col("object_id").alias("other"), "method", "confidence")
    into = kept.select(F.col("object_id").alias("node"), F.lit("in").alias("direction"), "predicate", F.col("subject_id").alias("other"), "method", "confidence")
    found = out.unionByName(into).join(nodes.select("node").distinct(), "node", "left_semi")
    if limit is not None:
        order = Window.partitionBy("node").orderBy(F.col("method") != "infobox", F.desc("confidence"), F.desc("direction"), "predicate", "other")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    if entities is not None:
        found = found.join(entities.select(F.col("entity_id").alias("other"), "name", "entity_type"), "other", "left")
    return found


def walk(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """start, node, hops: what is reached along edge directions, at its least distance.

    The first hop deals edges by start.  Later ones follow only edges that leave an edge's end; where these are ``NEAR`` or fewer
    they are broadcast, so pairs stay where they are.  Least distances are taken once, at the end.  What is returned is persisted, and all else released.
    """

    def near(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return F.broadcast(df) if df.count() <= NEAR else df

    step = edges.select(F.col("subject_id").alias("node"), F.col("object_id").alias("next")).persist()
    kept, first = [step], starts.select("node").distinct()
    levels = [first.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))]
    front = onward = None
    for hop in range(1, hops + 1):
        if front is None:
            reached = step.join(first, "node", "left_semi").select(F.col("node").alias("start"), F.col("next").alias("node"))
        else:
            if onward is None:
                onward = near(step.join(near(step.select(F.col("next").alias("node")).distinct()), "node", "left_semi").distinct())
            reached = front.join(onward, "node").select("start", F.col("next").alias("node"))
        front = reached.distinct().persist()
        kept.append(front)
        if front.isEmpty():
            break
        levels.append(front.withColumn("hops", F.lit(hop)))
    pairs = levels[0]
    for level in levels[1:]:
        pairs = pairs.unionByName(level)
    out = pairs.groupBy("start", "node").agg(F.min("hops").alias("hops")).persist()
    out.count()
    for frame in kept:
        frame.unpersist()
    return out
