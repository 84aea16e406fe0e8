"""What questions need of an archive, answered for all questions at once.

An investigation is a generator: it yields what it needs, a ``Need`` or a list of them, and goes on with what it is sent.  ``drive`` runs any
number of investigations in rounds: the needs of all that still run are grouped by kind, and each kind is one join of a table of
requests (at most ``BLOCK`` rows) with the archive.  The jobs of a batch follow from the longest investigation in it and from the
kinds of needs, not from the number of questions; investigations that end leave the table.
"""

from __future__ import annotations

from collections.abc import Generator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab
from foliant.operators import evidence, facts, figures, prose, temporal

#: Requests of a kind that one join takes.
BLOCK = 1000
#: Passages that a search step reads and that prose is looked for in; edges of a subject.
PASSAGES, PROSE_PASSAGES, EDGES = 6, 12, 4


class Need(NamedTuple):
    kind: str
    args: tuple


Investigation = Generator[Any, Any, Any]


class Rounds:
    """The tables of an archive, asked by frames of requests.  Each method takes requests and returns a result for each."""

    def __init__(self, archive, retriever):
        self.spark, self.retriever = archive.spark, retriever
        self.facts, self.chunks, self.edges, self.entities, self.figures_table = (archive.table(n) for n in ("facts", "chunks", "edges", "entities", "figures"))
        self.jobs = 0

    # --- the loop

    def drive(self, runs: list[Investigation]) -> list[Any]:
        """The results of investigations, in order."""
        results: list[Any] = [None] * len(runs)
        waiting: dict[int, Any] = {}

        def resume(k: int, sent: Any) -> None:
            try:
                waiting[k] = runs[k].send(sent)
            except StopIteration as over:
                results[k] = over.value

        for k in range(len(runs)):
            resume(k, None)
        while waiting:
            asked, waiting = waiting, {}
            kinds: dict[str, dict[tuple, Any]] = {}
            for wanted in asked.values():
                for need in wanted if isinstance(wanted, list) else [wanted]:
                    kinds.setdefault(need.kind, {})[need.args] = None
            for kind, found in kinds.items():
                requests = list(found)
                for at in range(0, len(requests), BLOCK):
                    part = requests[at : at + BLOCK]
                    self.jobs += 1
                    found.update(zip(part, getattr(self, kind)(part), strict=True))
            for k, wanted in asked.items():
                resume(k, [kinds[n.kind][n.args] for n in wanted] if isinstance(wanted, list) else kinds[wanted.kind][wanted.args])
        return results

    # --- requests as frames

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, f"rid int, {schema}"))

    @staticmethod
    def _dealt(n: int, df: DataFrame) -> list[list[dict]]:
        """Rows by request, in the frame's order."""
        out: list[list[dict]] = [[] for _ in range(n)]
        for r in df.collect():
            row = r.asDict(True)
            out[row.pop("rid")].append(row)
        return out

    def _first(self, df: DataFrame, limit: int, *order) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("rid").orderBy(*order))
        return df.withColumn("at", at).filter(F.col("at") <= limit).orderBy("rid", "at").drop("at")

    def _values(self, rows: list[tuple], schema: str, *columns) -> list[tuple]:
        found = self.spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"rid int, {schema}").coalesce(1).select("rid", *columns).collect()
        return [tuple(r[1:]) for r in sorted(found, key=lambda r: r[0])]

    @staticmethod
    def _keyed(table: DataFrame, key: str, keys) -> DataFrame:
        """A clustered table's rows of some keys, named to the scan so that it skips row groups."""
        return table.filter(F.col(key).isin(sorted({k for k in keys if k is not None})))

    # --- needs

    def names(self, requests: list[tuple]) -> list[dict[str, str]]:
        """Names of entities and subjects that have every word in a set of words, with their ids: names meet words by their first word."""
        known = self.entities.select(F.lower("name").alias("name"), "entity_id").union(self.facts.select(F.lower("subject_name").alias("name"), F.col("subject_id").alias("entity_id"))).distinct()
        parts = F.filter(F.split("name", r"(?U)\W+"), lambda w: w != "")
        known = known.withColumn("parts", parts).withColumn("head", F.get("parts", F.lit(0)))
        asked = self._frame([(k, w, list(words)) for k, (words,) in enumerate(requests) for w in words], "head string, words array<string>")
        met = known.join(asked, "head").filter(F.size(F.array_except("parts", "words")) == 0)
        return [{r["name"]: r["entity_id"] for r in rows} for rows in self._dealt(len(requests), met.select("rid", "name", "entity_id").orderBy("rid", "name"))]

    def ranked(self, requests: list[tuple]) -> list[list[dict]]:
        """Facts about (subject, attribute), by the rank of their value."""
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "subject_id string, attribute string")
        own = self._keyed(self.facts, "subject_id", (r[0] for r in requests)).join(F.broadcast(asked.drop("rid")), facts.KEY, "left_semi")
        of = facts.ranked(own).select(*facts.KEY, "value_key", "rank", "gap", F.col("value_text").alias("shown"), F.col("reliability").alias("best"), "sources")
        rows = own.join(of, [*facts.KEY, "value_key"]).join(asked, facts.KEY)
        return self._dealt(len(requests), rows.orderBy("rid", "rank", "ord").drop("ord"))

    def attributes(self, requests: list[tuple]) -> list[list[str]]:
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "subject_id string")
        rows = facts.attributes_of(self._keyed(self.facts, "subject_id", (r[0] for r in requests)), asked).join(asked, "subject_id").select("rid", "attribute").orderBy("rid", "attribute")
        return [[r["attribute"] for r in found] for found in self._dealt(len(requests), rows)]

    def naming(self, requests: list[tuple]) -> list[list[dict]]:
        """Facts of others whose value under one of some attributes is, or lists, a subject."""
        asked = self._frame([(k, a, subject) for k, (subject, attributes) in enumerate(requests) for a in attributes], "attribute string, target string")
        each = self.facts.join(F.broadcast(asked.select("attribute").distinct()), "attribute", "left_semi").withColumn("target", F.explode(F.array_distinct(C.hop_targets(F.col("value_text")))))
        rows = each.join(asked, ["attribute", "target"]).filter("subject_id <> target").drop("target")
        return self._dealt(len(requests), self._first(rows, PASSAGES, F.desc("reliability"), "subject_id", "ord").drop("ord"))

    def neighbours(self, requests: list[tuple]) -> list[list[dict]]:
        """Where edges of some predicates lead from a subject: stated ones before links, then by confidence."""
        asked = self._frame([(k, p, subject) for k, (subject, predicates) in enumerate(requests) for p in dict.fromkeys(predicates)], "predicate string, subject_id string")
        about = self.chunks.select("chunk_id", "source_class").withColumn("reliability", C.reliability(F.col("source_class")))
        named = self.entities.select(F.col("entity_id").alias("object_id"), "name")
        rows = self._first(self._keyed(self.edges, "subject_id", (r[0] for r in requests)).join(asked, ["predicate", "subject_id"]).drop("subject_id"), EDGES, F.col("method") != "infobox", F.desc("confidence"), "predicate", "object_id", "chunk_id")
        rows = rows.join(named, "object_id", "left").join(about, "chunk_id").withColumnRenamed("object_id", "other")
        return self._dealt(len(requests), rows.orderBy("rid", F.col("method") != "infobox", F.desc("confidence"), "predicate", "other", "chunk_id"))

    def plates(self, requests: list[tuple]) -> list[list[dict]]:
        """Figures that show a name, those with most words first."""
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "name string")
        where = self.chunks.select(F.get("figure_ids", F.lit(0)).alias("figure_id"), "chunk_id", "document_id", F.col("page_start").alias("page"), "source_class")
        rows = figures.lookup(self.figures_table, asked.select("name")).join(where, "figure_id", "left").join(asked, "name")
        return self._dealt(len(requests), rows.orderBy("rid", F.desc(F.length("ocr_text")), "figure_id", "chunk_id"))

    def _searched(self, requests: list[tuple[tuple[str, ...], tuple[str, ...]]], limit: int) -> DataFrame:
        """rid, nth and the found chunks' columns, of requests of (texts, names)."""
        texts = [(k, nth, t) for k, (asked, _) in enumerate(requests) for nth, t in enumerate(asked)]
        places = self._frame([(k, q, nth) for q, (k, nth, _) in enumerate(texts)], "query_id bigint, nth int")
        hits = self.retriever.search([(q, t) for q, (_, _, t) in enumerate(texts)], limit, {q: list(requests[k][1]) for q, (k, _, _) in enumerate(texts)})
        return hits.join(places, "query_id")

    def passages(self, requests: list[tuple]) -> list[list[dict]]:
        hits = self._searched(requests, PASSAGES)
        kept = hits.select("rid", "nth", "rank", "chunk_id", "document_id", F.col("page_start").alias("page"), "source_class", "reliability", "content", "channels", "score")
        return self._dealt(len(requests), kept.orderBy("rid", "nth", "rank").drop("nth", "rank"))

    def sentences(self, requests: list[tuple]) -> list[list[dict]]:
        """What sentences state of (name, attribute), of passages that the archive's phrases find; the first phrase that finds a statement counts."""
        near = self._searched([(tuple(prose.search_queries(name, attribute)), (name,)) for name, attribute in requests], PROSE_PASSAGES)
        asked = self._frame([(k, name, attribute) for k, (name, attribute) in enumerate(requests)], "name string, attribute string")
        passages = near.filter(F.col("content_type") == "paragraph").groupBy("rid", "chunk_id", "content").agg(F.min(F.struct("nth", "rank")).alias("at")).withColumn("place", F.concat_ws(":", "rid", "chunk_id"))
        cut = prose.sentences(passages, "place", "content").join(passages.select("place", "rid"), "place").join(asked.select("rid", "name"), "rid")
        said = prose.stated(prose.about(cut, F.col("name"), "place"), "place").join(passages.select("place", "rid", "chunk_id", F.col("at").alias("found_at")), "place").join(asked.select("rid", "attribute"), ["rid", "attribute"])
        where = self.chunks.select("chunk_id", "document_id", F.col("page_start").alias("page"), "source_class").withColumn("reliability", C.reliability(F.col("source_class")))
        return self._dealt(len(requests), self._first(said.join(where, "chunk_id").drop("place"), 3, "found_at", "chunk_id").drop("found_at"))

    def extremes(self, requests: list[tuple]) -> list[list[dict]]:
        """The subjects with the five highest, or lowest, numbers of an attribute."""
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "attribute string, lowest boolean")
        numbers = self.facts.filter(F.col("value_number").isNotNull()).join(F.broadcast(asked.select("attribute").distinct()), "attribute", "left_semi")
        best = numbers.groupBy("attribute", "subject_id").agg(F.max_by(F.struct("subject_name", "value_text", "value_number", "document_id", "chunk_id", "page", "source_class", "reliability"), F.struct("reliability", "value_number")).alias("f"))
        value = F.when(F.col("lowest"), F.col("f.value_number")).otherwise(-F.col("f.value_number"))
        return self._dealt(len(requests), self._first(best.join(asked, "attribute"), 5, value, "subject_id").select("rid", "subject_id", "f.*"))

    def origins(self, requests: list[tuple]) -> list[list[dict]]:
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "subject_id string")
        own = self._keyed(self.facts, "subject_id", (r[0] for r in requests)).filter(F.col("attribute").isin(*vocab.ORIGIN_ATTRIBUTES)).join(asked, "subject_id").withColumn("year", C.parse_year(F.col("value_text"))).filter("year IS NOT NULL")
        return self._dealt(len(requests), self._first(own, 1, "year", F.desc("reliability"), "ord").drop("ord"))

    def dated(self, requests: list[tuple]) -> list[list[dict]]:
        """Events at a place, by year; then its own dated events of other years."""
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "place string")
        there = temporal.events(self.facts).select("subject_id", "attribute", "year", "place_id").join(asked, F.contains(F.col("place_id"), F.col("place"))).select("rid", "subject_id", "attribute", "year").distinct()
        met = there.join(self.facts.drop("ord"), ["subject_id", "attribute"]).withColumn("kind", F.lit(0))
        own = self.facts.drop("ord").filter(F.col("attribute").isin(*vocab.EVENT_ATTRIBUTES)).join(asked.withColumnRenamed("place", "subject_id"), "subject_id").withColumn("year", C.parse_year(F.col("value_text"))).filter("year IS NOT NULL").withColumn("kind", F.lit(1))
        out = []
        for rows in self._dealt(len(requests), met.unionByName(own).orderBy("rid", "kind", "year", "subject_id")):
            first = [r for r in rows if r["kind"] == 0]
            years = {r["year"] for r in first}
            out.append([{k: v for k, v in r.items() if k != "kind"} for r in first + [r for r in rows if r["kind"] and r["year"] not in years]])
        return out

    def relations(self, requests: list[tuple]) -> list[list[dict]]:
        """Facts about a subject whose value names a place, and whether they say where it is kept."""
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "subject_id string, place string")
        own = self._keyed(self.facts, "subject_id", (r[0] for r in requests)).drop("ord").join(asked, "subject_id")
        rows = own.filter(C.mentions(F.col("value_text"), F.col("place"))).withColumn("is_custody", F.col("attribute").isin(*vocab.CUSTODY_ATTRIBUTES)).drop("place")
        return self._dealt(len(requests), rows.orderBy("rid", F.desc("is_custody"), F.desc("reliability"), "attribute", "chunk_id"))

    def excerpts(self, requests: list[tuple]) -> list[str]:
        """What a chunk says of a value and a subject."""
        asked = self._frame([(k, *r) for k, r in enumerate(requests)], "chunk_id string, value string, subject string")
        excerpt = F.coalesce(F.nullif(evidence.excerpt(F.col("content"), F.col("value"), F.col("subject")), F.lit("")), F.substring("content", 1, vocab.EXCERPT))
        found = self._dealt(len(requests), self._keyed(self.chunks, "chunk_id", (r[0] for r in requests)).select("chunk_id", "content").join(asked, "chunk_id").select("rid", excerpt.alias("excerpt")))
        return [rows[0]["excerpt"] if rows else "" for rows in found]

    def confidences(self, requests: list[tuple]) -> list[tuple[float, str]]:
        score = C.confidence(F.col("best"), F.col("documents"), F.col("hops"), F.col("split"))
        return self._values(requests, "best double, documents int, hops int, split boolean", F.round(score, 6), C.confidence_label(score))

    def hop_targets(self, requests: list[tuple]) -> list[list[str]]:
        return [r[0] for r in self._values(requests, "v string", C.hop_targets(F.col("v")))]

    def years(self, requests: list[tuple]) -> list[int | None]:
        return [r[0] for r in self._values(requests, "v string", C.parse_year(F.col("v")))]

    def numbers(self, requests: list[tuple]) -> list[float | None]:
        return [r[0] for r in self._values(requests, "v string", C.numeric_value(C.value_key(F.col("v"))))]

    def results(self, requests: list[tuple]) -> list[str | None]:
        """A calculation of two numbers, as text."""
        result = C.calculation(F.col("kind"), F.col("a"), F.col("b"))
        return [r[0] for r in self._values(requests, "kind string, a double, b double", C.format_result(F.col("kind"), F.when(F.col("kind") == "difference", F.abs(result)).otherwise(result)))]

    def statuses(self, requests: list[tuple]) -> list[str]:
        names = ("supported", "unmet", "visual", "limited", "unresolved", "bare")
        return [r[0] for r in self._values(requests, "stop string, " + ", ".join(f"{n} int" for n in names), evidence.status(F.col("stop"), *map(F.col, names)))]
