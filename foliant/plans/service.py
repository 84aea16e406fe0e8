"""The API as methods: what a web layer would route to, returning plain dictionaries."""

from __future__ import annotations

import json
import posixpath
import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import evidence, facts, retrieval
from foliant.plans.ask import Investigator
from foliant.plans.operations import detect
from foliant.sources.adapters import NullOcr, NullVision
from foliant.sources.archive import Archive, Settings


class Service:
    def __init__(self, archive: Archive, model=None, settings: Settings = Settings()):  # noqa: B008
        self.archive, self.model, self.settings = archive, model, settings

    def health(self) -> dict:
        held = self.archive.table("documents") is not None
        return {"status": "ok" if held else "empty", "modes": self.modes()}

    def modes(self) -> dict:
        held, space = self.archive.table("facts") is not None, self.archive.table("vector_space")
        return {"keyword": held, "facts": held, "graph": held, "vector": space is not None and not space.isEmpty(), "ocr": NullOcr().available, "vision": NullVision().available, "model": bool(self.model and self.model.available)}

    def question(self, text: str, iterations: int = 6) -> dict:
        if not 2 <= len(text) <= 1000 or not 1 <= iterations <= 100:
            raise ValueError("a question has 2 to 1000 characters and 1 to 100 iterations")
        began = time.monotonic()
        answer = Investigator(self.archive, replace(self.settings, iterations=iterations), self.model).ask(text).to_dict()
        return self.response(answer) | {"operations": detect(text), "seconds": round(time.monotonic() - began, 3)}

    def response(self, answer: dict) -> dict:
        """An answer with what its evidence comes from: each cited document's path and title, and the figures of cited chunks."""
        cited = [e for c in answer["claims"] for e in c["evidence"]]
        ids, chunks = sorted({e["document_id"] for e in cited}), sorted({e["chunk_id"] for e in cited})
        documents, shown = {}, {}
        if cited:
            documents = {r.document_id: r for r in self.archive.points("documents", ids).select("document_id", "relative_path", "title").collect()}
            held = self.archive.points("chunks", chunks).select("chunk_id", F.explode("figure_ids").alias("figure_id"))
            for r in held.join(self.archive.table("figures"), "figure_id").select("chunk_id", "figure_id", "caption", "asset_path").collect():
                shown.setdefault(r.chunk_id, []).append({"figure_id": r.figure_id, "caption": r.caption, "asset_path": r.asset_path})
        claims = [c | {"evidence": [e | {"relative_path": documents[e["document_id"]].relative_path, "title": documents[e["document_id"]].title, "figures": shown.get(e["chunk_id"], [])} for e in c["evidence"]]} for c in answer["claims"]]
        return answer | {"claims": claims, "answer_type": answer["question"]["answer_type"], "intent": answer["question"]["intent"], "documents": len(ids), "partial": answer["status"].startswith("partial")}

    def search(self, text: str, limit: int = 8, mode: str = "hybrid") -> list[dict]:
        """The best chunks for a text; mode: hybrid, keyword or vector."""
        asks = Investigator(self.archive, self.settings)
        found = asks.retriever.search([(0, text)], limit, list(asks.names_in(text)), mode)
        return [r.asDict(True) for r in found.select("rank", "chunk_id", "document_id", "score", "channels", "bm25", "vector", "content").orderBy("rank").collect()]

    def asset(self, figure_id: str, root: str) -> str | None:
        """Where a figure's picture lies under ``root``; None for figures unknown, or whose path leads out of it."""
        held = self.figure(figure_id)
        if not held or not held["asset_path"]:
            return None
        path = posixpath.normpath(posixpath.join(root, held["asset_path"]))
        return path if path.startswith(posixpath.normpath(root).rstrip("/") + "/") else None

    def sweep(self, path: str, steps: int = 5) -> DataFrame:
        """k, recall of probes {q, expect_doc_contains} in a JSON file, at shares of BM25 against vectors."""
        with open(path) as f:
            probes = json.load(f)
        probes = probes["probes"] if isinstance(probes, dict) else probes
        rows = [(k, p["expect_doc_contains"]) for k, p in enumerate(probes)]
        wanted = self.archive.spark.createDataFrame(rows, "query_id bigint, part string")
        titles = self.archive.table("documents").select("document_id", F.lower("relative_path").alias("place"))
        out = None
        for k in range(steps):
            share = 0.8 * k / (steps - 1)
            weights = {**self.settings.weights, "bm25": 0.8 - share, "vector": share}
            hits = retrieval.of(self.archive, weights).search([(k, p["q"]) for k, p in enumerate(probes)], 5).select("query_id", "rank", "document_id").join(titles, "document_id")
            met = wanted.join(hits, "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.contains("place", F.lower("part")), F.col("rank"))).alias("first"))
            row = met.agg(*[F.avg((F.coalesce("first", F.lit(99)) <= n).cast("int")).alias(f"recall_{n}") for n in (1, 3, 5)]).withColumn("vector_share", F.lit(share))
            out = row if out is None else out.unionByName(row)
        return out

    def diagnose(self, path: str) -> DataFrame:
        """stage, n: where golden questions {q, expect} that were missed went wrong."""
        with open(path) as f:
            asked = json.load(f)
        asked = [q for q in (asked["questions"] if isinstance(asked, dict) else asked) if q.get("expect")]
        found, rows = Investigator(self.archive, self.settings, self.model), []
        for q, a in zip(asked, found.ask_many([q["q"] for q in asked]), strict=True):
            if q["expect"].lower() in a.headline.lower():
                continue
            holds = F.contains(F.lower("content"), F.lit(q["expect"].lower()))
            read = " ".join(r.get("content") or r["value_text"] for s in a.steps for r in s.rows).lower()
            rows.append((a.question.intent != "open_question", not self.archive.table("chunks").filter(holds).isEmpty(), q["expect"].lower() in read, False))
        missed = self.archive.spark.createDataFrame(rows, "understood boolean, stored boolean, retrieved boolean, cited boolean")
        return evidence.failure_stage(missed).groupBy("stage").agg(F.count("*").alias("n"))

    def _one(self, table: str, value: str) -> dict | None:
        rows = self.archive.points(table, [value]).limit(1).collect()
        return rows[0].asDict(True) if rows else None

    def document(self, document_id: str) -> dict | None:
        return self._one("documents", document_id)

    def chunks(self, document_id: str, page: int | None = None) -> list[dict]:
        rows = self.archive.table("chunks").filter(F.col("document_id") == document_id)
        rows = rows if page is None else rows.filter((F.col("page_start") <= page) & (F.col("page_end") >= page))
        return [r.asDict(True) for r in rows.orderBy("char_start").collect()]  # those of one document

    def chunk(self, chunk_id: str) -> dict | None:
        return self._one("chunks", chunk_id)

    def figure(self, figure_id: str) -> dict | None:
        return self._one("figures", figure_id)

    def conflicts(self) -> DataFrame:
        return facts.conflict_positions(self.archive.table("facts"))

    def indexes(self) -> dict:
        return self.archive.statistics().first().asDict()

    def evaluate(self, path: str) -> DataFrame:
        """Passed and asked by category and status, of golden questions {q, expect | expect_none, category} in a JSON file."""
        with open(path) as f:
            asked = json.load(f)
        asked = asked["questions"] if isinstance(asked, dict) else asked
        found = Investigator(self.archive, self.settings, self.model)
        rows = [(q.get("category", "all"), a.status, a.headline, q.get("expect", ""), bool(q.get("expect_none"))) for q, a in zip(asked, found.ask_many([q["q"] for q in asked]), strict=True)]
        answers = self.archive.spark.createDataFrame(rows, "category string, status string, answer string, expect string, expect_none boolean")
        return evidence.evaluation(evidence.judged(answers))
