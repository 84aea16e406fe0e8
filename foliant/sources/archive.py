"""The archive: discovery, twins, ingestion to tables, idempotent updates and statistics.

Files are read by Spark's binary source on any file system it knows; parsing and chunking run inside
tasks, a file at a time, so nothing is collected.  An update parses and derives only from files that are
new, changed, or no longer superseded; rows of files that are gone or superseded leave every table.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.functions import vocab
from foliant.operators import facts as facts_of
from foliant.operators import graph, inverted, prose, vector
from foliant.operators.chunking import chunk
from foliant.session import ship
from foliant.sources.parsers import parse

CHUNKS = "chunk_id string, document_id string, content string, content_type string, page_start int, page_end int, section_path array<string>, char_start bigint, char_end bigint, table_ids array<string>, figure_ids array<string>, ocr_confidence double, source_format string, source_class string"
TABLES = "table_id string, document_id string, caption string, columns array<string>, rows array<array<string>>, section_path array<string>"
FIGURES = "figure_id string, document_id string, caption string, asset_path string, nearby_text string, ocr_text string"


@dataclass(frozen=True)
class Settings:
    """What a deployment may set; ``from_environment`` reads ``FOLIANT_ITERATIONS``, ``FOLIANT_WEIGHT_BM25`` and the like."""

    target: int = vocab.CHUNK_TARGET
    overlap: int = vocab.CHUNK_OVERLAP
    iterations: int = 12
    queries: int = 48
    seconds: float = 120.0
    stale_rounds: int = 2
    dimensions: int = vocab.LSA_DIMENSIONS
    vocabulary: int = vocab.VOCABULARY
    #: Seconds after which another writer may take over the claim of one that has not finished.
    claim_seconds: float = 6 * 3600.0
    weights: Mapping[str, float] = field(default_factory=lambda: dict(vocab.FUSION))

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Settings:
        plain = {f.name: type(f.default)(env[k]) for f in fields(cls) if f.name != "weights" and (k := f"FOLIANT_{f.name.upper()}") in env}
        weights = {w: float(env.get(f"FOLIANT_WEIGHT_{w.upper()}", v)) for w, v in vocab.FUSION.items()}
        return cls(**plain, weights=weights)


def discover(files: DataFrame, root: str) -> DataFrame:
    """Documents of a binary file scan: identity, class and title."""
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    relative = F.regexp_replace(path, F.lit("^/*" + _quoted(root.split(":", 1)[-1].strip("/")) + "/*"), F.lit(""))
    name = F.element_at(F.split("relative_path", "/"), -1)
    rows = files.select(F.col("path").alias("file_path"), F.lit(root).alias("root"), relative.alias("relative_path"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), "content").withColumn("source_format", C.source_format(F.col("relative_path")))
    rows = rows.filter(F.col("source_format").isNotNull() & ~name.startswith(".") & ~name.isin(*vocab.SKIP_NAMES))
    rows = rows.withColumns({"document_id": C.document_id(F.col("relative_path"), F.col("file_size"), F.col("file_hash")), "source_class": C.source_class(F.col("relative_path")), "title": C.title(F.col("relative_path"))})
    return rows.withColumn("reliability", C.reliability(F.col("source_class")))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"(?i)(\.scan)?\.[^./]+$", ""))


def twins(documents: DataFrame) -> DataFrame:
    """document_id, superseded_by: of files that differ by format alone, the preferred one stays."""
    suffix = F.lower(F.element_at(F.split("relative_path", r"\."), -1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in vocab.FORMAT_PREFERENCE]), suffix), F.lit(0)), F.lit(99))
    keyed = documents.select("document_id", _stem(F.col("relative_path")).alias("stem"), F.struct(rank.alias("rank"), "relative_path").alias("place"))
    winners = keyed.groupBy("stem").agg(F.min_by("document_id", "place").alias("winner"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(winners, "stem").filter("document_id != winner").select("document_id", F.col("winner").alias("superseded_by"))


def unchanged(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """What is new: the rest is stored under the same document_id and hash."""
    return discovered.join(stored.select("document_id", "file_hash"), ["document_id", "file_hash"], "left_anti")


_BLOCK_TYPE = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _BLOCK_TYPE[c.split()[1]]) for c in schema.split(", ")])


def parsed(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """document_id, chunks, tables, figures, pages, warnings: each file parsed and cut once, failures as warnings."""
    ship(documents.sparkSession)
    chunk_type, table_type, figure_type = (pa.list_(pa.struct(list(_arrow(s)))) for s in (CHUNKS, TABLES, FIGURES))
    schema = f"document_id string, chunks array<struct<{_struct(CHUNKS)}>>, tables array<struct<{_struct(TABLES)}>>, figures array<struct<{_struct(FIGURES)}>>, warnings array<string>"

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                doc, fmt, kind, path = (batch[c][row].as_py() for c in ("document_id", "source_format", "source_class", "relative_path"))
                try:
                    found = parse(fmt, batch["content"][row].as_py(), doc, path)
                    chunks = [c | {"source_format": fmt, "source_class": kind} for c in chunk(doc, found.blocks, settings.target, settings.overlap)]
                    tables, figures, warnings = found.tables, found.figures, found.warnings
                except Exception as e:  # one bad file must not end an ingestion; it is reported
                    chunks, tables, figures, warnings = [], [], [], [f"{type(e).__name__}: {e}"]
                own = {"document_id": doc}
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([chunks], chunk_type), pa.array([[t | own for t in tables]], table_type), pa.array([[f | own for f in figures]], figure_type), pa.array([warnings], pa.list_(pa.string()))], names=["document_id", "chunks", "tables", "figures", "warnings"])

    return documents.select("document_id", "source_format", "source_class", "relative_path", "content").mapInArrow(run, schema)


def _struct(schema: str) -> str:
    return ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in schema.split(", "))


def report(found: DataFrame, documents: DataFrame, done: DataFrame, stored: DataFrame | None) -> DataFrame:
    """discovered, ingested, unchanged, superseded, failed, chunks, tables, figures, pages_needing_ocr, errors."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    bad = (F.size("chunks") == 0) & (F.size("warnings") > 0)
    made = done.agg(F.count("*").alias("ingested"), F.count_if(bad).alias("failed"), size("chunks").alias("chunks"), size("tables").alias("tables"), size("figures").alias("figures"), F.count_if(F.exists("warnings", lambda w: F.contains(F.lower(w), F.lit("ocr")))).alias("pages_needing_ocr"), size("warnings").alias("errors"))
    rows = documents.join(found.select("document_id"), "document_id", "left_semi")
    told = rows.agg(F.count("*").alias("discovered"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"))
    same = unchanged(found, stored) if stored is not None else found
    return told.join(made).withColumn("unchanged", F.col("discovered") - F.lit(same.count()))


#: Versions that may build upon a whole one before the next whole one is written.
DELTAS = 16
#: A latent space is made anew once rows that came or went since it was made exceed this share of its rows, or once the rows folded
#: in keep so much less of their squared length than its own rows do.
REFIT_ROWS, REFIT_LOSS = 0.25, 0.15
SPACE_STATE = "fit_version int, fit_rows bigint, fit_energy double, fit_captured double, folded bigint, gone bigint, energy double, captured double"


#: The columns that rows of a table are looked up by.  Tables are written in ranges of them, sorted, in small row groups with Bloom filters, so
#: that a lookup reads the row groups whose statistics allow its keys.
CLUSTERED = {"documents": "document_id", "chunks": "chunk_id", "facts": "subject_id", "edges": "subject_id", "mentions": "entity_id", "entities": "entity_id", "figures": "figure_id", "tables": "table_id"}
ROW_GROUP = 8 << 20


def clustered(df: DataFrame, name: str, whole: bool = True):
    """The writer of a table, by what it is looked up by; what changed is sorted where it lies, without an exchange."""
    key = CLUSTERED.get(name)
    if key is None or key not in df.columns:
        return df.write
    out = (df.repartitionByRange(key) if whole else df).sortWithinPartitions(key).write
    return out.option("parquet.block.size", ROW_GROUP).option(f"parquet.bloom.filter.enabled#{key}", "true")


class Conflict(RuntimeError):
    """Another writer has claimed the next version of an archive."""


class Archive:
    """Tables of an archive under one folder.  Every write is a new version, claimed first and named by a pointer last; it holds
    the rows of the documents that it parsed and the ids of those that left, until one in ``DELTAS`` is whole again."""

    #: Rows of a document, by its id; then those derived from all rows at once.
    BY_DOCUMENT = ("chunks", "tables", "figures", "warnings", "edges", "mentions", "facts")
    NAMES = ("documents", *BY_DOCUMENT, "entities")
    VECTORS = ("vectors", "vector_space")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _history(self) -> list[tuple[int, bool]]:
        """Versions in order, and whether each is whole; the others hold what changed since the one before."""
        try:
            rows = self.spark.read.text(f"{self.path}/versions").collect()  # one short row per ingestion
        except AnalysisException:
            return []
        return sorted((int(r.value.rstrip("+")), not r.value.endswith("+")) for r in rows)

    def _versions(self) -> list[int]:
        return [version for version, _ in self._history()]

    def table(self, name: str) -> DataFrame | None:
        """A table of the newest version; None where there is none."""
        held = self._history()
        return self._read(name, held) if held else None

    def _read(self, name: str, held: list[tuple[int, bool]]) -> DataFrame | None:
        """A table as of the last of some versions: rows of a document are those of the last version that parsed it, unless
        a later one took it out; other tables are whole in every version."""
        read = lambda version, part: self.spark.read.parquet(f"{self.path}/v{version}/{part}")
        try:
            first = max(v for v, whole in held if whole)
            if name in self.VECTORS and (state := self._space_state(held)) is not None:
                first = state.fit_version
                if name == "vector_space":
                    return read(first, name)
            elif name not in self.BY_DOCUMENT:
                return read(held[-1][0], name)
            since = [version for version, _ in held if version >= first]
            out = read(since[0], name).withColumn("held_at", F.lit(since[0]))
            if not since[1:]:
                return out.drop("held_at")
            for version in since[1:]:
                out = out.unionByName(read(version, name).withColumn("held_at", F.lit(version)), allowMissingColumns=True)
            gone = read(since[1], "gone").withColumn("gone_at", F.lit(since[1]))
            for version in since[2:]:
                gone = gone.unionByName(read(version, "gone").withColumn("gone_at", F.lit(version)))
            last = gone.groupBy("document_id").agg(F.max("gone_at").alias("gone_at"))
            return out.join(last, "document_id", "left").filter("gone_at IS NULL OR held_at >= gone_at").select([c for c in out.columns if c != "held_at"])
        except AnalysisException:
            return None

    def _space_state(self, held: list[tuple[int, bool]]):
        """The row of SPACE_STATE of the last of some versions; None where there is none."""
        path = f"{self.path}/v{held[-1][0]}/space_state" if held else ""
        return self.spark.read.schema(SPACE_STATE).parquet(path).first() if held and self._exists(path) else None

    def points(self, name: str, keys: list[str]) -> DataFrame | None:
        """The rows of a clustered table with some of its keys, named to the scan."""
        held = self.table(name)
        return None if held is None else held.filter(F.col(CLUSTERED[name]).isin(keys))

    def views(self, prefix: str = "") -> list[str]:
        """Names every table for ``spark.sql``."""
        found = {n: t for n in (*self.NAMES, *self.VECTORS) if (t := self.table(n)) is not None}
        for name, table in found.items():
            table.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in found]

    def ingest(self, root: str, settings: Settings = Settings(), only: str | None = None, limit: int | None = None, force: bool = False) -> DataFrame:  # noqa: B008
        """Reads a folder and updates the tables; returns the report.  ``only`` is a prefix of paths, ``limit`` the number of
        files, by path; ``force`` parses unchanged files too."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        found = discover(files, root)
        if only is not None:
            found = found.filter(F.col("relative_path").startswith(only))
        if limit is not None:
            found = found.join(F.broadcast(found.select("relative_path").orderBy("relative_path").limit(limit)), "relative_path", "left_semi")
        return self.update(found, settings, force)

    def update(self, found: DataFrame, settings: Settings = Settings(), force: bool = False) -> DataFrame:  # noqa: B008
        """Adds discovered documents; an older version of the same path leaves.  Twins are told among all that is held."""
        return self._write(found, None, settings, force)

    def remove(self, prefix: str) -> None:
        """Takes the documents whose path begins with ``prefix`` out of every table.  A twin that one of them superseded counts from now on:
        its file is read if it still is where it was found; else its document stays without rows, which ``unread`` tells."""
        old = self.table("documents")
        if old is None:
            return
        self._write(None, old.filter(F.col("relative_path").startswith(prefix)).select("document_id"), Settings(), False)
        waiting = self.unread()
        if waiting is None:
            return
        for root, paths in sorted((r.root, r.paths) for r in waiting.groupBy("root").agg(F.collect_set("file_path").alias("paths")).collect()):  # of twins of what was removed
            there = sorted(p for p in paths if self._exists(p))
            if there:
                self.update(discover(self.spark.read.format("binaryFile").load(there), root))

    def unread(self) -> DataFrame | None:
        """Documents that count but whose files have not been read: root, file_path, relative_path, document_id."""
        held = self.table("documents")
        if held is None or "file_path" not in held.columns:
            return None
        return held.filter("superseded_by IS NULL AND NOT parsed AND file_path IS NOT NULL").select("root", "file_path", "relative_path", "document_id")

    def reset(self) -> None:
        """Takes everything out."""
        self.remove("")

    def _file(self, path: str):
        """Hadoop's path and file system of a path."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(context._jsc.hadoopConfiguration())

    def _create(self, path: str, text: str) -> bool:
        """Creates a file that does not exist, as one act of its file system; False where it exists."""
        target, files = self._file(path)
        if files.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then; the system's own call does both at once
            place = target.toUri().getPath()
            os.makedirs(os.path.dirname(place), exist_ok=True)
            try:
                with open(place, "x") as f:
                    f.write(text)
            except FileExistsError:
                return False
            return True
        files.mkdirs(target.getParent())
        try:
            out = files.create(target, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or files.exists(target):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _claimed(self, version: int) -> tuple[str, float] | None:
        """Who claims a version, and since when."""
        path = f"{self.path}/claims/v{version}"
        if not self._exists(path):
            return None
        row = self.spark.read.text(path).first()
        token, _, since = (row.value if row else "").partition(" ")
        return token, float(since or 0)

    def _claim(self, version: int, settings: Settings = Settings()) -> str:  # noqa: B008
        """The token of this writer's claim.  A claim is one atomic create; one older than ``claim_seconds`` is moved aside, which only one of
        several writers can do."""
        path, token = f"{self.path}/claims/v{version}", uuid.uuid4().hex
        told = f"{token} {time.time()}"
        if self._create(path, told):
            return token
        held = self._claimed(version)
        if held is not None and held[1] and time.time() - held[1] > settings.claim_seconds:
            aside, files = self._file(f"{self.path}/claims/late-{held[0]}")
            if files.rename(self._file(path)[0], aside) and self._create(path, told):
                self._delete(f"{self.path}/v{version}")
                return token
        raise Conflict(f"version {version} of {self.path} is being written by another")

    def _commit(self, version: int, whole: bool, token: str) -> None:
        """The pointer to a version, if it is still this writer's."""
        held = self._claimed(version)
        if held is None or held[0] != token:
            raise Conflict(f"the claim of version {version} of {self.path} ran out and was taken over")
        self.spark.createDataFrame([(f"{version}{'' if whole else '+'}",)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/versions")

    def _write(self, found: DataFrame | None, removed: DataFrame | None, settings: Settings, force: bool) -> DataFrame | None:
        held = self._history()
        version = (held[-1][0] if held else 0) + 1
        whole = not held or version - max(v for v, w in held if w) >= DELTAS
        token = self._claim(version, settings)
        new = f"{self.path}/v{version}"

        def put(df: DataFrame, name: str) -> DataFrame:
            clustered(df, name, whole).mode("overwrite").parquet(f"{new}/{name}")
            return self.spark.read.parquet(f"{new}/{name}")

        old = {n: self._read(n, held) for n in self.NAMES} if held else {}
        stored = old["documents"] if held else None

        # documents: what is held and stays, and what is new; then twins among them
        meta = found.drop("content").withColumn("ingested_at", F.current_timestamp()) if found is not None else None
        rows = meta
        if held:
            stale = removed if removed is not None else stored.join(meta.select("relative_path"), "relative_path", "left_semi").join(meta.select("document_id"), "document_id", "left_anti").select("document_id")
            stays = stored.join(stale, "document_id", "left_anti").drop("superseded_by")
            rows = stays if meta is None else stays.unionByName(meta.join(stored.select("document_id"), "document_id", "left_anti"), allowMissingColumns=True)
        rows = rows.drop("parsed").join(twins(rows), "document_id", "left")
        before = stored.filter("parsed").select("document_id") if held else rows.select("document_id").limit(0)
        here = before.unionByName(meta.select("document_id")).distinct() if meta is not None else before
        rows = rows.join(here.withColumn("held", F.lit(True)), "document_id", "left")
        documents = put(rows.withColumn("parsed", F.col("superseded_by").isNull() & F.coalesce("held", F.lit(False))).drop("held"), "documents")

        # what to parse, and whose rows leave: those that no longer count as parsed
        current = documents.filter("parsed").select("document_id")
        parse_now = (current if force else current.join(before, "document_id", "left_anti")) if found is not None else current.limit(0)
        leave = before.join(current, "document_id", "left_anti")
        if found is not None:
            fresh = found.join(parse_now, "document_id", "left_semi")
            done = put(parsed(fresh, settings), "parsed")
            leave = leave.unionByName(done.select("document_id"))
            part = {n: put(done.select(F.explode(n).alias("x")).select("x.*"), f"new/{n}") for n in ("chunks", "tables", "figures")}
            part["warnings"] = done.select("document_id", F.explode("warnings").alias("message"))
            derived = self._derived(part, documents, None if not held else old["entities"])
            # what is written by range is read twice, so it is derived and written plainly first
            part |= {n: put(df, f"new/{n}") for n, df in derived.items()} if whole else derived
        leave = put(leave.distinct(), "gone")
        for name in self.BY_DOCUMENT:
            more = part[name] if found is not None else old[name].limit(0)
            put(old[name].join(leave, "document_id", "left_anti").unionByName(more) if whole and held else more, name)
        fresh_chunks = part["chunks"] if found is not None else old["chunks"].limit(0)
        self._index(f"{new}/index", held, whole, fresh_chunks, old["chunks"].join(leave, "document_id", "left_semi") if held else None)
        self._close(held, version, whole, put, settings, token)
        return None if found is None else report(found, documents, done, stored)

    def _index(self, path: str, held: list[tuple[int, bool]], whole: bool, fresh: DataFrame, leaving: DataFrame | None) -> None:
        """The lexical index of a version: a segment of what changed, or all that is held as one segment."""
        found, totals = inverted.entries(fresh, "chunk_id", "content"), inverted.totals_of(fresh, "content")
        before = self._index_of(held)
        if before is None:
            inverted.write(path, found, totals)
            return
        gone = leaving.select(F.col("chunk_id").alias("key"))
        less = inverted.totals_of(leaving, "content").select((-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens"))
        if whole:
            kept = inverted.packed(before.entries().join(gone, "key", "left_anti"))
            inverted.write(path, kept.unionByName(found), before.whole().select("n", "tokens").unionByName(totals).unionByName(less).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")))
        else:
            fewer = inverted.entries(leaving, "chunk_id", "content").groupBy("term").agg((-F.sum("n")).alias("df"))
            inverted.write(path, found, totals.unionByName(less), fewer, gone)

    def _index_of(self, held: list[tuple[int, bool]]) -> inverted.Index | None:
        """The index as of the last of some versions; None where a version was written without one."""
        if not held:
            return None
        since = [version for version, _ in held if version >= max(v for v, whole in held if whole)]
        segments = [(version, f"{self.path}/v{version}/index") for version in since]
        return inverted.Index(self.spark, segments) if all(self._exists(path) for _, path in segments) else None

    def index(self) -> inverted.Index | None:
        """The lexical index of the newest version."""
        return self._index_of(self._history())

    def _exists(self, path: str) -> bool:
        target, files = self._file(path)
        return files.exists(target)

    def _close(self, held: list[tuple[int, bool]], version: int, whole: bool, put, settings: Settings, token: str) -> None:
        """What is told from all rows at once, and then the pointer."""
        now = [*held, (version, whole)]
        chunks = self._read("chunks", now)
        put(graph.entities(chunks, self._read("documents", now)), "entities")
        self._embed(chunks, held, version, whole, put, settings)
        self._commit(version, whole, token)

    def _derived(self, part: dict[str, DataFrame], documents: DataFrame, entities: DataFrame | None) -> dict[str, DataFrame]:
        """Edges, mentions and facts of newly parsed chunks: each belongs to one chunk, so those of others stay as they are."""
        made = graph.build(part["chunks"], documents)
        known = graph.entities(part["chunks"], documents)
        if entities is not None:
            known = known.unionByName(entities.join(known, "entity_id", "left_anti"))
        facts = facts_of.extract(part["chunks"], documents).unionByName(prose.plate_facts(part["chunks"], part["figures"], documents, known))
        return {"edges": made["edges"], "mentions": made["mentions"], "facts": facts_of.deduplicated(facts)}

    def _embed(self, chunks: DataFrame, held: list[tuple[int, bool]], version: int, whole: bool, put, settings: Settings) -> None:
        """Vectors of all chunks that are not blank, by their first 2000 characters, and the space they live in.

        Between whole versions only new chunks get vectors, in the space that there is, until it no longer fits (see ``REFIT_ROWS``)."""
        texts_of = lambda df: df.filter("trim(content) != ''").select("chunk_id", "document_id", F.substring("content", 1, 2000).alias("content"))
        state = None if whole else self._space_state(held)
        if state is not None and state.fit_rows:
            fresh = texts_of(self.spark.read.parquet(f"{self.path}/v{version}/chunks"))
            left = self._read("vectors", held).join(self.spark.read.parquet(f"{self.path}/v{version}/gone"), "document_id", "left_semi").count()
            space = self._read("vector_space", held)
            folded = put(vector.fold_in(fresh, "chunk_id", "content", space).join(fresh.select("chunk_id", "document_id"), "chunk_id"), "folded")
            more = folded.agg(F.count("*").alias("n"), F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy"), F.coalesce(F.sum("captured"), F.lit(0.0)).alias("captured")).first()
            now = (state.fit_version, state.fit_rows, state.fit_energy, state.fit_captured, state.folded + more.n, state.gone + left, state.energy + more.energy, state.captured + more.captured)
            kept = lambda captured, energy: captured / energy if energy else 1.0
            if now[4] + now[5] <= REFIT_ROWS * state.fit_rows and kept(now[7], now[6]) >= kept(state.fit_captured, state.fit_energy) - REFIT_LOSS:
                put(folded.select("chunk_id", "embedding", "document_id"), "vectors")
                put(self.spark.createDataFrame([now], SPACE_STATE).coalesce(1), "space_state")
                return
        texts = texts_of(chunks)
        _, index, idf, parts = vector.lsa(texts, "chunk_id", "content", settings.dimensions, settings.vocabulary)
        space = [(term, float(idf[k]), [float(x) for x in parts[k]]) for term, k in index.items()]
        space = put(self.spark.createDataFrame(space, "term string, idf double, component array<double>").coalesce(1), "vector_space")
        made = put(vector.fold_in(texts, "chunk_id", "content", space).join(texts.select("chunk_id", "document_id"), "chunk_id"), "folded")
        put(made.select("chunk_id", "embedding", "document_id"), "vectors")
        whole_of = made.agg(F.count("*"), F.coalesce(F.sum("energy"), F.lit(0.0)), F.coalesce(F.sum("captured"), F.lit(0.0))).first()
        put(self.spark.createDataFrame([(version, *whole_of, 0, 0, 0.0, 0.0)], SPACE_STATE).coalesce(1), "space_state")

    def statistics(self) -> DataFrame:
        """Rows of each table, and the pages of current documents."""
        counts = [t.agg(F.count("*").alias(n)) for n in (*self.NAMES, "vectors") if (t := self.table(n)) is not None]
        pages = self.table("chunks").groupBy("document_id").agg(F.coalesce(F.max("page_end"), F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"))
        out = pages
        for c in counts:
            out = out.join(c)
        return out

    def abandon(self) -> None:
        """Gives up the claim of a writer that failed, with what it wrote; for callers that know it runs no more."""
        held = self._versions()
        version = (held[-1] if held else 0) + 1
        for path in (f"{self.path}/claims/v{version}", f"{self.path}/v{version}"):
            self._delete(path)

    def _delete(self, path: str) -> None:
        target, files = self._file(path)
        files.delete(target, True)

    def compact(self) -> None:
        """Writes all tables anew as a whole version, which later ones build upon."""
        held = self._history()
        if held and not held[-1][1]:
            version = held[-1][0] + 1
            token = self._claim(version)
            for name in (*self.NAMES, *self.VECTORS):
                clustered(self._read(name, held), name).mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
            if (state := self._space_state(held)) is not None:
                now = state.asDict() | {"fit_version": version}
                self.spark.createDataFrame([tuple(now.values())], SPACE_STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v{version}/space_state")
            if (index := self._index_of(held)) is not None:
                inverted.write(f"{self.path}/v{version}/index", inverted.packed(index.entries()), index.whole().select("n", "tokens"))
            self._commit(version, True, token)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Compacts, then deletes all versions but the last ``keep`` and those that they build upon; returns those that went."""
        self.compact()
        held = self._history()
        needed = min((max(v for v, whole in held if whole and v <= version) for version, _ in held[-keep:]), default=0) if keep else 0
        gone = [version for version, _ in held if version < needed]
        for version in gone:
            self._delete(f"{self.path}/v{version}")
        if gone:  # the pointer forgets them too
            self.spark.createDataFrame([(f"{v}{'' if whole else '+'}",) for v, whole in held if v >= needed], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions")
        return gone
