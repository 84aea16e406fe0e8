"""PII by patterns, and information-theoretic sanitisation of the terms that reveal it.

Protected entities are the values that the patterns find; tokens of high entropy, such as keys, are spans of
kind ``secret`` beside them.  A term is a word of
a text that holds an entity, wherever it stands.  Over the corpus, with counts of distinct texts (copies of a text count once),

    PMI(t, e) = log2(N p(e | t) / c(e))        p(e | t) = (c(t, e) + S c(e) / N) / (c(t) + S)
    IC(e) = log2(N / c(e))

say how much a term tells about an entity, and how much there is to tell; ``S``, ``SMOOTHING``, adds
texts that hold the entity no more often than all do, so few texts say less than many.  Terms with
``PMI >= DISCLOSURE * IC`` disclose the entity if there is evidence beyond one chance meeting: that more than half of the term's
texts hold the entity must be sure to ``SURE`` standard errors, which takes two texts at least, or the term must stand beside
the entity somewhere, among the ``BESIDE`` terms nearest to it on a side and at most ``GAP`` characters away.  They become spans
of kind ``term`` wherever they stand in texts that hold the entity.  ``sanitise`` generalises spans to their kind and removes terms.

Counts cover all documents.  One scan gathers entities and terms and writes them to the shared folder;
a second counts all words.  No term over ``most(c(e))`` can pass, whatever it shares with the entity,
so frequent words go before terms meet entities.

Defined results: a null text is empty and has no spans; rows that repeat, or share a doc_id, are
documents of their own; spans of one kind never overlap, those of different kinds may; an empty table
gives an empty result; other columns pass through ``sanitise``.  Patterns run in time linear in the
text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.storage import keep
from foliant.llm.tokens import MARK_BYTES, slices, text_bytes, word_hashes

KINDS = ("email", "ip", "card", "phone", "secret", "term")
DISCLOSURE, SMOOTHING, SALTS = 0.8, 2.0, 16
#: Evidence: standard errors, terms on a side of an entity, characters between.
SURE, BESIDE, GAP = 1.28, 2, 40
#: Secrets: bits a character, and characters to a change between letters and digits.
ENTROPY, CHANGES = 3.0, 6
#: Bits a copied text in the bitmap of them, the bitmap's least and most bits (128 MB), words a task holds before it adds them up, and frequent
#: words that are broadcast.
ROOM, SLOTS, MOST_SLOTS, HELD, OFTEN = 16, 1 << 20, 1 << 30, 1 << 21, 100_000
#: Bits of one piece of a bitmap that Spark builds.
PIECE = 8 * 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't start inside a run of digits: it would have started at the run's head.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}")
#: Separators are those of ``MARK_BYTES``, so that terms are words that are counted.
_TERM = re.compile(r"[^\x09-\x0d\x20!-/:-@\[-`{-~]{3,}")


def _emails(text: str):
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` matches, found from each @ on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normal form) of the base spans, by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", a, z, text[a:z].lower()) for a, z in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end(), m[0]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 9 <= len(digits) <= 15:
                out.append(("phone", m.start(), m.end(), digits))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secrets(text: str, taken) -> list[tuple[str, int, int]]:
    """Tokens that no word or number looks like: keys and the like, by the entropy of their characters and by how often
    letters and digits change; none inside the ``taken`` spans."""
    out = []
    for m in _TOKEN.finditer(text):
        token, n = m[0], m.end() - m.start()
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
        if CHANGES * changes >= n and any(c.isalpha() for c in token):
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
            if entropy >= ENTROPY and not any(a < m.end() and m.start() < z for _, a, z, _ in taken):
                out.append(("secret", m.start(), m.end()))
    return out


def text_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def terms_of(text: str, spans) -> list[tuple[str, int, int]]:
    """(term, start, end): the terms of a text that holds spans, but for those in spans."""
    taken = np.zeros(len(text) + 1, np.int64)
    for _, a, z, _ in spans:
        taken[a + 1 : z + 1] = 1
    before = np.cumsum(taken)
    return [(m[0], m.start(), m.end()) for m in _TERM.finditer(text) if before[m.start()] == before[m.end()]]


def beside_of(spans, near) -> list[tuple[int, int]]:
    """(number of a span, number of a term): the terms that stand beside spans, both by start."""
    starts, ends = [x[1] for x in near], [x[2] for x in near]
    out = []
    for k, (_, a, z, _) in enumerate(spans):
        left, right = bisect_right(ends, a), bisect_left(starts, z)
        out += [(k, t) for t in range(max(0, left - BESIDE), left) if a - ends[t] <= GAP]
        out += [(k, t) for t in range(right, min(len(near), right + BESIDE)) if starts[t] - z <= GAP]
    return out


def _hashes(words: list[str]) -> np.ndarray:
    """One hash per word, as the words of whole texts are hashed."""
    data, bounds = text_bytes(pa.array(words, pa.large_string()))
    return word_hashes(data, bounds, MARK_BYTES)[0].view(np.int64)


SCANNED = "rid bigint, doc_id {}, h bigint, spans array<struct<kind:string,start:bigint,end:bigint>>, entities array<string>, terms array<struct<term:bigint,start:bigint,end:bigint>>, beside array<struct<entity:string,term:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """rid, doc_id, hash of the text, spans, entities, terms that may disclose them, and which stand beside which, for every row."""
    kind = dict(docs.dtypes)["doc_id"]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    term_type = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    pair_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.int64())]))

    def run(batches):
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            hashes, spans, entities, terms, beside = [], [], [], [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                found = find(text)
                hidden = secrets(text, found)
                near = terms_of(text, found + [(*x, "") for x in hidden]) if found else []
                hashes.append(text_hash(text.encode()))
                placed = sorted([x[:3] for x in found] + hidden, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                spans.append([{"kind": k, "start": a, "end": z} for k, a, z in placed])
                entities.append(sorted({f"{k}:{value}" for k, _, _, value in found}))
                hashed = _hashes([x[0] for x in near]).tolist() if near else []
                terms.append([{"term": t, "start": x[1], "end": x[2]} for x, t in zip(near, hashed, strict=True)])
                beside.append([{"entity": e, "term": t} for e, t in sorted({(f"{found[k][0]}:{found[k][3]}", hashed[t]) for k, t in beside_of(found, near)})])
            rids = pa.array(np.arange(rid, rid + len(batch)), pa.int64())
            rid += len(batch)
            yield pa.RecordBatch.from_arrays([rids, batch["doc_id"], pa.array(hashes, pa.int64()), pa.array(spans, span_type), pa.array(entities, pa.list_(pa.string())), pa.array(terms, term_type), pa.array(beside, pair_type)], names=["rid", "doc_id", "h", "spans", "entities", "terms", "beside"])

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED.format(kind))


def document_counts(docs: DataFrame, scanned: DataFrame, held: int = HELD) -> DataFrame:
    """term, n: in how many distinct texts of ``docs`` each word occurs.

    Words of texts that have no copy are added up by each task; the others, told by a bitmap that may take a few
    more for copies, go by the hash of their text, which keeps one of each.  The bitmap grows with the copied texts up to ``MOST_SLOTS``;
    beyond that more texts are taken for copies, which costs a shuffle of their words and changes no count.
    """
    copies = keep(scanned.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "copied")
    size = min(MOST_SLOTS, max(SLOTS, 1 << (ROOM * copies.count()).bit_length()))
    slot = F.pmod("h", F.lit(size).cast("bigint"))
    pieces = copies.groupBy(F.floor(slot / PIECE).alias("at")).agg(F.bitmap_construct_agg(slot % PIECE).alias("bits")).toArrow()  # size / 8 bytes
    copied = np.zeros(size // 8, np.uint8)
    for at, bits in zip(pieces["at"].to_pylist(), pieces["bits"].to_pylist(), strict=True):
        copied[at * PIECE // 8 : (at + 1) * PIECE // 8] = np.frombuffer(bits, np.uint8)
    shipped = docs.sparkSession.sparkContext.broadcast(copied.tobytes())
    names, lists = ["h", "terms", "term", "n"], pa.list_(pa.int64())

    def run(batches):
        bits = np.frombuffer(shipped.value, np.uint8)
        kept, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def merged():
            terms, n = (np.concatenate([kept[k], *(x[k] for x in waiting)]) for k in (0, 1))
            found, at = np.unique(terms, return_inverse=True)
            return found, np.bincount(at, n, len(found)).astype(np.int64)

        def told(terms, n):
            none = pa.nulls(len(terms))
            return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(lists), pa.array(terms), pa.array(n)], names=names)

        for batch in batches:
            data, bounds = text_bytes(batch["text"])
            for lo, hi in slices(bounds):
                words, cuts = word_hashes(data, bounds[lo : hi + 1], MARK_BYTES)
                words, row = words.view(np.int64), np.repeat(np.arange(hi - lo), np.diff(cuts))
                order = np.lexsort((words, row))
                words, row = words[order], row[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
                words, row = words[new], row[new]
                hashes = np.array([text_hash(data[a:z].tobytes()) for a, z in zip(bounds[lo:hi].tolist(), bounds[lo + 1 : hi + 1].tolist(), strict=True)], np.int64)
                slot = hashes % size
                twin = (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
                waiting.append(np.unique(words[~twin[row]], return_counts=True))
                if twin.any():
                    ends = np.searchsorted(row, np.arange(hi - lo + 1))
                    at = np.flatnonzero(twin)
                    none = pa.nulls(len(at))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array([words[ends[k] : ends[k + 1]] for k in at], lists), none.cast(pa.int64()), none.cast(pa.int64())], names=names)
                if sum(len(x[0]) for x in waiting) >= held:
                    kept, waiting = merged(), []
                    if len(kept[0]) >= held:
                        yield told(*kept)
                        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if waiting or len(kept[0]):
            yield told(*merged())

    counted = keep(docs.select("text").mapInArrow(run, "h bigint, terms array<bigint>, term bigint, n bigint"), "counted")
    once = counted.filter("h IS NOT NULL").groupBy("h").agg(F.first("terms").alias("terms")).select(F.explode("terms").alias("term"), F.lit(1).cast("bigint").alias("n"))
    return counted.filter("h IS NULL").select("term", "n").unionByName(once).groupBy("term").agg(F.sum("n").alias("n"))


def most(c_entity, n: float, disclosure: float = DISCLOSURE):
    """The largest count of a term that can disclose an entity of ``c_entity`` documents."""
    power = F.pow if isinstance(c_entity, Column) else pow
    return (c_entity + SMOOTHING * c_entity / n) * power(n / c_entity, 1 - disclosure) - SMOOTHING


def disclosing(docs: DataFrame, scanned: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """h, entity, term, pmi, ic: the pairs over the disclosure threshold, for each text that holds both."""
    n = float(max(scanned.select("h").distinct().count(), 1))
    met = scanned.select("h", F.explode("entities").alias("entity")).distinct()
    sizes = keep(met.groupBy("entity").agg(F.count("*").alias("c_entity")), "sizes")
    largest = sizes.agg(F.max("c_entity")).first()[0]
    if largest is None:
        return docs.sparkSession.createDataFrame([], "h bigint, entity string, term bigint, pmi double, ic double")
    met = met.join(sizes, "entity").filter(F.col("c_entity") < n)
    # entities of one text alone are told alike: the first stands for them
    single = met.filter("c_entity = 1").groupBy("h").agg(F.min("entity").alias("entity")).withColumn("c_entity", F.lit(1).cast("bigint"))
    beside = scanned.select("h", F.explode("beside").alias("b")).select("h", "b.*").distinct().join(sizes, "entity")
    alone = beside.filter("c_entity = 1").select("h", "term").distinct().join(single.select("h", "entity"), "h").select("h", "entity", "term")
    beside = alone.unionByName(beside.filter("c_entity > 1").select("h", "entity", "term")).withColumn("beside", F.lit(1))
    met = keep(single.unionByName(met.filter("c_entity > 1").select("h", "entity", "c_entity")), "met")

    counts = keep(document_counts(docs, scanned).withColumnRenamed("n", "c_term"), "counts")
    limit = most(float(largest), n, disclosure)
    often = counts.filter(F.col("c_term") > limit).orderBy(F.desc("c_term"), "term").limit(OFTEN).select("term")
    near = scanned.select("h", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    near = near.join(F.broadcast(often), "term", "left_anti").distinct().join(counts.filter(F.col("c_term") <= limit), "term")
    pairs = near.join(met, "h").filter(F.col("c_term") <= most(F.col("c_entity"), n, disclosure) + 1e-6)
    pairs = keep(pairs.join(beside, ["h", "entity", "term"], "left"), "pairs")

    both = pairs.groupBy("entity", "term", "c_entity", "c_term").agg(F.count("*").alias("both"), F.max("beside").alias("beside"))
    rate = (F.col("both") + SMOOTHING * F.col("c_entity") / n) / (F.col("c_term") + SMOOTHING)
    ic = F.log2(n / F.col("c_entity"))
    sure = (F.col("both") / F.col("c_term") - 0.5) * F.sqrt("c_term") >= SURE / 2  # the score test of p(e | t) > 1/2
    judged = both.filter(sure | F.col("beside").isNotNull()).select("entity", "term", (F.log2(rate) + ic).alias("pmi"), ic.alias("ic")).filter((F.col("ic") > 0) & (F.col("pmi") >= disclosure * F.col("ic")))
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(judged, ["entity", "term", "salt"]).select("h", "entity", "term", "pmi", "ic")


def spans(docs: DataFrame) -> DataFrame:
    """rid, doc_id, spans (base), all_spans (with terms), by start, then kind."""
    scanned = keep(scan(docs), "pii")
    told = keep(disclosing(docs, scanned), "disclosing").groupBy("h").agg(F.collect_set("term").alias("told")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = scanned.filter(F.size("terms") > 0).select("rid", "h", "terms", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt")).join(told, ["h", "salt"])
    marked = F.filter("terms", lambda t: F.array_contains("told", t["term"]))
    extra = held.select("rid", F.transform(marked, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))).alias("extra"))
    order = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    keyed = F.transform(F.concat("spans", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))), lambda s: F.struct(s["start"], order[s["kind"]].alias("k"), s["kind"].alias("kind"), s["end"].alias("end")))
    placed = F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.filter("spans", lambda s: s["kind"] != "secret").alias("spans")
    return scanned.join(extra, "rid", "left").select("rid", "doc_id", base, placed.alias("all_spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def replaced(text: Column, found: Column) -> Column:
    """``text`` with its spans generalised to ``[KIND]``, overlapping ones as one, and terms removed."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), all_spans.to_pylist(), strict=True):
            parts, at, reach = [], 0, 0
            for s in spans if text is not None and spans is not None else ():
                if s["start"] < reach:
                    reach = max(reach, s["end"])
                    at = reach
                    continue
                parts += [text[at : s["start"]], "" if s["kind"] == "term" else f"[{s['kind'].upper()}]"]
                at = reach = s["end"]
            out.append(text if text is None else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return run(text, found)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts.  Equal texts have equal patterns, and terms disclose an entity in every text
    that holds it, so texts are matched to their spans by a 128-bit hash."""
    key = lambda c: F.md5(F.coalesce(c, F.lit("")))
    distinct = keep(docs.select(key(F.col("text")).alias("doc_id"), "text"), "texts")
    found = spans(distinct).filter(F.size("all_spans") > 0).groupBy("doc_id").agg(F.first("all_spans").alias("all_spans"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(F.col("text")).alias("doc_id"))
    met = row.join(found, "doc_id", "left")
    return met.select(*[(replaced(F.col("row.text"), F.col("all_spans")) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
