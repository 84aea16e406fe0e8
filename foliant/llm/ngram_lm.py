"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text's words, per language.

Units are words (A-Z lower-cased, 64-bit hashes seeded by language), ``order - 1`` marks before a text and
one after it; the order is a parameter, 3 by default.  The model is nothing but counts, in tables sharded by
the hash of the n-gram, all of which grow with the corpus:

    grams, order m     of the highest order its occurrences, below it its distinct predecessors
                       (occurrences, for those that start with a mark, which have but one predecessor)
    contexts, order m  the sum of the counts of what follows, and how many of them are 1, 2, and 3 or more
    languages          per order the counts of counts, which give the discounts; units and their sum

*Learning* goes order by order from the highest: groups of trusted texts send each shard their distinct
n-grams with counts; a shard adds them up and tells the shards of the order below.  Every sum is taken
per group or shard before it is sent, so a frequent n-gram is one row of each sender.  Single words are
added up last.  ``ROUNDS`` ranges of the word before the last one bound what a round holds.

*Scoring* is a join of the n-grams of all documents with those counts.  Documents go in ``BLOCKS`` blocks by
their hash, each read and cut to words once.  A task asks once for each n-gram of a group of texts;
requests go to the shard of their hash, which looks them up and answers; answers meet their group again,
where each word's probability is interpolated from the counts.  No n-gram makes a shard hot, as it
is asked for once a group.  Requests, answers and model are packed arrays of sorted hashes, cut to
``log2(trusted characters) + SPARE_BITS`` bits: an n-gram that the model lacks is taken for another one
with a probability of 2**-SPARE_BITS at most, whatever the size.  Nothing is broadcast but trusted ids
and languages, when counted to be few.

Half of the trusted documents, by a hash of the id, train the model; the other half, which it has not
seen, give each language its threshold, the ``QUANTILE`` of bits per word.  Fewer than ``LEAST_HELD``
documents have no such quantile but their largest; their language takes its own median times the pooled
quantile of bits per word over their language's median.  A document is kept if its bits per word are at
most the threshold.  Languages without training text use the model and threshold of all trusted text.

Defined results: a null or empty text, or one without words, has 0 words, 0 bits, perplexity 1 and is not
kept; a null language is one of its own; rows that repeat are scored alike; trusted ids that repeat count
once; without any trusted text nothing is measured and every text but null and empty ones is kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.storage import drop_table, keep, keep_while
from foliant.llm.tokens import U, mix, slices, text_bytes, word_hashes

ORDER = 3
#: Ranges of learning, and blocks of documents that are scored one after the other.
ROUND_BITS, BLOCKS = 2, 8
#: Units that are asked for together, and trusted characters to a shard of the model.
GROUP_WORDS, SHARD_CHARS = 1 << 20, 1 << 22
SPARE_BITS = 16
#: Trusted ids and languages that are broadcast.
TRUSTED_IDS, LANGUAGES = 2_000_000, 100_000
POOL = "*"
#: The share of held-out documents that a threshold keeps, and how many it takes to tell it.
QUANTILE, LEAST_HELD = 0.99, 100

_LEFT, _RIGHT, _START, _END = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0x6C62272E07BB0142), U(0x27D4EB2F165667C5)
#: Rows of the model have no slice, parcels to be added up slice 0, requests that of their group.
MODEL, PARCEL, ASK, OWN = -1, 0, 1000, 1001
LAST = 1 << 30
ROWS = "dest int, shard int, kind int, slice bigint, data array<binary>"
FIELDS = ("doc_id", "lang", "key", "sig", "seed")


@dataclass(frozen=True)
class Plan:
    """The order, the bits that tell a shard, and the bits of a hash that are compared."""

    order: int
    shard_bits: int
    width: int

    def cut(self, keys: np.ndarray) -> np.ndarray:
        return keys >> U(64 - self.width)

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """shard, from, to of sorted whole keys."""
        ends = np.searchsorted(keys >> U(64 - self.shard_bits), np.arange((1 << self.shard_bits) + 1, dtype=np.uint64))
        return ((k, int(a), int(z)) for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < z)

    @property
    def shards(self) -> int:
        return 1 << self.shard_bits


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _LEFT + mix(b * _RIGHT))


def marks(seeds: np.ndarray, order: int) -> list[np.ndarray]:
    """What stands before a text, per language."""
    return [mix(seeds ^ mix(_START + U(k))) for k in range(order - 1)]


def units(data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The units of texts, marks among them, and the text each belongs to."""
    hashes, at = word_hashes(data, bounds)
    per = np.diff(at)
    text = np.repeat(np.arange(len(per)), per + order)
    out = np.empty(len(text), np.uint64)
    first = at[:-1] - at[0] + order * np.arange(len(per))
    out[np.arange(len(hashes)) + order * np.repeat(np.arange(len(per)), per) + order - 1] = mix(hashes ^ np.repeat(seeds, per))
    for k, mark in enumerate(marks(seeds, order)):
        out[first + k] = mark
    out[first + per + order - 1] = mix(seeds ^ _END)
    return out, text


def keys_of(seq: np.ndarray, order: int) -> list[np.ndarray]:
    """The hashes of the n-grams of each order, by where they start."""
    out = [seq]
    for _ in range(order - 1):
        out.append(pair(out[-1][:-1], out[-1][1:]))
    return out


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of one n-gram a row, from its units."""
    return columns[0] if len(columns) == 1 else pair(key_of(columns[:-1]), key_of(columns[1:]))


def whole(text: np.ndarray, m: int) -> np.ndarray:
    """Whether the n-gram of order ``m`` that starts at a unit lies within one text."""
    return text[: len(text) - m + 1] == text[m - 1 :]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, so that the many zero ones vanish."""
    return zstandard.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1) if len(values) else b""


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def steps(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return packed(np.diff(values, prepend=U(0)))


def stepped(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple:
    """Sorted distinct keys, where each first stood, and the columns added up by key."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), *columns
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return sorted_keys[first], order[first], *(np.add.reduceat(c[order], first) for c in columns)


def _grouped(columns: list[list[bytes]]) -> list[np.ndarray]:
    """Parcels' columns, one after the other."""
    return [np.concatenate([unpacked(p[k]) for p in columns]) for k in range(len(columns[0]))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["dest", "shard", "kind", "slice", "data"])


def _language(c="lang"):
    """A key that tells null from every string."""
    return F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c)))


def _few(languages: DataFrame) -> DataFrame:
    """A kept table with a row a language, to be broadcast if counted to have at most ``LANGUAGES``."""
    return F.broadcast(languages) if languages.count() <= LANGUAGES else languages


def _groups(batches, fields: tuple[str, ...], order: int) -> Iterator[tuple]:
    """Texts in groups of about ``GROUP_WORDS`` units: the fields of their rows, units, and the text each unit belongs to."""
    held: list[tuple] = []
    size = texts = 0

    def whole_group():
        rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks().to_batches()[0]
        return rows, *(np.concatenate([x[k] for x in held]) for k in (1, 2))

    for batch in batches:
        data, bounds = text_bytes(batch["text"])
        seeds = batch["seed"].to_numpy().view(np.uint64)
        for lo, hi in slices(bounds):
            seq, text = units(data, bounds[lo : hi + 1], seeds[lo:hi], order)
            held.append((batch.select(list(fields)).slice(lo, hi - lo), seq, text + texts))
            size, texts = size + len(seq), texts + hi - lo
            if size >= GROUP_WORDS:
                yield whole_group()
                held, size, texts = [], 0, 0
    if held:
        yield whole_group()


# Learning: counts of trusted text, order by order


def occurrences(train: DataFrame, plan: Plan, turn: int) -> DataFrame:
    """Parcels of the highest order: units, count and language of the distinct n-grams of a group, by shard."""
    n, top = plan.order, 2 * plan.order

    def run(batches):
        for rows, seq, text in _groups(batches, ("seed",), n):
            seeds = rows["seed"].to_numpy().view(np.uint64)
            mine = whole(text, n)
            mine &= seq[n - 2 : n - 2 + len(mine)] >> U(64 - ROUND_BITS) == U(turn)
            at = np.flatnonzero(mine)
            keys, first, count = summed(keys_of(seq, n)[-1][at], np.ones(len(at), np.uint64))
            at = at[first]
            known, language = np.unique(seeds[text[at]], return_inverse=True)
            columns = [*(seq[at + k] for k in range(n)), count, language.astype(np.uint64)]
            out = [(k, k, top, PARCEL, [*(packed(c[a:z]) for c in columns), packed(known)]) for k, a, z in plan.parts(keys)]
            if out:
                yield _batch(out)

    return train.select("seed", "text").mapInArrow(run, ROWS)


def _languages(plan: Plan, seeds: np.ndarray, m: int, count: np.ndarray) -> list[tuple]:
    """Parcels of the counts of counts of one order; of order 1 the sum and number too."""
    known, language = np.unique(seeds, return_inverse=True)
    table = np.zeros((4 * plan.order + 2, len(known)), np.uint64)
    for k in range(1, 5):
        table[4 * (m - 1) + k - 1] = np.bincount(language[count == U(k)], minlength=len(known))
    if m == 1:
        np.add.at(table[-2], language, count)
        table[-1] = np.bincount(language, minlength=len(known))
    return [(k, k, 0, PARCEL, [packed(known[a:z]), *(packed(c[a:z]) for c in table)]) for k, a, z in plan.parts(known)]


def _told(plan: Plan, m: int, grams: list[list[bytes]], contexts: list[list[bytes]]) -> Iterator[tuple]:
    """The model's rows of order ``m`` in one shard, and parcels for the order below, from all its parcels."""
    if contexts:
        keys, *columns = _grouped(contexts)
        keys, _, *columns = summed(keys, *columns)
        yield from ((k, k, 2 * m + 1, MODEL, [steps(plan.cut(keys[a:z])), *(packed(c[a:z]) for c in columns)]) for k, a, z in plan.parts(keys))
    if not grams:
        return
    parts = [[unpacked(x) for x in p] for p in grams]
    *columns, count = (np.concatenate([p[k] for p in parts]) for k in range(m + 1))
    seeds = np.concatenate([p[m + 2][p[m + 1].astype(np.int64)] for p in parts])
    keys, first, count = summed(key_of(columns), count)
    columns, seeds = [c[first] for c in columns], seeds[first]
    yield from ((k, k, 2 * m, MODEL, [steps(plan.cut(keys[a:z])), packed(count[a:z])]) for k, a, z in plan.parts(keys))
    yield from _languages(plan, seeds, m, count)
    if m == 1:
        return
    marked = np.zeros(len(keys), bool)
    for mark in marks(seeds, plan.order):
        marked |= columns[1] == mark
    tails, first, types = summed(key_of(columns[1:]), np.where(marked, count, U(1)))
    known, language = np.unique(seeds[first], return_inverse=True)
    sent = [*(c[first] for c in columns[1:]), types, language.astype(np.uint64)]
    yield from ((k, k, 2 * m - 2, PARCEL, [*(packed(c[a:z]) for c in sent), packed(known)]) for k, a, z in plan.parts(tails))
    one, two = count == U(1), count == U(2)
    heads, _, *sums = summed(key_of(columns[:-1]), count, *(x.astype(np.uint64) for x in (one, two, ~one & ~two)))
    yield from ((k, k, 2 * m - 1, PARCEL, [packed(c[a:z]) for c in (heads, *sums)]) for k, a, z in plan.parts(heads))


def spread(number: int, parts: int) -> int:
    """A place for a group's own row, which numbers that count from each task's first would put side by side."""
    return int(mix(np.array([number], np.uint64))[0]) % parts


def exchanged(rows: DataFrame, plan: Plan) -> DataFrame:
    return rows.repartitionById(plan.shards, "dest").sortWithinPartitions("dest", "slice", "kind")


def reduced(parcels: DataFrame, plan: Plan, m: int) -> DataFrame:
    """The model's rows of order ``m`` (0: languages) and parcels for lower orders; other rows pass."""

    def told(held):
        grams, contexts = held.get(2 * m, []), held.get(2 * m + 1, [])
        if m:
            rows = list(_told(plan, m, grams, contexts))
        else:
            keys, *columns = _grouped(grams) if grams else [np.zeros(0, np.uint64)]
            keys, _, *columns = summed(keys, *columns)
            rows = [(k, k, 0, MODEL, [steps(plan.cut(keys[a:z])), *(packed(c[a:z]) for c in columns)]) for k, a, z in plan.parts(keys)]
        return [_batch([r]) for r in rows]

    def run(batches):
        at, held = None, {}
        for batch in batches:
            dest, kind, part = (batch[c].to_numpy() for c in ("dest", "kind", "slice"))
            mine = (part == PARCEL) & ((kind == 2 * m) | (kind == 2 * m + 1) & (m > 0))
            if not mine.all():
                yield batch.filter(pa.array(~mine))
            for k in np.flatnonzero(mine).tolist():
                if dest[k] != at:
                    yield from told(held)
                    at, held = dest[k], {}
                held.setdefault(int(kind[k]), []).append(batch["data"][k].as_py())
        yield from told(held)

    return exchanged(parcels, plan).mapInArrow(run, ROWS)


def learn(train: DataFrame, plan: Plan) -> DataFrame:
    """The model, packed and sharded, of a kept table (seed, text), which goes."""

    def one_round(turn):
        rows = occurrences(train, plan, turn)
        for m in range(plan.order, 1, -1):
            rows = reduced(rows, plan, m)
        return rows

    told = [keep_while(lambda turn=turn: one_round(turn), f"round{turn}", "slice") for turn in range(1 << ROUND_BITS)]
    drop_table(train)
    rows = told[0]
    for more in told[1:]:
        rows = rows.unionByName(more)
    low = keep_while(lambda: reduced(reduced(rows.filter(F.col("slice") == PARCEL), plan, 1), plan, 0), "words")
    drop_table(rows, f"slice={PARCEL}")
    return rows.filter(F.col("slice") == MODEL).unionByName(low)


# Scoring: documents' n-grams meet the counts


def requests(docs: DataFrame, plan: Plan, row: str) -> DataFrame:
    """What each group of texts asks of each shard, and a row for itself that goes along."""
    n = plan.order

    def run(batches):
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() + 1) << 32
        for rows, seq, text in _groups(batches, FIELDS, n):
            number += 1
            asked = [distinct(rows["seed"].to_numpy().view(np.uint64)), *(distinct(k[whole(text, m + 1)]) for m, k in enumerate(keys_of(seq, n)))]
            lists: dict[int, list[bytes]] = {}
            for level, keys in enumerate(asked):
                for k, a, z in plan.parts(keys):
                    lists.setdefault(k, [b""] * len(asked))[level] = steps(distinct(plan.cut(keys[a:z])))
            known, at = np.unique(seq, return_inverse=True)
            out = [*((k, k, ASK, number, data) for k, data in lists.items()), (spread(number, plan.shards), LAST, OWN, number, [steps(known), packed(at), packed(np.bincount(text, minlength=len(rows)))])]
            own = pa.StructArray.from_arrays([rows[c] for c in FIELDS], list(FIELDS))
            batch = _batch(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array([0] * len(out) + [len(rows)], pa.int32()), own)], names=[*batch.schema.names, "rows"])

    return docs.select(*FIELDS, "text").mapInArrow(run, f"{ROWS}, rows array<struct<{row}, seed: bigint>>")


def _looked_up(wanted: np.ndarray, table: list[np.ndarray], wide: int) -> list[np.ndarray]:
    """The columns of the wanted keys, 0 where the table lacks them."""
    out = [np.zeros(len(wanted), np.uint64) for _ in range(wide)]
    if len(wanted) and table and len(table[0]):
        keys, *columns = table
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        same = keys[place] == wanted
        for o, c in zip(out, columns, strict=True):
            o[same] = c[place[same]]
    return out


def wide(plan: Plan) -> list[tuple[int, int]]:
    """Kind and columns of what answers each list of a request: languages, then order by order grams and contexts."""
    out = [[(0, 4 * plan.order + 2)]]
    for m in range(1, plan.order + 1):
        out.append([(2 * m, 1)] + [(2 * m + 1, 4)] * (m < plan.order))
    return out


def answers(asked: DataFrame, model: DataFrame, plan: Plan) -> DataFrame:
    """What the shards answer to each request, list by list; groups' own rows pass."""
    form = wide(plan)

    def run(batches):
        at, rows, tables = None, {}, None
        for batch in batches:
            dest, kind = batch["dest"].to_numpy(), batch["kind"].to_numpy()
            own = kind == OWN
            if own.any():
                yield batch.filter(pa.array(own))
            for k in np.flatnonzero(~own).tolist():
                if dest[k] != at:
                    at, rows, tables = dest[k], {}, None
                data = batch["data"][k].as_py()
                if kind[k] != ASK:
                    rows.setdefault(int(kind[k]), []).append(data)
                    continue
                if tables is None:
                    tables = {}
                    for what, parts in rows.items():
                        columns = [np.concatenate([stepped(p[0]) for p in parts]), *(np.concatenate([unpacked(p[c]) for p in parts]) for c in range(1, len(parts[0])))]
                        order = np.argsort(columns[0], kind="stable")
                        tables[what] = [c[order] for c in columns]
                    rows = {}
                out = []
                for asked_keys, tabs in zip(data, form, strict=True):
                    wanted = stepped(asked_keys)
                    got = [c for what, n in tabs for c in _looked_up(wanted, tables.get(what, []), n)]
                    out.append(packed(np.concatenate(got)))
                one = _batch([(0, batch["shard"][k].as_py(), ASK, batch["slice"][k].as_py(), out)])
                yield pa.RecordBatch.from_arrays([*one.columns, pa.nulls(1, batch.schema.field("rows").type)], names=batch.schema.names)

    both = asked.unionByName(model, allowMissingColumns=True)
    return exchanged(both, plan).mapInArrow(run, asked.schema)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What n-grams of count 0, 1, 2 and more lose, from the counts of counts 1 to 4, a column a language."""
    n = counts.astype(np.float64)
    full = (n[:3] > 0).all(axis=0)
    out = np.zeros((4, n.shape[1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            out[k] = np.where(full, np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.1, k), 0.5 * k)
    return out


def bits_of(seq: np.ndarray, text: np.ndarray, language: np.ndarray, texts: int, found: list[np.ndarray], plan: Plan) -> np.ndarray:
    """-log2 p of each text, from the answers: of languages, then of the distinct n-grams of each order."""
    n = plan.order
    at = []
    for m, keys in enumerate(keys_of(seq, n), 1):
        inside = whole(text, m)
        place = np.zeros(len(keys), np.int64)
        place[inside] = np.unique(plan.cut(keys[inside]), return_inverse=True)[1]
        at.append(place)
    start = np.flatnonzero(whole(text, n))
    end, lang = start + n - 1, language[text[start]]
    table = found[0]
    all_, types = table[-2].astype(np.float64), table[-1].astype(np.float64)
    lost = [discounts(table[4 * m : 4 * m + 4]) for m in range(n)]
    seen = table[:2].astype(np.float64)
    mass = lost[0][1] * seen[0] + lost[0][2] * seen[1] + lost[0][3] * (types - seen[0] - seen[1])
    sure = np.maximum(all_, 1)
    unknown = mass / sure / (types + 1)

    def left(m, count):
        return count.astype(np.float64) - lost[m - 1][np.minimum(count, 3).astype(np.int64), lang]

    p = left(1, found[1][0][at[0][end]]) / sure[lang] + unknown[lang]
    p = np.where(all_[lang] > 0, p, 1.0)
    for m in range(2, n + 1):
        first = end - m + 1
        total, *classes = (c[at[m - 2][first]].astype(np.float64) for c in found[m - 1][1:])
        rest = sum(lost[m - 1][k][lang] * c for k, c in enumerate(classes, 1))
        some = np.maximum(total, 1)
        p = np.where(total > 0, left(m, found[m][0][at[m - 1][first]]) / some + rest / some * p, p)
    return np.bincount(text[start], weights=-np.log2(p), minlength=texts)


def sums(answered: DataFrame, plan: Plan, row: str) -> DataFrame:
    """doc_id, lang, key, sig, words, bits of every document."""
    form = wide(plan)

    def run(batches):
        at, found = None, []
        for batch in batches:
            for k in range(len(batch)):
                number = batch["slice"][k].as_py()
                if number != at:
                    at, found = number, []
                data = batch["data"][k].as_py()
                if batch["kind"][k].as_py() == ASK:
                    found.append(data)
                    continue
                rows = pa.RecordBatch.from_struct_array(batch["rows"].slice(k, 1).flatten())
                known, place, size = stepped(data[0]), unpacked(data[1]), unpacked(data[2]).astype(np.int64)
                seq, text = known[place.astype(np.int64)], np.repeat(np.arange(len(rows)), size)
                tables = []
                for level, tabs in enumerate(form):
                    columns = sum(c for _, c in tabs)
                    tables.append(np.concatenate([unpacked(f[level]).reshape(columns, -1) for f in found], axis=1))
                language = np.unique(plan.cut(rows["seed"].to_numpy().view(np.uint64)), return_inverse=True)[1]
                words = size - plan.order
                bits = np.where(words > 0, bits_of(seq, text, language, len(rows), tables, plan), 0.0)
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in FIELDS[:4]), pa.array(words), pa.array(bits)], names=[*FIELDS[:4], "words", "bits"])
                found = []

    parts = max(plan.shards, int(answered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = answered.repartition(parts, "slice").sortWithinPartitions("slice", "shard")
    return ordered.mapInArrow(run, f"{row}, words bigint, bits double")


def _quantiles(rows: DataFrame) -> DataFrame:
    """key, held, median, high, from counts n of documents by (key, at)."""
    whole_key = Window.partitionBy("key")
    upto = whole_key.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = rows.withColumn("share", F.sum("n").over(upto) / F.sum("n").over(whole_key))
    q = lambda x: F.min(F.when(F.col("share") >= x, F.col("at")))
    return share.groupBy("key").agg(F.sum("n").alias("held"), q(0.5).alias("median"), q(QUANTILE).alias("high"))


def thresholds(good: DataFrame) -> DataFrame:
    """key, threshold, per language and for all, from scored documents' bits per unit in thousandths."""
    good = good.filter("words > 0").select("key", F.round(1000 * F.col("bits") / (F.col("words") + 1)).cast("bigint").alias("at"))
    counts = keep(good.groupBy("key", "at").agg(F.count("*").alias("n")), "held")
    own = _quantiles(counts.unionByName(counts.groupBy("at").agg(F.sum("n").alias("n")).select(F.lit(POOL).alias("key"), "at", "n")))
    of = own.filter(F.col("key") != POOL).select("key", "median")
    excess = counts.join(_few(of), "key").select(F.round(1000 * F.col("at") / F.col("median")).cast("bigint").alias("at"), "n")
    pooled = _quantiles(excess.groupBy("at").agg(F.sum("n").alias("n")).withColumn("key", F.lit(POOL))).select((F.col("high") / 1000).alias("excess"))
    enough = (F.col("held") >= LEAST_HELD) | (F.col("key") == POOL)
    return own.crossJoin(F.broadcast(pooled)).select("key", (F.when(enough, F.col("high")).otherwise(F.col("median") * F.col("excess")) / 1000).alias("threshold"))


def score(docs: DataFrame, training: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, key, sig, words, bits for every row of ``docs``, under the model of the texts of ``training`` ids (trusted_id)."""
    kinds = dict(docs.dtypes)
    row = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, key string, sig bigint"
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", _language())
    ids = F.broadcast(training) if training.count() <= TRUSTED_IDS else training
    seed = F.xxhash64("key")
    train = keep(rows.join(ids, rows["doc_id"] == ids["trusted_id"], "left_semi").select("key", seed.alias("seed"), "text"), "train")
    known = keep(train.select("key").distinct().withColumn("known", F.lit(True)), "known")
    near = _few(known)
    if not rows.select("key").distinct().join(near, "key", "left_anti").isEmpty():  # all trusted text once more, for languages that have none
        train = train.unionByName(train.withColumn("seed", F.xxhash64(F.lit(POOL))))
    chars = train.agg(F.sum(F.length("text"))).first()[0] or 0
    shard_bits = min(20, max(4, (chars // SHARD_CHARS).bit_length()))
    plan = Plan(order, shard_bits, min(64, chars.bit_length() + SPARE_BITS))
    model = learn(train, plan)
    keyed = rows.join(near, "key", "left").withColumn("key", F.when(F.col("known"), F.col("key")).otherwise(F.lit(POOL))).withColumn("seed", seed).withColumn("sig", F.xxhash64("text"))
    block = F.pmod(F.xxhash64("doc_id", "sig"), F.lit(BLOCKS))
    scored = [keep_while(lambda k=k: sums(answers(requests(keyed.filter(block == k), plan, row), model, plan), plan, row), f"block{k}") for k in range(BLOCKS)]
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    return out


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, words, bits_per_word, perplexity, threshold, kept for every row of ``docs``."""
    ids = trusted_ids.select(F.col("doc_id").alias("trusted_id")).filter("trusted_id IS NOT NULL").distinct()
    ids = keep(ids.withColumn("fold", F.pmod(F.xxhash64("trusted_id"), F.lit(2))), "trusted")
    scored = score(docs, ids.filter("fold = 0").drop("fold"), order)
    held = ids.filter("fold = 1")
    limits = keep(thresholds(scored.join(held, scored["doc_id"] == held["trusted_id"], "left_semi")), "limits")
    pooled = limits.filter(F.col("key") == POOL).first()
    per = F.col("bits") / (F.col("words") + 1)
    out = scored.join(_few(limits), "key", "left")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(pooled["threshold"] if pooled else None).cast("double"))).withColumn("bits_per_word", per)
    good = (F.col("words") > 0) & (F.round(1000 * per) <= 1000 * F.col("threshold"))
    kept = F.when(F.col("threshold").isNull(), F.col("sig") != F.xxhash64(F.lit(""))).otherwise(good)
    return out.select("doc_id", "lang", "words", "bits_per_word", F.pow(F.lit(2.0), "bits_per_word").alias("perplexity"), "threshold", kept.alias("kept"))
