"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; documents of equal sets form
a class and are compared once.  Classes link when 100 * intersection >= 80 * union, found in steps:

1. *Order.*  A sketch of all shingles, of as many sums as keep their mean under ``MEAN`` (``2**SKETCH_BITS``
   to ``2**MOST_BITS``, a byte each), tells frequent shingles from rare ones: a shingle whose sum is under a
   bound, 255 at most whatever the input, occurs in fewer sets than that.  Rare shingles come first, in hash
   order, then frequent ones by rising class.  Any such order gives right results; the sketch only makes
   lists short.
2. *Extended prefixes.*  Linked sets of at least ``o = ceil(0.8 n)`` common shingles share at least
   min(``EXTEND``, o) among their first ``n - o + EXTEND``.  Rare prefix shingles are indexed one by
   one, frequent ones as 2-combinations (sets over ``LARGE`` shingles: one by one, both kinds in the
   overlap of sizes), so a list of one frequent shingle is never formed for small sets.
3. *Candidates.*  Lists meet by token shard as packed arrays.  Short lists give pairs, which must
   share as many prefix shingles as step 2 promises; a list over the bound gives a star of links, and
   the components of all stars are compared as groups, in blocks that fit a task.
4. *Verification* on the whole sets, then connected components of the links.

Defined results: words as in the contract; null or empty texts and texts without words have an empty
set, link with nothing and are their own component; fewer than five words are one shingle; rows that
repeat, or share a doc_id, are documents of their own; an empty table gives an empty result; other
columns are not read and ``one_per_group`` keeps them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.storage import drop_table, forget, keep
from foliant.llm.tokens import mix, runs, slices, text_bytes, word_hashes

WORDS = 5
PERCENT = 80
EXTEND = 8
SKETCH_BITS, MOST_BITS, MEAN, PARTS = 22, 26, 64, 64
#: Sets of more shingles index frequent ones singly.
LARGE = 280
#: Postings packed at once by a task, and aimed at per shard; sets per block of a group; salts of a hot class.
CHUNK, SHARD, BLOCK, SALTS = 1 << 20, 1 << 20, 1024, 16
#: Bytes of sets per block of a group, so that blocks of long texts hold fewer.
BLOCK_BYTES = 8 << 20

POSTING = np.dtype([("token", "<u8"), ("set", "<i8"), ("n", "<i4"), ("frequent", "<i2")])


def _common(n):
    """The least intersection of a link of a set of n."""
    return -(-PERCENT * n // 100)


def shingle_sets(batch):
    """(row, sorted distinct shingles) of a batch's texts; empty sets are left out."""
    data, bounds = text_bytes(batch["text"])
    for lo, hi in slices(bounds):
        words, cuts = word_hashes(data, bounds[lo : hi + 1])
        grams = runs(words, tuple(range(WORDS)))
        for k, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if z - a >= WORDS:
                found = np.sort(grams[a : z - WORDS + 1])
                yield lo + k, found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif z > a:
                yield lo + k, runs(words[a:z], tuple(range(z - a)))


def _signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _short(signature: bytes) -> int:
    return int.from_bytes(signature[:8], "little", signed=True)


def sketch_bits(docs: DataFrame) -> int:
    """The size of the sketch, by the characters of all texts, of which a word takes some six."""
    words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    return min(MOST_BITS, max(SKETCH_BITS, (words // MEAN).bit_length()))


def scan(docs: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Rows (doc_id, n, sig, text_hash) for documents and (part, counts) for a task's share of the sketch, whose sums end at 255."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        sketch = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            sig: list = [None] * len(batch)
            for row, shingles in shingle_sets(batch):
                n[row], sig[row] = len(shingles), _signature(shingles).hex()
                at = shingles >> np.uint64(64 - bits)
                held = sketch[at]
                sketch[at] = held + (held < 255)
            none = pa.nulls(len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(sig, pa.string()), batch["text_hash"], none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        parts = sketch.reshape(PARTS, -1)
        packed = [(k, zstandard.compress(parts[k].tobytes(), 1)) for k in range(PARTS) if parts[k].any()]
        if packed:
            none = pa.nulls(len(packed))
            yield pa.RecordBatch.from_arrays([none.cast(doc_type), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.int64()), pa.array([k for k, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names=names)

    names = ["doc_id", "n", "sig", "text_hash", "part", "counts"]
    doc_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, n bigint, sig string, text_hash bigint, part int, counts binary")


def frequency_classes(scanned: DataFrame, bits: int = SKETCH_BITS) -> tuple[np.ndarray, int, int]:
    """A byte for each sum of the sketch (0: rare), the bound under which a sum is rare, and all shingles' number."""
    total = scanned.agg(F.sum("n")).first()[0] or 0
    mean = total / (1 << bits)
    bound = min(255, math.ceil(mean + 8 * math.sqrt(mean)) + 32)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.decompress(packed), np.uint8).astype(np.uint32)
        done = [(k, np.where(x < bound, 0, np.log2(np.maximum(x, 1) / bound) + 1).astype(np.uint8).tobytes()) for k, x in sums.items()]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int32()), pa.array([x for _, x in done], pa.binary())], names=["part", "classes"])

    out = np.zeros((PARTS, (1 << bits) // PARTS), np.uint8)
    # PARTS rows of a fixed size, whatever the input
    for part, packed in scanned.filter("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part").mapInArrow(add, "part int, classes binary").collect():
        out[part] = np.frombuffer(packed, np.uint8)
    return out.reshape(-1), bound, total


def prefix_postings(shingles: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The tokens a set is indexed by, which of them stand for frequent shingles, and how many frequent ones its prefix has."""
    n = len(shingles)
    length = min(n, n - _common(n) + EXTEND)
    of = classes[shingles >> np.uint64(65 - len(classes).bit_length())]
    if not of.any():
        return shingles[:length], np.zeros(length, bool), 0
    order = np.argsort(of, kind="stable")[:length]
    prefix, of = shingles[order], of[order]
    rare, frequent = prefix[of == 0], np.sort(prefix[of > 0])
    tokens = [rare]
    if n <= LARGE:
        i, j = np.triu_indices(len(frequent), 1)
        tokens.append(mix(frequent[i] * np.uint64(3) + mix(frequent[j])))
    if n >= _common(LARGE):
        tokens.append(mix(frequent ^ np.uint64(0x5BD1E995)))
    flags = np.concatenate([np.zeros(len(rare), bool), np.ones(sum(map(len, tokens[1:])), bool)])
    return np.concatenate(tokens), flags, len(frequent)


def postings(docs: DataFrame, classes, shards: int) -> DataFrame:
    """(shard, kind, data): packed arrays of ``POSTING``; kind 1 has tokens of frequent shingles."""

    def run(batches):
        held, size, seen = [[], []], 0, set()
        for batch in batches:
            for _, shingles in shingle_sets(batch):
                if len(shingles) < 4 or (key := _short(_signature(shingles))) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                tokens, flags, frequent = prefix_postings(shingles, classes.value)
                for kind in (0, 1):
                    rows = np.zeros(int((flags == kind).sum()), POSTING)
                    if len(rows):
                        rows["token"], rows["set"], rows["n"], rows["frequent"] = tokens[flags == kind], key, len(shingles), min(frequent, 32767)
                        held[kind].append(rows)
                        size += len(rows)
                if size >= CHUNK:
                    yield from _by_shard(held, shards)
                    held, size = [[], []], 0
        yield from _by_shard(held, shards)

    return docs.select("text").mapInArrow(run, "shard int, kind int, data binary")


def _by_shard(held, shards: int):
    for kind in (0, 1):
        if held[kind]:
            rows = np.concatenate(held[kind])
            shard = (mix(rows["token"]) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(np.full(len(full), kind), pa.int32()), pa.array([rows[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full], pa.binary())], names=["shard", "kind", "data"]
            )


def candidates(packed: DataFrame, bound: int) -> DataFrame:
    """(a, b, shared, least): pairs of a shard with the prefix shingles they share there and need in all; least null: a star's link."""

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for shard, kind, data in zip(batch["shard"].to_pylist(), batch["kind"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if (shard, kind) != now and parts:
                    yield from _pairs(np.concatenate(parts), now[1], bound)
                    parts = []
                now = shard, kind
                parts.append(np.frombuffer(data, POSTING))
        if parts:
            yield from _pairs(np.concatenate(parts), now[1], bound)

    return packed.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "a bigint, b bigint, shared bigint, least bigint")


def _batch(a, b, shared, least) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int64()), pa.array(least, pa.int64())], names=["a", "b", "shared", "least"])


def _pairs(rows: np.ndarray, kind: int, bound: int):
    rows = rows[np.lexsort((rows["set"], rows["token"]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["set"][1:] != rows["set"][:-1])
    rows = rows[fresh]
    first = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
    length = np.diff(np.append(first, len(rows)))
    found, many = [], 0
    for size in np.unique(length[length > 1]).tolist():
        heads = first[length == size]
        if size > bound:
            for at in heads:
                members = rows["set"][at : at + size]
                yield _batch(np.full(size - 1, members[0]), members[1:], np.ones(size - 1), pa.nulls(size - 1).cast(pa.int64()))
            continue
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 19) // len(i))
        for k in range(0, len(heads), step):
            x, y = ((heads[k : k + step, None] + p).reshape(-1) for p in (i, j))
            nx, ny = rows["n"][x], rows["n"][y]
            near = 100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)
            x, y = x[near], y[near]
            if x.size:
                least = np.minimum(EXTEND, _common(np.maximum(nx, ny)[near])) - np.minimum(rows["frequent"][x], rows["frequent"][y])
                found.append(_summed(rows["set"][x], rows["set"][y], np.ones(len(x), np.int64), np.full(len(x), 1) if kind else np.maximum(least, 1)))
                many += len(found[-1][0])
            if many > 1 << 21:
                yield _batch(*_summed(*map(np.concatenate, zip(*found, strict=True))))
                found, many = [], 0
    if found:
        yield _batch(*_summed(*map(np.concatenate, zip(*found, strict=True))))


def _summed(a, b, shared, least):
    """Equal pairs as one, their shared tokens added and the smaller need kept."""
    order = np.lexsort((b, a))
    a, b, shared, least = a[order], b[order], shared[order], least[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[head], b[head], np.add.reduceat(shared, head), np.minimum.reduceat(least, head)


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, sig, data): the shingles, packed, of the classes whose short signature is wanted."""
    held = classes.join(wanted, "set", "left_semi").select("rep")
    texts = docs.select("doc_id", "text").join(held.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            found = [(s.hex(), _short(s), x.tobytes()) for _, x in shingle_sets(batch) for s in (_signature(x),)]
            if found:
                sig, short, data = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64()), pa.array(sig, pa.string()), pa.array(data, pa.binary())], names=["set", "sig", "data"])

    made = texts.select("text").mapInArrow(run, "set bigint, sig string, data binary")
    return made.join(wanted, "set", "left_semi").dropDuplicates(["sig"])


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def verified_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): signatures of the pairs that link."""
    left = sets.select(F.col("set").alias("a"), F.col("sig").alias("sig_a"), F.col("data").alias("data_a"))
    right = sets.select(F.col("set").alias("b"), F.col("sig").alias("sig_b"), F.col("data").alias("data_b"))

    def run(batches):
        for batch in batches:
            whole = lambda c, k: np.frombuffer(batch[c][k].as_buffer(), np.uint64)  # noqa: B023, E731
            ok = [_linked(whole("data_a", k), whole("data_b", k)) for k in range(len(batch))]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["sig_a"], kept["sig_b"]], names=["a", "b"])

    met = pairs.join(left, "a").join(right, "b").select("sig_a", "data_a", "sig_b", "data_b")
    return met.mapInArrow(run, "a string, b string")


def _near(sets: list[np.ndarray]) -> np.ndarray:
    """Which of a group's sets link, from counts of common shingles."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff(np.append(first, len(tokens)))
    common = np.zeros((m, m), np.int32)
    for at, size in zip(first[length > 1].tolist(), length[length > 1].tolist(), strict=True):
        who = owner[at : at + size]
        common[np.ix_(who, who)] += 1
    near = 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(near, False)
    return near


def _forest(near: np.ndarray):
    """Links that span the components."""
    left = np.ones(len(near), bool)
    for k in range(len(near)):
        if left[k]:
            left[k], edge = False, [k]
            while edge:
                at = edge.pop()
                new = np.flatnonzero(near[at] & left)
                left[new] = False
                edge += new.tolist()
                for x in new.tolist():
                    yield at, x


def verified_groups(of: DataFrame, sets: DataFrame) -> DataFrame:
    """From groups (set, comp): rows (a, b, null) that span their links, and rows (a, null, n) that count each set's.

    A group is cut in blocks that are compared by pairs; a pair of blocks counts links across it, a block with itself those inside.
    """
    sized = of.join(sets.select("set", F.octet_length("data").alias("bytes")), "set")
    blocks = sized.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = of.join(blocks, "comp").withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    spread = placed.select("set", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("set", "own", F.concat_ws(":", "comp", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    dealt = sets.join(spread, "set").select("task", "own", "sig", "data").repartition("task").sortWithinPartitions("task")

    def links(task, own, sigs, sets):
        near = _near(sets)
        _, i, j = task.rsplit(":", 2)
        counted = near if i == j else near & (np.array(own)[:, None] != np.array(own)[None, :])
        n = counted.sum(1)
        some = np.flatnonzero(n).tolist()
        edges = list(_forest(near))
        a = [sigs[x] for x, _ in edges] + [sigs[x] for x in some]
        b = [sigs[y] for _, y in edges] + [None] * len(some)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array([None] * len(edges) + n[some].tolist(), pa.int64())], names=["a", "b", "n"])

    def run(batches):
        now, own, sigs, sets = None, [], [], []
        for batch in batches:
            for task, block, sig, data in zip(*(batch[c].to_pylist() for c in ("task", "own", "sig", "data")), strict=True):
                if task != now and sets:
                    yield links(now, own, sigs, sets)
                    own, sigs, sets = [], [], []
                now = task
                own.append(block)
                sigs.append(sig)
                sets.append(np.frombuffer(data, np.uint64))
        if sets:
            yield links(now, own, sigs, sets)

    return dealt.mapInArrow(run, "a string, b string, n bigint")


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs that no group compares already."""
    side = lambda c: of.select(F.col("set").alias(c), F.col("comp").alias(f"comp_{c}"))
    met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return met.filter("comp_a IS NULL OR comp_b IS NULL OR comp_a != comp_b").select("a", "b")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig, component_id, n_links: the set's size and signature, the smallest doc_id reachable by links, and how many other sets it links with."""
    return grouped(docs).drop("text_hash", "root")


def grouped(docs: DataFrame) -> DataFrame:
    """As ``join``, with the text's hash and the component's root, null for sets without links or copies."""
    spark = docs.sparkSession
    bits = sketch_bits(docs)
    scanned = keep(scan(docs, bits), "shingles")
    own = scanned.filter("part IS NULL").select("doc_id", "n", "sig", "text_hash")
    byte_classes, bound, total = frequency_classes(scanned, bits)
    shipped = spark.sparkContext.broadcast(byte_classes)
    shards = max(16, -(-(total // 4) // SHARD))
    pairs = keep(candidates(postings(docs, shipped, shards), bound), "candidates")
    stars = keep(pairs.filter("least IS NULL").select("a", "b"), "stars")
    close = keep(pairs.filter("least IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).filter("shared >= least").select("a", "b"), "pairs")
    drop_table(pairs)
    del pairs
    forget(spark)

    classes = keep(own.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).withColumn("set", _short_of_sig()), "classes")
    nodes = close.select(F.col("a").alias("set")).union(close.select("b")).union(stars.select("a")).union(stars.select("b")).distinct()
    sets = keep(full_sets(docs, classes, keep(nodes, "nodes")), "sets")
    groups = keep(components(stars).select(F.col("node").alias("set"), F.col("root").alias("comp")), "groups")
    single = keep(verified_pairs(_apart(close, groups), sets), "links")
    inside = keep(verified_groups(groups, sets), "group_links")
    drop_table(sets)
    del sets, nodes
    forget(spark)
    roots = components(single.unionByName(inside.filter("b IS NOT NULL").select("a", "b")))
    one = F.lit(1).cast("bigint").alias("n")
    ends = single.select("a", one).unionByName(single.select(F.col("b").alias("a"), one)).unionByName(inside.filter("b IS NULL").select("a", "n"))
    degree = ends.groupBy(F.col("a").alias("sig")).agg(F.sum("n").alias("n_links"))
    linked = roots.join(classes.select(F.col("sig").alias("node"), "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "root").select(F.col("node").alias("sig"), "root", "component_id")
    known = classes.join(named, "sig", "left").filter("copies > 1 OR component_id IS NOT NULL").join(degree, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), F.coalesce("component_id", "rep").alias("component_id"), "n_links")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["sig", "salt"], "left")
    return out.select("doc_id", "n", "sig", "text_hash", "root", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def _short_of_sig():
    """The short signature, a little-endian 64-bit number, out of the hex string."""
    turned = F.concat(*[F.substring("sig", 2 * k + 1, 2) for k in reversed(range(8))])
    high, low = F.conv(F.substring(turned, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(turned, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no row of a component with a smaller one: ids are chosen, not rows (see ``one_row_per_group``)."""
    found = keep(join(docs).filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    left = docs.join(found, docs["doc_id"] == found["gone"], "left_anti")
    return left


def one_row_per_group(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null last), then signature, text and other columns.  Rows without words all stay.

    Rows are known by doc_id and the 64-bit hash of their text; only rows that repeat both are shuffled.
    """
    rows = keep(grouped(docs).filter("root IS NOT NULL").groupBy("root", "doc_id", "sig", "text_hash").agg(F.count("*").alias("copies")), "grouped")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig", "text_hash")
    best = rows.groupBy("root").agg(F.min(first).alias("best"))
    stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.sig") == F.col("sig")) & (F.col("best.text_hash") == F.col("text_hash"))
    judged = keep(rows.join(best, "root").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), stays.alias("stays"), "copies"), "judged")
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash"))
    again = judged.filter("stays AND copies > 1").drop("stays", "copies")
    left = docs.join(judged.filter("NOT stays OR copies > 1"), same, "left_anti")
    if again.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = docs.join(again, same, "left_semi").select(row.alias("row"), F.xxhash64("text").alias("h"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("order"))
    one = repeated.groupBy(F.col("row.doc_id").alias("id"), "h").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return left.unionByName(one)
