import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import fixtures as X
from foliant.llm import decontam, jaccard_join, line_dedup, mixing, ngram_lm, oracles, pii, quality_rules
from foliant.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return X.documents(spark).cache()


# quality rules


def counted(text):
    w, seen, dup, at = words(text), set(), 0, defaultdict(list)
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeat = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    n = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), n, dup, len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w)


def test_quality_counts(docs):
    got = quality_rules.measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *counted(t))) for d, t in X.plain_rows(docs))


def test_quality_keeps_columns_and_handles_empty(spark, docs):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.measure(docs).filter("kept").count() > 0
    assert quality_rules.measure(X.empty(spark)).count() == 0
    assert quality_rules.keep_good(X.empty(spark)).count() == 0


def test_quality_rules_reject_by_table(docs):
    strict = (quality_rules.Rule("n_words", 100, None),)
    assert all(r.n_words >= 100 for r in quality_rules.measure(docs, strict).filter("kept").collect())


# line dedup


def key(line):
    return line.strip(SPACE).translate(LOWER)


def deduped(rows):
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(d)
    last = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in last and d is not None and last[key(x)] is not None and d < last[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs):
    got = line_dedup.report(docs).collect()
    want = deduped(X.plain_rows(docs))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r[2] for r in want) > 10


def test_line_dedup_keeps_columns(spark, docs):
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    assert line_dedup.dedup(X.empty(spark)).count() == 0
    assert line_dedup.report(X.empty(spark)).count() == 0


def test_line_index_is_reversible(spark):
    docs = X.documents(spark, repeat=False).select("doc_id", "text")
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    state = lambda index: (sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.refs.collect())))
    index = line_dedup.LineIndex(spark)
    index.insert(first)
    before = state(index)
    index.insert(second)
    assert sorted(map(tuple, index.apply(docs).collect())) == sorted(deduped(X.plain_rows(docs)))
    held = heavy_in_filters(index)
    assert held and held == {tuple(r) for r in index.counts.filter("n_docs >= 3").select("k1", "k2").collect()}
    index.delete(second.select("doc_id"))
    assert state(index) == before
    assert sorted(map(tuple, index.apply(first).collect())) == sorted(deduped(X.plain_rows(first)))
    index.delete(first.select("doc_id"))
    assert state(index) == ([], []) and not heavy_in_filters(index)
    assert not any(np.frombuffer(x, np.uint16).any() for r in index.filters.collect() for x in r.data)


def heavy_in_filters(index):
    """The counted keys that the stored filters hold."""
    parts = {r.shard: line_dedup.Filters([line_dedup.CuckooFilter.from_bytes(x) for x in r.data]) for r in index.filters.collect()}
    assert len(parts) == index.filters.count()
    return {(r.k1, r.k2) for r in index.counts.collect() if (f := parts.get(r.k2 % index.shards)) and f.contains(np.array([r.k1]))[0]}


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, 5000)
    made = line_dedup.CuckooFilter(len(keys))
    assert not len(made.insert(keys))
    assert made.contains(keys).all()
    assert made.contains(rng.integers(-(2**62), 2**62, 20_000)).mean() < 0.01
    again = line_dedup.CuckooFilter.from_bytes(made.to_bytes())
    assert not len(again.delete(keys[:2500]))
    assert again.contains(keys[2500:]).all()
    assert again.contains(keys[:2500]).mean() < 0.02


def test_full_filters_grow_and_lose_nothing():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**62), 2**62, 20_000)
    filters = line_dedup.Filters([line_dedup.CuckooFilter(100)])
    for part in np.split(keys, 10):
        filters.insert(part)
    assert len(filters.parts) > 2 and filters.contains(keys).all()
    filters.delete(keys[:15_000])
    assert filters.contains(keys[15_000:]).all() and filters.contains(keys[:15_000]).mean() < 0.02
    filters.delete(keys[15_000:])
    assert not any(part.table.any() for part in filters.parts)


def test_lines_of_slices_and_texts(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["\n", "\n", " ", "\t", "Ab", "é", "a line that is long enough", "\r"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    data, bounds = line_dedup.text_bytes(pa.array(texts))
    starts, ends, text, (k1, k2), long = line_dedup.lines_of(data, bounds[50:251])
    lines = [(i, x) for i, t in enumerate(texts[50:250]) for x in t.split("\n")]
    raw = data[bounds[50] : bounds[250]].tobytes()
    assert [(i, raw[a:z].decode()) for i, a, z in zip(text.tolist(), starts.tolist(), ends.tolist(), strict=True)] == lines
    assert long.tolist() == [len(key(x)) >= 20 for _, x in lines]
    pairs = {(key(x), a, b) for (_, x), a, b in zip(lines, k1.tolist(), k2.tolist(), strict=True) if len(key(x)) >= 20}
    assert len(pairs) == len({k for k, _, _ in pairs}) == len({a for _, a, _ in pairs}) == len({b for _, _, b in pairs})


def test_line_dedup_is_linear_in_dropped_lines(spark):
    import time

    long = "\n".join(f"a line of some length, number {k}" for k in range(200_000))
    docs = spark.createDataFrame([(k, long) for k in range(3)], "doc_id bigint, text string")
    began = time.time()
    assert sorted((r.n_lines, r.n_dropped) for r in line_dedup.report(docs).collect()) == [(200_000, 0), (200_000, 200_000), (200_000, 200_000)]
    assert time.time() - began < 60


# n-gram Jaccard join


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = defaultdict(set)
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
            if sets[i] != sets[j]:
                degree[sets[i]].add(sets[j])
                degree[sets[j]].add(sets[i])
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return [(d, len(sets[k]), least.get(find(k)) if sets[k] else d, len(degree[sets[k]])) for k, (d, _) in enumerate(rows)]


def test_jaccard_join(docs):
    want = linked(X.plain_rows(docs))
    got = jaccard_join.join(docs).select("doc_id", "n", "component_id", "n_links").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(c != d for d, _, c, _ in want) > 15


def test_jaccard_join_of_frequent_shingles(spark, monkeypatch):
    """Near copies in number: lists over the bound, stars, groups cut in blocks, contraction of links."""
    import random

    rng = random.Random(3)
    base = X.prose(rng, 60).split(" ")
    rows = []
    for k in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = rng.choice(X.VOCAB)
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.join(docs).select("doc_id", "n", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(linked(rows))


def test_jaccard_of_empty(spark):
    assert jaccard_join.join(X.empty(spark)).count() == 0
    assert jaccard_join.one_per_group(X.empty(spark)).count() == 0


def test_one_per_group(docs):
    out = jaccard_join.one_per_group(docs)
    gone = {d for d, _, c, _ in linked(X.plain_rows(docs)) if d is not None and c is not None and c < d}
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(d for d, _ in X.plain_rows(docs) if d not in gone)


def test_components_by_contraction(spark):
    links = [(k, k + 1) for k in range(0, 60) if k % 20 != 19] + [(100, 101), (101, 100), (7, 7)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    groups = lambda n: sorted(sorted(g) for g in _groups(components(df, n).collect()))
    assert groups(3) == groups(1000)
    assert [len(g) for g in groups(3)] == [20, 20, 20, 2] or sum(map(len, groups(3))) == 62


def _groups(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.root].add(r.node)
    return out.values()


# decontamination


def test_masks_find_any_two_substitutions():
    w, n = decontam.WINDOW, decontam.SUBSTITUTIONS
    for lost in combinations(range(w), n):
        assert any(not {o + m for m in mask} & set(lost) for mask in decontam.MASKS for o in range(w - decontam.SPAN + 1))


def test_halves_find_any_substitution_in_short_items():
    for n in range(decontam.SPAN, decontam.WINDOW):
        assert all(any(lost not in range(o, o + decontam.HALF) for o in range(n - decontam.HALF + 1)) for lost in range(n))


def aligned(text, item):
    mark = r"[^\x20\x09-\x0d!-/:-@\[-`{-~]+"
    a, b = (re.findall(mark, (x or "").translate(LOWER)) for x in (text, item))
    if not b:
        return False
    window, allowed = min(13, len(b)), 2 if len(b) >= 13 else int(len(b) >= 8)
    for start in range(-len(b), len(a)):
        same = [0 <= start + k < len(a) and a[start + k] == b[k] for k in range(len(b))]
        inside = [k for k in range(len(b)) if 0 <= start + k < len(a)]
        if len(inside) >= window and any(inside[i + window - 1] - inside[i] == window - 1 and sum(same[inside[i] : inside[i] + window]) >= window - allowed for i in range(len(inside) - window + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def leaky(spark):
    import random

    rng = random.Random(9)
    items = [(k, X.prose(rng, n)) for k, n in enumerate((3, 7, 8, 9, 12, 13, 20, 40))] + [(8, None), (9, ""), (5, X.prose(rng, 15))]
    rows = [(0, None), (1, ""), (2, X.prose(rng, 200))]
    for k, t in items:
        for edits in (0, 0, 1, 2, 3, 6):
            w = (t or "").split(" ")
            for at in rng.sample(range(len(w)), min(edits, len(w))):
                w[at] = "zz"
            rows.append((len(rows), f"{X.prose(rng, 20)}. {' '.join(w)}, {X.prose(rng, 20)}"))
    rows += [rows[5], (None, rows[6][1]), (len(rows), " ".join((items[7][1] or "").split(" ")[10:30]))]
    return rows, items


def test_decontamination_agrees_with_sql_on_short_items(spark, leaky):
    import duckdb

    rows, items = leaky
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    want = con.execute(oracles.decontam_sql() + " WHERE matched_words IS NOT NULL").fetchall()
    plain = lambda r: tuple(None if x is None or x != x else int(x) for x in r)
    assert sorted(map(repr, map(plain, want))) == sorted(map(repr, map(plain, decontam.contaminated(docs, bench).collect())))


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_decontamination(spark, leaky, block):
    rows, items = leaky
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(d, i) for d, t in rows for i, x in items if aligned(t, x)}
    got = decontam.contaminated(docs, bench, block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(want) > 20
    bad = [any(aligned(t, x) for _, x in items) for _, t in rows]
    assert decontam.clean(docs, bench, block).count() == bad.count(False)


def test_decontamination_of_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contaminated(X.empty(spark), none).count() == 0
    assert decontam.clean(X.documents(spark), none).columns == X.documents(spark).columns


# mixing


def test_mixing_meets_its_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d, len(words(t))) for d, t in X.plain_rows(docs))
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert own[0].target <= 2 * own[0].source_size
        assert own[0].source_size == sum(r["size"] for r in own)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(X.empty(spark)).count() == 0


def test_schedule_is_even(spark):
    goal = spark.createDataFrame([("a", 6000.0), ("b", 3000.0), ("c", 1000.0)], "key string, target double")
    rows = sorted((r.slot, r.key, r["rank"]) for r in mixing.schedule(goal, 10).collect())
    assert len({s for s, _, _ in rows}) == len(rows) == 1000 and 0 <= rows[0][0] and rows[-1][0] < 1024
    for name, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        seen = np.cumsum([k == name for _, k, _ in rows])
        assert np.abs(seen - share * np.arange(1, 1001)).max() < 8
        assert [r for _, k, r in rows if k == name] == list(range(seen[-1]))


def test_the_schedule_makes_the_mix(spark, docs, monkeypatch):
    rows = sorted((r.slot, r.position, r.doc_id is None, r.doc_id or 0, r.first_word, r.words, r.source, r.block) for r in mixing.mixture(docs).collect())
    size = {}
    for d, t in X.plain_rows(docs):
        size.setdefault((d is None, d or 0), []).append(len(words(t)))
    filled = Counter()
    for slot, position, none, d, first, n, source, block in rows:
        assert position == filled[slot] and n > 0 and first + n <= max(size[none, d])
        filled[slot] += n
    blocks = {slot: (source, block) for slot, *_, source, block in rows}
    for source in {x for x, _ in blocks.values()}:  # a source's blocks come in order, all but the last full
        own = [filled[s] for s in sorted(blocks) if blocks[s][0] == source]
        assert [blocks[s][1] for s in sorted(blocks) if blocks[s][0] == source] == list(range(len(own)))
        assert set(own[:-1]) <= {mixing.block_words(sum(filled.values()))}
    whole = mixing.mix(docs)
    assert whole.agg(F.sum("taken")).first()[0] == sum(filled.values())
    assert whole.agg(F.min("first_slot")).first()[0] == rows[0][0]
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda goal, block: real(goal, block).filter("slot % 2 = 0"))
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] < sum(filled.values())


def test_mixed_keeps_rows_and_columns(spark, docs):
    out = mixing.mixed(docs)
    assert Counter(X.plain_rows(out)) == Counter(X.plain_rows(docs))
    assert out.columns == [c for c in docs.columns if c != "size"] + ["size", "target", "taken", "first_slot"]
    assert mixing.mixed(X.empty(spark)).count() == 0
    assert [mixing.bucket_digits(n) for n in (0, 1 << 28, (1 << 28) + 4096, 1 << 36)] == [3, 3, 4, 5]

# PII


def base_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(k, a, z) for a, _, z, k in sorted(out)]


def test_pii_patterns_against_regular_expressions():
    import random

    rng = random.Random(2)
    for _ in range(30_000):
        t = "".join(rng.choice("a1.@+- ()%25_0é\n9") for _ in range(rng.randint(0, 30)))
        assert [s[:3] for s in pii.find(t)] == base_spans(t)


def test_secrets_are_no_words_and_no_numbers(spark):
    key, uuid = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "550e8400-e29b-41d4-a716-446655440000"
    text = f'key = "{key}" {uuid} internationalisation-of-2020-editions 12345678901234567890123 aaaaaaaaaa1a1a1a1a1a1a1a1a a.b.long.name.with.no.secret@host.org'
    assert [text[a:z] for _, a, z in pii.secrets(text, pii.find(text))] == [key, uuid]
    docs = spark.createDataFrame([(1, text), (2, f"{key} and 10.0.0.1")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert [s.kind for s in rows[1].spans] == ["email"] and [s.kind for s in rows[1].all_spans if s.kind != "term"] == ["secret", "secret", "email"]
    assert "[SECRET] and [IP]" in {r.text for r in pii.sanitise(docs).collect()}


def test_addresses_with_long_runs_of_zeros():
    zeros = "0" * 5000
    assert [x[:3] for x in pii.find(f"{zeros}.1.2.3 {zeros}255.{zeros}.0.{zeros}9 {zeros}256.1.1.1")] == [("ip", 0, 5006), ("ip", 5007, 5007 + 15_008)]


def test_pii_is_linear_in_long_runs():
    import time

    began = time.time()
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000):
        pii.find(run)
    assert time.time() - began < 10


def test_disclosing_terms_are_found_and_copies_prove_nothing(spark):
    rows = [(k, f"{c}{c}x say bob@x.org knows zanzibar {c}{c}{c}") for k, c in enumerate("abcdefg")]
    rows += [(100 + k, f"say knows plain {k}") for k in range(60)] + [(200 + k, "copies of al@y.org near quokka today") for k in range(9)] + [(300, None), (301, ""), (0, "same id")]
    docs = spark.createDataFrame([(*r, "pad") for r in rows], "doc_id bigint, text string, spans string")
    found = {r.doc_id: r for r in pii.spans(docs).filter("size(all_spans) > 0").collect()}
    assert sum(s.kind == "term" for s in found[0].all_spans) >= 1
    assert not any(s.kind == "term" for s in found[200].all_spans)
    text = {(r.doc_id, r.spans): r.text for r in pii.sanitise(docs).filter("doc_id = 1 OR doc_id = 200").collect()}
    assert "zanzibar" not in text[1, "pad"] and "[EMAIL]" in text[1, "pad"]
    assert "quokka" in text[200, "pad"]
    assert pii.spans(X.empty(spark)).count() == 0
    assert pii.sanitise(X.documents(spark)).count() == X.documents(spark).count()


# Kneser-Ney


def grams_of(text, order):
    """Each position's word with the ``order - 1`` units before it."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    seq = [*range(order - 1), *words, "</s>"]
    return list(zip(*(seq[k:] for k in range(order)), strict=False))


def kneser_ney(texts, order):
    """log2 p(last word | those before) of the interpolated modified model, told from its definition."""
    counts = {order: Counter(g for t in texts for g in grams_of(t, order))}
    for m in range(order - 1, 0, -1):  # distinct predecessors; occurrences of what a mark starts
        counts[m] = Counter()
        for g, n in counts[m + 1].items():
            counts[m][g[1:]] += n if isinstance(g[1], int) else 1

    def discounts(of):
        n = [sum(1 for x in of.values() if x == k) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1] and n[2]):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]

    lost = {m: discounts(counts[m]) for m in counts}
    cut = lambda m, n: lost[m][min(n, 3) - 1]
    total = sum(counts[1].values())
    unknown = sum(cut(1, n) for n in counts[1].values()) / total / (len(counts[1]) + 1)
    context, mass = Counter(), Counter()
    for m in range(2, order + 1):
        for g, n in counts[m].items():
            context[g[:-1]] += n
            mass[g[:-1]] += cut(m, n)

    def logp(gram):
        p = unknown
        for m in range(1, order + 1):
            g = gram[order - m :]
            n = counts[m].get(g, 0)
            if m == 1:
                p += (n - cut(1, n)) / total if n else 0
            elif g[:-1] in context:
                p = ((n - cut(m, n)) if n else 0) / context[g[:-1]] + mass[g[:-1]] / context[g[:-1]] * p
        return float(np.log2(p))

    return logp


@pytest.mark.parametrize(("order", "ids", "group", "shard"), [(2, ngram_lm.TRUSTED_IDS, ngram_lm.GROUP_WORDS, ngram_lm.SHARD_CHARS), (3, 0, 500, 4000), (3, ngram_lm.TRUSTED_IDS, ngram_lm.GROUP_WORDS, ngram_lm.SHARD_CHARS), (4, 0, 500, 4000)])
def test_kneser_ney_against_the_textbook(spark, monkeypatch, order, ids, group, shard):
    for name, value in (("TRUSTED_IDS", ids), ("GROUP_WORDS", group), ("SHARD_CHARS", shard)):
        monkeypatch.setattr(ngram_lm, name, value)
    rows = [(k, t, "en" if k % 2 else "fr", "pad") for k, t in enumerate(X.texts()[:40])] + [(500, "no model here", None, "pad"), (None, "w1 the w2", "en", "pad"), (7, "w1 of", "en", "pad"), (7, "w1 of", "en", "pad")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key string")
    training = spark.createDataFrame([(k,) for k in range(10, 30)], "trusted_id bigint")
    got = ngram_lm.score(docs, training, order).collect()
    assert len(got) == len(rows)
    models = {lang: kneser_ney([t for k, t, own, _ in rows if k is not None and 10 <= k < 30 and (own == lang or lang is None)], order) for lang in ("en", "fr", None)}
    want = sorted((-1 if k is None else k, len(g) - 1, -sum(map(models[own], g)) if len(g) > 1 else 0.0) for k, t, own, _ in rows for g in [grams_of(t, order)])
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.words, r.bits) for r in got)
    for w, h in zip(want, have, strict=True):
        assert w[:2] == h[:2] and h[2] == pytest.approx(w[2], rel=1e-9)


def test_groups_of_all_tasks_spread_over_the_shards():
    places = Counter(ngram_lm.spread(((task + 1) << 32) + n, 64) for task in range(640) for n in (1, 2))
    assert len(places) == 64 and max(places.values()) < 45


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_sums_to_one(order):
    texts = ["a b a c", "a b b", "c a b a a", "d a b"]
    logp = kneser_ney(texts, order)
    seen = {w for t in texts for w in t.split()} | {"</s>"}
    for a in [(0, 1), (1, "a"), ("a", "b"), ("never", "a"), ("never", "never")]:
        assert sum(2 ** logp((*a, b)[-order:]) for b in [*seen, "unknown"]) == pytest.approx(1)


def test_kneser_ney_separates_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.filter("doc_id % 2 = 0 AND toxic = 0")
    trusted = labels.filter("doc_id % 2 = 1 AND quality = 1 AND toxic = 0")
    rows = ngram_lm.classify(spark.read.parquet(f"{sf}/documents.parquet"), trusted).join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] > 0.98 and share[0] < 0.5


def test_kneser_ney_without_rows_or_trust(spark):
    none = spark.createDataFrame([], "doc_id bigint")
    assert ngram_lm.classify(X.empty(spark), none).count() == 0
    docs = X.documents(spark)
    assert ngram_lm.classify(docs, none).filter("kept").count() == docs.filter("text != ''").count()


def test_digest_of_signature():
    assert jaccard_join._short(hashlib.blake2b(b"x", digest_size=16).digest()) < 2**63


def test_copies_of_line_tables_do_not_outgrow_the_references():
    from foliant.llm import line_dedup as D

    for power in range(6, 13):
        refs, keys = 10**power, 10 ** (power - 3)
        shards = D.shards_for(keys)
        salts = D.salts_for(refs, shards)
        assert salts * keys <= max(D.SALTS * keys, D.SHARD_KEYS / D.TASK_REFS * refs + keys) and refs / (shards * salts) <= D.TASK_REFS


def test_a_worker_holds_one_block_of_the_benchmark(spark, monkeypatch):
    from foliant.llm import decontam as D

    held = []
    real = D.holds
    monkeypatch.setattr(D, "holds", lambda text, shipped: held.append(shipped) or real(text, shipped))
    docs = X.documents(spark)
    long = [r.text for r in docs.select("text").distinct().collect() if r.text and 20 < len(r.text.split()) < 200][:6]
    bench = spark.createDataFrame(list(enumerate(long)), "item_id bigint, text string")
    kept = D.clean(docs, bench, 60)
    assert len(held) > 3 and kept._jdf.queryExecution().toString().count("ArrowEvalPython") <= 4  # a UDF in each of the four plans
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, D.clean(docs, bench).collect()))
    assert sorted(map(repr, D.contaminated(docs, bench, 60).collect())) == sorted(map(repr, D.contaminated(docs, bench).collect()))


def test_urls_and_labels_that_are_null_teach_without_failing(spark):
    from foliant.llm import url_filter as U

    rows = [(None, None, None, 1), ("http://a/", "a", "/", None), ("http://b/1", "b", "/1", 0)] * 30
    labelled = spark.createDataFrame(rows, "url string, host string, path string, block int")
    assert U.train(labelled).score(["http://b/1"], ["b"], ["/1"]).shape == (1,)
    assert U.held_out(labelled)["judged"] >= 0
    pages = spark.createDataFrame([(1, None), (2, "http://b/1")], "page_id bigint, url string")
    assert {r.verdict for r in U.judge(pages, labelled=labelled).collect()} <= {"allow", "block"}
