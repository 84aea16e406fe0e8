"""Forms for hot keys and many tasks give what the plain ones give."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import temporal, vector


def _moment(kind, n):
    return n if kind == "int" else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


@pytest.mark.parametrize("kind", ["int", "timestamp_ntz"])
def test_as_of_cuts_a_heavy_key_by_time(spark, kind):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 8 + ["cold", "rare", None])
    at = lambda: None if rng.random() < 0.05 else rng.randrange(300)
    rows = [(i, key(), at()) for i in range(600)] + [(600, "hot", 5), (601, "hot", 5)]
    states = [(key(), at(), rng.randrange(50) if rng.random() < 0.9 else None) for _ in range(200)]
    r = spark.createDataFrame([(i, k, None if a is None else _moment(kind, a)) for i, k, a in rows], f"i int, k string, t {kind}").repartition(5)
    s = spark.createDataFrame([(k, None if a is None else _moment(kind, a), v) for k, a, v in states], f"k string, t {kind}, v int").repartition(5)
    first = lambda x: (x is not None, x or 0)

    def brute(k, a):
        known = [(first(t), first(v), v) for own, t, v in states if k is not None and own == k and first(t) <= first(a)]
        return max(known)[2] if known else None

    want = {i: brute(k, a) for i, k, a in rows}
    cut = temporal.heavy_cuts(r, "k", "t", 0.3, 10)
    assert [x.k for x in cut.collect()] == ["hot"] and len(set(cut.first().cuts)) > 50
    for least in (10, 1 << 40):
        found = temporal.as_of(r, s, "k", "t", ["v"], share=0.3, least=least).collect()
        assert len(found) == len(rows) and {x.i: x.as_of_v for x in found} == want


def test_a_heavy_key_goes_to_many_windows(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    cuts = temporal.heavy_cuts(rows, "k", "t", 0.3, 100).first().cuts
    spans = rows.select(F.size(F.filter(F.lit(cuts), lambda c: c < F.col("t"))).alias("span")).groupBy("span").count()
    assert spans.agg(F.max("count")).first()[0] < 20_000 / 100
    assert temporal.as_of(rows, rows.filter("t = 7"), "k", "t", ["v"], least=100).filter("as_of_v = 7").count() == 20_000 - 7


def test_no_rows_and_no_states(spark):
    r, s = spark.createDataFrame([], "k string, t int"), spark.createDataFrame([("a", 1, 1)], "k string, t int, v int")
    assert temporal.as_of(r, s, "k", "t", ["v"]).collect() == []
    assert [x.as_of_v for x in temporal.as_of(s.select("k", "t"), s.limit(0), "k", "t", ["v"]).collect()] == [None]


def test_sums_in_lanes_are_whole(spark):
    rng = np.random.default_rng(5)
    dense = rng.random((90, 600)) * (rng.random((90, 600)) < 0.05)
    rows = spark.createDataFrame([([{"i": int(j), "weight": float(x[j])} for j in np.flatnonzero(x)],) for x in dense], "w array<struct<i:int,weight:double>>").repartition(70)
    basis = rng.random((600, 4))
    assert np.allclose(vector.gram_times(rows, basis), dense.T @ (dense @ basis))


def test_cosines_in_tiles_are_those_of_all_rows_at_once(spark, monkeypatch):
    from foliant.operators import vector

    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    asked = rng.integers(-2, 3, (23, 4)).astype(float)
    unit = lambda m: np.divide(m, (w := np.linalg.norm(m, axis=1, keepdims=True)), out=np.zeros_like(m), where=w > 0)
    full = (unit(asked) @ unit(x).T).round(9)
    want = {q: sorted(range(300), key=lambda d: (-full[q, d], d))[:7] for q in range(23)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "query_id bigint, embedding array<double>")
    made = []
    monkeypatch.setattr(vector, "TILE", 8)
    monkeypatch.setattr(vector, "BLOCK", 10)
    best, names = np.full((23, 7), -np.inf), np.zeros((23, 7), np.int64)
    for lo in range(0, 300, 8):
        vector._better(best, names, unit(asked), unit(x[lo : lo + 8]), np.arange(lo, min(300, lo + 8)))
    assert names.tolist() == [want[q] for q in range(23)]
    for r in vector.cosine_topk(rows, queries, 7).collect():
        made.append((r.query_id, r["rank"], r.vec_id))
    assert sorted(made) == sorted((q, k, d) for q in want for k, d in enumerate(want[q], 1))


def _odd_documents(spark, repeated=False):
    texts = ["Der Énéinà e\u0301neina der, DER x", None, "", "a bb a bb cc", "\u0301 \u0301a' b\u0301b- _1 l'été", "cc bb", "bb cc", "İx ẞs ǆ Ⅷa ½½"] + [f"bb w{k % 7} cc{k % 3}" for k in range(60)]
    rows = [(k if k < 60 or not repeated else k % 60, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize("repeated", [False, True])
def test_scores_made_where_texts_are_read_are_those_of_joins(spark, monkeypatch, repeated):
    from foliant.operators import lexical

    docs = _odd_documents(spark, repeated)
    asked = spark.createDataFrame([(1, "bb"), (1, "bb"), (1, "cc"), (2, "der"), (2, "eneina"), (3, "nowhere"), (4, "w3"), (4, "bb")], "query_id bigint, term string")
    made = lambda every: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in lexical.bm25(docs, asked, "doc_id", "text", every).collect())
    best = lambda: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in lexical.best(docs, asked, 5, "doc_id", "text").collect())
    here = made(False), made(True), best()
    monkeypatch.setattr(lexical, "PIECE", 3)
    assert (made(False), made(True), best()) == here
    monkeypatch.setattr(lexical, "PAIRS", 0)
    assert (made(False), made(True), best()) == here


def test_scores_of_few_terms_shuffle_no_hits(spark):
    from foliant.operators import lexical

    plan = lexical.bm25(_odd_documents(spark), spark.createDataFrame([(1, "bb")], "query_id bigint, term string"), "doc_id", "text")._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "Join" not in plan


@pytest.mark.parametrize("repeated", [False, True])
def test_terms_are_counted_where_texts_are_read(spark, repeated):
    import re
    from collections import Counter

    docs = _odd_documents(spark, repeated)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, Counter()).update(re.findall(r"[a-z][a-z'-]+", (r.text or "").lower()))
    counted = vector.terms(docs, "doc_id", "text")
    assert sorted(tuple(r) for r in counted.collect()) == sorted((d, t, c, max(w.values())) for d, w in want.items() for t, c in w.items())
    assert repeated or "Exchange hashpartitioning" not in counted._jdf.queryExecution().toString()


def test_tokens_are_those_of_the_folded_text(spark):
    from foliant.operators import lexical

    whole = F.filter(F.regexp_extract_all(lexical.folded(F.coalesce("text", F.lit(""))), F.lit(lexical.TOKEN), 0), lambda t: F.length(t) > 1)
    for r in _odd_documents(spark).select(lexical.tokens(F.col("text")).alias("a"), whole.alias("b")).collect():
        assert r.a == r.b


def test_facts_are_dealt_by_chunk_before_they_are_sorted(spark):
    from foliant.operators import facts

    chunks = spark.createDataFrame([(f"c{k}", f"d{k % 5}", "table", ["Infobox"], 1, "codex", f"Threat rating | {k}\nThreat rating | {k} .") for k in range(40)], "chunk_id string, document_id string, content_type string, section_path array<string>, page_start int, source_class string, content string")
    documents = spark.createDataFrame([(f"d{k}", f"Keep {k}", 1.0, None) for k in range(5)], "document_id string, title string, reliability double, superseded_by string")
    found = facts.extract(chunks, documents)
    assert sorted((r.chunk_id, r.value_key) for r in found.collect()) == sorted((f"c{k}", str(k)) for k in range(40))
    assert "RepartitionByExpression [chunk_id" in found._jdf.queryExecution().optimizedPlan().toString()


def test_latent_rows_are_made_where_texts_are_read(spark, monkeypatch):
    import numpy as np
    from foliant.operators import vector

    rng = random.Random(4)
    texts = [None, "", "?"] + [" ".join(f"w{rng.choice('abcdefgh')}{rng.choice('abc')}" for _ in range(rng.randint(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    counted = vector.terms(docs, "doc_id", "text")
    words = vector.vocabulary(counted, docs.count(), 15)
    want = {r.doc_id: {c.i: round(c.weight, 9) for c in r.w} for r in vector.cells(vector.tfidf(counted, words, "doc_id"), words, "doc_id").collect()}
    assert {(r.term, r.df) for r in vector.frequencies(docs, "doc_id", "text").collect()} == {(r.term, r["count"]) for r in counted.groupBy("term").count().collect()}
    held = words.orderBy(F.desc("df"), "term").collect()
    made = vector.weighted(docs, "doc_id", "text", [r.term for r in held], np.array([r.idf for r in held]))
    assert {r.doc_id: {c.i: round(c.weight, 9) for c in r.w} for r in made.collect()} == want
    monkeypatch.setattr(vector, "cells", None)  # no shuffle of a row a document and term
    assert vector.lsa(docs, "doc_id", "text", 4, 15)[0].count() == len(want)


@pytest.mark.parametrize("near", [0, 1000])
def test_walks_keep_least_distances_without_joining_what_was_seen(spark, monkeypatch, near):
    from foliant.operators import graph

    monkeypatch.setattr(graph, "NEAR", near)
    rng = random.Random(6)
    edges = [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 40)}") for _ in range(60)] * 2 + [("n1", "n1"), ("n1", None), (None, "n2")]
    starts = ["n0", "n1", "n1", "n30", "absent"]
    want = {}
    for start in set(starts):
        front, want[start, start] = {start}, 0
        for hop in (1, 2, 3):
            front = {b for a, b in edges if a in front and a is not None}
            for node in front:
                want.setdefault((start, node), hop)
    out = graph.walk(spark.createDataFrame(edges, "subject_id string, object_id string"), spark.createDataFrame([(s,) for s in starts], "node string"), 3)
    rows = out.collect()
    assert {(r.start, r.node): r.hops for r in rows} == want and len(rows) == len(want)
    assert "left_anti" not in out._jdf.queryExecution().toString().lower().replace("leftanti", "left_anti")
    out.unpersist()
