"""The stored index against scoring whole texts, before and after documents are added, replaced and removed."""

import random
from pathlib import Path

import pytest
from foliant.operators import inverted, lexical
from foliant.sources.archive import Archive

WORDS = [f"w{k}" for k in range(60)] + ["the", "of", "Château", "chateau", "noir"] * 6


def texts(seed, n):
    rng = random.Random(seed)
    return [None, "", "x"] + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def ranked(df, key):
    return {(r.query_id, r["rank"]): (r[key], round(r.score, 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(enumerate(texts(3, 400))), "chunk_id bigint, content string").repartition(3).persist()


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(8)
    return spark.createDataFrame([(q, rng.choice(WORDS).lower().replace("â", "a")) for q in range(6) for _ in range(q + 1)] + [(7, "absent")], "query_id bigint, term string")


def test_scores_are_those_of_whole_texts(spark, chunks, queries, tmp_path, monkeypatch):
    index = inverted.build(str(tmp_path / "i"), chunks, "chunk_id", "content", 5)
    want = ranked(lexical.top(lexical.bm25(chunks, queries), 7), "chunk_id")
    assert ranked(index.top(queries, 7), "key") == want
    monkeypatch.setattr(inverted, "CELL_CHUNKS", 8)  # many cells: most are skipped or scored in the second pass
    assert index.cells() > inverted.FIRST and ranked(index.top(queries, 7), "key") == want
    every = spark.createDataFrame([(0, "the"), (0, "noir")], "query_id bigint, term string")
    assert {r.key for r in index.scores(every, every=True).collect()} == {r.chunk_id for r in lexical.bm25(chunks, every, every=True).collect()}


def test_bounds_hold_and_cells_are_skipped(spark, chunks, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 4)
    index = inverted.build(str(tmp_path / "i"), chunks, "chunk_id", "content", 5)
    named = index.asked(queries)
    weights = index.weights(queries, named)
    cells = 64
    postings = index._named(index._union("postings"), queries, named)
    bound = {(r.query_id, r.cell): r.bound for r in index.bounds(postings, weights, cells).collect()}
    scored = index._scored(postings.drop("spots"), weights, inverted.PLACES // cells).collect()
    assert scored and all(r.score <= bound[r.query_id, r.cell] + 1e-9 for r in scored)


def test_phrases_from_positions(chunks, tmp_path):
    index = inverted.build(str(tmp_path / "i"), chunks, "chunk_id", "content", 3)
    for terms in (["chateau", "noir"], ["the", "the"], ["of", "the", "chateau"], ["absent", "the"]):
        want = {r.chunk_id: r.hits for r in lexical.phrase(chunks, terms).collect()}
        assert {r.key: r.hits for r in index.phrase(terms).collect()} == want
    assert any("Château" in (r.content or "") for r in chunks.join(lexical.phrase(chunks, ["chateau", "noir"]), "chunk_id").collect())


def test_a_search_reads_the_asked_terms_shards_alone(spark, chunks, tmp_path):
    index = inverted.build(str(tmp_path / "i"), chunks, "chunk_id", "content", 16)
    asked = spark.createDataFrame([(0, "w7")], "query_id bigint, term string")
    named = index.asked(asked)
    read = index._named(index._union("postings"), asked, named)
    files = read.select("term", "_metadata.file_path", "_metadata.file_size").distinct().collect()
    assert len(named[1]) == 1 and files and all(f"shard={named[1][0]}/" in r.file_path for r in files)
    whole = sum(p.stat().st_size for p in Path(tmp_path / "i" / "postings").rglob("*.parquet"))
    assert sum({r.file_path: r.file_size for r in files}.values()) < whole / 4
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(term,w7)" in plan.replace(" ", "")


def test_segments_follow_documents(spark, tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    body = texts(5, 8)[3:]
    for k, text in enumerate(body[:6]):
        (root / f"d{k}.txt").write_text(text)
    archive = Archive(spark, str(tmp_path / "store"))
    archive.ingest(str(root))
    asked = spark.createDataFrame([(0, "the"), (0, "noir"), (1, "w5")], "query_id bigint, term string")

    def agrees():
        index, held = archive.index(), archive.table("chunks").select("chunk_id", "content")
        assert ranked(index.top(asked, 50), "key") == ranked(lexical.top(lexical.bm25(held, asked), 50), "chunk_id")
        told = index.whole().first()
        assert (told.n, told.tokens) == (held.count(), held.selectExpr("1").count() and lexical.lengths(held, "chunk_id", "content").groupBy().sum("len").first()[0] or 0)
        return len(index.segments)

    assert agrees() == 1
    (root / "d0.txt").write_text(body[6] + " the noir")
    (root / "d9.txt").write_text("the the the noir\n\nw5 of it")
    archive.ingest(str(root))
    assert agrees() == 2
    archive.remove("d1.txt")
    assert agrees() == 3
    archive.compact()
    assert agrees() == 1


def test_an_empty_index(spark, tmp_path):
    index = inverted.build(str(tmp_path / "i"), spark.createDataFrame([], "chunk_id string, content string"), "chunk_id", "content")
    asked = spark.createDataFrame([(0, "the")], "query_id bigint, term string")
    assert index.top(asked, 3).count() == 0 and index.phrase(["a", "b"]).count() == 0 and index.whole().first().tokens in (0, None)


def test_texts_are_cut_once_and_entries_travel_by_piece_and_term(spark, tmp_path):
    from pyspark.sql import functions as F

    cut = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k, "the of w1 w2") for k in range(300)], "chunk_id bigint, content string")

    @F.udf("string")
    def counted(text):
        cut.add(1)
        return text

    index = inverted.build(str(tmp_path / "i"), rows.withColumn("content", counted.asNondeterministic()("content")), "chunk_id", "content", 3)
    assert cut.value == 300 and index.whole().first().tokens == 1200
    assert inverted.entries(rows.coalesce(1), "chunk_id", "content").groupBy("part").count().count() == inverted.PARTS  # frequent terms, by ranges of places
    rarer = rows.selectExpr("chunk_id", "concat('x', chunk_id % 20) AS content").coalesce(1)
    assert inverted.entries(rarer, "chunk_id", "content").count() == 20


@pytest.mark.parametrize("piece", [1, 40, 1 << 19])
def test_pieces_of_any_size_give_the_same_postings(chunks, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(inverted, "PIECE", piece)
    monkeypatch.setattr(inverted, "BLOCK", 8)
    index = inverted.build(str(tmp_path / "i"), chunks, "chunk_id", "content", 3)
    got = sorted((r.key, r.term, r.tf, r.len, tuple(r.spots)) for r in index.entries().collect())
    size = {r.chunk_id: r.len for r in lexical.lengths(chunks, "chunk_id", "content").collect()}
    assert got == sorted((r.chunk_id, r.term, r.tf, size[r.chunk_id], tuple(r.positions)) for r in lexical.postings(chunks, "chunk_id", "content").collect())
    blocks = index._union("postings").collect()
    assert all(b.n == len(b.ids) <= 8 and list(b.places) == sorted(b.places) and (b.low, b.high) == (b.places[0], b.places[-1]) for b in blocks)
    merged = str(tmp_path / "m")
    inverted.write(merged, inverted.packed(index.entries()), index.whole().select("n", "tokens"), shards=3)
    again = inverted.Index(index.spark, [(0, merged)], 3)
    assert sorted((r.key, r.term, r.tf, r.len, tuple(r.spots)) for r in again.entries().collect()) == got


def test_many_queries_are_scored_by_cell(spark, chunks, queries, tmp_path, monkeypatch):
    index = inverted.build(str(tmp_path / "i"), chunks, "chunk_id", "content", 5)
    want = ranked(lexical.top(lexical.bm25(chunks, queries), 7), "chunk_id")
    monkeypatch.setattr(inverted, "MANY", 1)
    monkeypatch.setattr(inverted, "CELL_CHUNKS", 8)
    monkeypatch.setattr(inverted.Index, "scores", None)  # no join of postings and queries
    assert ranked(index.top(queries, 7), "key") == want
    monkeypatch.setattr(inverted, "PIECE", 200)
    assert ranked(index.top(queries, 7), "key") == want


def test_a_task_holds_a_piece_of_tokens(chunks, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(inverted, "PIECE", 64)  # more than any text has
    held = inverted.entries(chunks.coalesce(1), "chunk_id", "content").agg(F.max(F.size("spots")), F.sum(F.size("spots"))).first()
    assert held[0] <= 64 and held[1] == inverted.totals_of(chunks, "content").first().tokens
