"""The pipeline against brute force, stage after stage, each on what the one before it kept."""

import re
from collections import Counter

import corpus_pipeline
import fixtures as X
from foliant.llm import oracles
from foliant.llm.storage import keep
from test_text_operators import aligned, counted, deduped, linked, words


def kept(text):
    n, chars, symbols, dup, _, failed = counted(text)
    w = words(text)
    stop = {x + end for x in (*oracles.STOP_WORDS, *(x.capitalize() for x in oracles.STOP_WORDS)) for end in ("", ",", ".")}
    lines = [x for x in (text or "").split("\n") if words(x)]
    rules = {
        "mean_word_chars": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "stop_word_ratio": sum(x in stop for x in w) / max(n, 1), "stutter_ratio": sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(n, 1),
        "dup_line_ratio": dup / max(len(lines), 1), "capital_ratio": len(re.findall("[A-Z]", text or "")) / max(chars, 1), "shout_ratio": (text or "").count("!!") / max(n, 1),
    }
    return not failed and all((r.low is None or rules[r.measure] >= r.low) and (r.high is None or rules[r.measure] <= r.high) for r in oracles.RULES)


def test_pipeline(spark, tmp_path):
    X.documents(spark, repeat=False).write.parquet(str(tmp_path / "documents.parquet"))
    passage = next(t for t in X.texts() if t and 60 < len(t.split(" ")) < 200)
    spark.createDataFrame([(0, " ".join(passage.split(" ")[5:40])), (1, "never seen words of nothing else at all"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    items = [r.text for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, rows = docs.columns, X.plain_rows(docs)
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, str(tmp_path)), "test")
        results.append(docs)
    rows = [r for r in rows if kept(r[1])]
    assert sorted(X.plain_rows(results[0])) == sorted(rows) and len(rows) > 20
    rows = [(d, t if n == 0 else cut) for (d, t), (_, _, n, cut) in zip(rows, deduped(rows), strict=True)]
    assert sorted(X.plain_rows(results[1])) == sorted(rows)
    rows = [r for r, (d, _, c, _) in zip(rows, linked(rows), strict=True) if c == d]
    assert sorted(X.plain_rows(results[2])) == sorted(rows)
    clean = [r for r in rows if not any(aligned(r[1], x) for x in items)]
    assert sorted(X.plain_rows(results[3])) == sorted(clean) and len(clean) < len(rows)
    assert all(df.columns == columns for df in results[:4])
    mixed = results[4].collect()
    assert Counter((r.doc_id, r["size"]) for r in mixed) == Counter((d, len(words(t))) for d, t in clean)
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(r["size"] for r in mixed)) <= len({r.source for r in mixed}) + 1
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))


def test_pipeline_agrees_with_sql(spark):
    from oracle import SF, connect, same

    same(corpus_pipeline.run(spark, SF), corpus_pipeline.ORACLE_SQL, connect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    X.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a text")], "item_id bigint, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
