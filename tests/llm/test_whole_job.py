"""What a review found missing, each told on the smallest table that shows it."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import fixtures as X
import numpy as np
from foliant.llm import ngram_lm, pii, url_filter
from foliant.llm.storage import keep
from test_text_operators import deduped, linked, shingles


def marked(found, kind="term"):
    """The texts of a row's spans of a kind, by document."""
    return {r.doc_id: {r.text[s.start : s.end] for s in r.all_spans if s.kind == kind} for r in found.collect()}


def spans_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return pii.spans(docs).join(docs, "doc_id")


def test_terms_of_rare_entities_and_of_constant_surroundings_disclose(spark):
    plain = [(1000 + k, f"plain words that say nothing of number w{k}") for k in range(400)]
    once = [(0, "plain words that say zanzibar al@x.org nothing")]
    line = [(10 + k, f"plain words w{k}\nquokka bob@x.org wombat\nthat say w{k % 7} w{k % 5}") for k in range(40)]
    copies = [(500 + k, once[0][1]) for k in range(20)]
    found = marked(spans_of(spark, plain + once + line + copies))
    assert found[0] == {"zanzibar"} and all(found[k] == {"zanzibar"} for k in range(500, 520))
    assert all(found[10 + k] == {"quokka", "wombat"} for k in range(40))
    assert not any(found[d] for d, _ in plain)


def test_words_are_counted_once_for_copies(spark, monkeypatch):
    texts = ["a b a", "b c", "a b a", "a b a", "", None, "c c"] + [f"c u{k}" for k in range(50)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    names = ["a", "b", "c", "u7"]
    for held in (pii.HELD, 4):
        got = {r.term: r.n for r in pii.document_counts(docs, pii.scan(docs), held).collect()}
        assert [got[h] for h in pii._hashes(names).tolist()] == [1, 2, 52, 1] and len(got) == 53


def test_rules_alone_say_nothing_of_other_urls(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))
    hosts = [("example.com", "/de/"), ("x.net", "/"), ("x.org", "/fr/"), ("example.net", "/en/"), ("com", "/"), ("org", "/en/")]
    urls = [f"http://{name()}.{h}{p}{name()}" for h, p in hosts for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    open_ones = [r for r in url_filter.judge(pages).collect() if r.rule is None]
    assert len(open_ones) == 300 and all(r.verdict == "allow" for r in open_ones)


def test_pages_label_urls_and_trees_decide_those_without_a_rule(spark):
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    good = "<p>" + " ".join(f"the word{k} of" for k in range(20)) + "</p><script>!! !! !!</script>"
    pages, bad = [], set()
    for k in range(1200):
        spam = k % 3 == 0
        url = f"http://{name()}{rng.randint(100, 9999) if spam else ''}.{rng.choice(['com', 'org'])}/en/{name()}"
        pages.append((k, url, "<p>win!! win!!</p>" if spam and k % 30 else good if k % 50 else None))
        bad |= {k} if spam else set()
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = url_filter.judge(table).collect()
    assert len(got) == 1200 and all(r.rule is None for r in got)
    assert sum((r.verdict == "block") == (r.page_id in bad) for r in got) > 1100
    taken = url_filter.labelled_by_pages(table.selectExpr("url", "'' host", "'' path", "html"), 100).count()
    assert 100 <= taken < 160


def test_what_other_rules_foretell_is_learnt():
    rng = random.Random(4)
    rows = [(f"http://h{k % 6}/{'?a=1&b=2&c=3' if k % 2 else ''}", f"h{k % 6}", "/", k % 2, f"h{k % 6}/") for k in range(600)]
    rng.shuffle(rows)
    u, h, p, y, rule = (list(x) for x in zip(*rows, strict=True))
    model = url_filter.fit_rules(u, h, p, np.array(y, float), rule)
    assert (model.score(["http://q/?a=1&b=2&c=3", "http://q/"], ["q", "q"], ["/", "/"]) >= 0.5).tolist() == [True, False]


def test_suffix_rates_hold_no_url_s_own_label():
    rng = random.Random(3)
    urls = [f"http://h{k}.t{k}/" for k in range(1500)]
    hosts = [u[7:-1] for u in urls]
    block = np.array([float(rng.random() < 0.5) for _ in urls])
    model = url_filter.fit(urls, hosts, ["/"] * len(urls), block)
    assert np.mean((model.score(urls, hosts, ["/"] * len(urls)) >= 0.5) == block) < 0.65


def test_labelled_urls_are_measured_on_a_part_not_seen(spark):
    rng = random.Random(5)
    rows = []
    for k in range(3000):
        bad = rng.random() < 0.4
        host = "".join(rng.choice("abcdefgh") for _ in range(8)) + (str(rng.randint(100, 9999)) if bad and rng.random() < 0.9 else "") + rng.choice([".com", ".org"])
        rows.append((f"http://{host}/", host, "/", int(bad)))
    labelled = spark.createDataFrame(rows, "url string, host string, path string, block int")
    found = url_filter.held_out(labelled)
    assert found["judged"] > 400 and found["accuracy"] > 0.9 > found["base"] and found["log_loss"] < 0.3
    assert url_filter.held_out(labelled.limit(0))["judged"] == 0
    pages = spark.createDataFrame([(1, "http://abcdefgh5123.com/"), (2, "http://abcdefgh.com/"), (3, "http://x.net/")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, labelled=labelled).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_thresholds_are_the_quantile_of_held_out_documents(spark):
    rows = [("a", 9, 10.0 * (5 + k / 100)) for k in range(1, 201)] + [("b", 9, 80.0)] * 3 + [("c", 0, 0.0)]
    good = spark.createDataFrame(rows, "key string, words bigint, bits double")
    got = {r.key: r.threshold for r in ngram_lm.thresholds(good).collect()}
    assert got["a"] == 6.98  # the 198th of 200, 5 + 198 / 100
    assert abs(got["b"] - 8 * round(6.98 / 6, 3)) < 0.01 and set(got) == {"a", "b", ngram_lm.POOL}


def survivors(rows):
    """One row of each group of linked rows, told from its definition; rows are (doc_id, text)."""
    ids = [(k, t) for k, (_, t) in enumerate(rows)]
    group = [c if shingles(t) else (c, None) for (_, t), (_, _, c, _) in zip(rows, linked(ids), strict=True)]
    held = {}
    for (d, t), g in zip(rows, group, strict=True):
        held.setdefault(g, []).append((d is None, d or 0, d, t))
    return [(rs, min(r[:2] for r in rs)) for rs in held.values()]


def test_near_duplicates_choose_rows_and_not_ids(spark):
    docs = X.documents(spark)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got, groups = X.plain_rows(out), survivors(X.plain_rows(docs))
    assert out.columns == docs.columns and len(got) == len(groups)
    assert Counter(d for d, _ in got) == Counter(next(r[2] for r in rs if r[:2] == best) for rs, best in groups)
    assert any(t == "another text of the same id entirely" for _, t in got) and all(d is not None for d, _ in got)


def test_pipeline_with_repeated_rows_and_ids(spark, tmp_path):
    docs = X.documents(spark)
    spark.createDataFrame([(1, "never seen words of nothing else at all")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, str(tmp_path)), "test")
        results.append(docs)
    rows = X.plain_rows(results[0])
    cut = [(d, t if n == 0 else kept) for (d, t), (_, _, n, kept) in zip(rows, deduped(rows), strict=True)]
    groups = survivors(cut)
    left = X.plain_rows(results[2])
    assert len(left) == len(groups) < len(cut) and len(set(cut)) < len(cut)
    assert Counter(d for d, _ in left) == Counter(next(r[2] for r in rs if r[:2] == best) for rs, best in groups)
    assert results[4].count() == results[3].count() == len(left)


def test_terms_disclose_wherever_they_stand_in_the_document(spark):
    plain = [(1000 + k, f"plain words that say nothing of number w{k}") for k in range(400)]
    card = "Zanzibar\nal@x.org\nplain words that say nothing of plain words zanzibar that\nsay zanzibar"
    found = spans_of(spark, plain + [(0, card)])
    assert [card[s.start : s.end] for r in found.filter("doc_id = 0").collect() for s in r.all_spans if s.kind == "term"] == ["Zanzibar", "zanzibar", "zanzibar"]


def told_by_definition(rows):
    """(text, term) pairs: every word of a text that holds an entity, judged by counts of distinct texts, PMI, IC and evidence."""
    texts = sorted({t for _, t in rows})
    words = {t: {w for w, _, _ in pii.terms_of(t, pii.find(t))} for t in texts}
    everywhere = {t: {w.translate({c: c + 32 for c in range(65, 91)}) for w in re.split(r"[\x09-\x0d\x20!-/:-@\[-`{-~]+", t)} for t in texts}
    entities = {t: {f"{k}:{v}" for k, _, _, v in pii.find(t)} for t in texts}
    near = {t: {(f"{pii.find(t)[a][0]}:{pii.find(t)[a][3]}", pii.terms_of(t, pii.find(t))[b][0]) for a, b in pii.beside_of(pii.find(t), pii.terms_of(t, pii.find(t)))} for t in texts}
    n, out = len(texts), set()
    for e in set().union(*entities.values()):
        holders = [t for t in texts if e in entities[t]]
        for w in set().union(*(words[t] for t in holders)):
            met, c_t, c_e = sum(w in words[t] for t in holders), sum(w in everywhere[t] for t in texts), len(holders)
            ic = math.log2(n / c_e)
            pmi = math.log2((met + pii.SMOOTHING * c_e / n) / (c_t + pii.SMOOTHING)) + ic
            sure = met / c_t - 0.5 >= pii.SURE * math.sqrt(0.25 / c_t)
            if ic > 0 and pmi >= pii.DISCLOSURE * ic and (sure or any((e, w) in near[t] for t in holders)):
                out |= {(t, w) for t in holders if w in words[t]}
    return out


def planted(rng):
    """Documents of common and rare words; people with a nickname that stands with their address in all their documents, and the nicknames."""
    rare = iter(f"rare{k:05d}x" for k in range(100_000))
    prose = lambda: [next(rare) if rng.random() < 0.1 else f"word{int(rng.paretovariate(1)) % 300}" for _ in range(40)]
    rows, names = [], {}
    for k in range(300):
        rows.append((k, " ".join(prose())))
    for p in range(20):
        for _ in range(1 + p % 4):
            words = prose()
            words.insert(rng.randrange(41), f"nick{p:02d}z")
            at = words.index(f"nick{p:02d}z") + 1 if p % 4 == 0 else rng.randrange(42)
            words.insert(at, f"p{p}@mail.org")
            text = " ".join(words)
            rows += [(len(rows), text)] * rng.choice([1, 1, 3])
            names[text] = f"nick{p:02d}z"
    return rows, names


def test_disclosure_equals_its_definition_and_finds_planted_terms(spark):
    rows, names = planted(random.Random(12))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {(r.text, r.text[s.start : s.end]) for r in pii.spans(docs.dropDuplicates(["text"])).join(docs.dropDuplicates(["text"]), "doc_id").collect() for s in r.all_spans if s.kind == "term"}
    whole = {(r.text, r.text[s.start : s.end]) for r in spans_of(spark, [(k, t) for k, (_, t) in enumerate(rows)]).collect() for s in r.all_spans if s.kind == "term"}
    assert found == whole == told_by_definition(rows)
    hits = sum((t, w) in found for t, w in names.items())
    removed = sum(t.split().count(w) for t, w in found) / sum(len(t.split()) for t in names)
    assert hits == len(names)  # recall
    assert hits / len(found) >= 0.6 and removed < 0.05  # rare words right beside an address are told like its nickname


def test_the_bitmap_of_copies_grows_with_them(spark, monkeypatch):
    texts = [f"alpha w{k % 400}" for k in range(1200)] + [f"beta v{k}" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = Counter(w for t in set(texts) for w in t.split())
    for least, most in ((1 << 15, 1 << 30), (1 << 15, 1 << 15), (1 << 20, 1 << 30)):
        monkeypatch.setattr(pii, "SLOTS", least)
        monkeypatch.setattr(pii, "MOST_SLOTS", most)
        got = {r.term: r.n for r in pii.document_counts(docs, pii.scan(docs)).collect()}
        assert got == dict(zip(pii._hashes(list(want)).tolist(), want.values(), strict=True))
