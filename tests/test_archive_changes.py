"""Archives that change, retrieval by words and vectors, and where answers come from when no table states them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import columns as C
from foliant.operators import figures, lexical, retrieval, vector
from foliant.operators.chunking import chunk
from foliant.plans import ask, language
from foliant.plans.service import Service
from foliant.sources.archive import Archive, Conflict, Settings

BOX = "| Field | Value |\n|---|---|\n"


def store(spark, tmp_path, files, **more):
    root = tmp_path / "c"
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    made = Archive(spark, str(tmp_path / "s"))
    return root, made, made.ingest(str(root), **more)


def paths(archive, current=True):
    rows = archive.table("documents")
    return sorted(r.relative_path for r in (rows.filter("superseded_by IS NULL") if current else rows).collect())


def test_a_twin_that_comes_later_supersedes_what_is_stored(spark, tmp_path):
    root, made, _ = store(spark, tmp_path, {"wiki/a.txt": "one in text\n", "wiki/b.md": "# B\n\n" + BOX + "| Garrison | 4 |\n"})
    (root / "wiki/a.md").write_text("# A\n\none in markdown\n")
    made.ingest(str(root))
    assert paths(made) == ["wiki/a.md", "wiki/b.md"] and len(paths(made, False)) == 3
    assert sorted(r.content for r in made.table("chunks").filter("content_type = 'paragraph'").collect()) == ["A\n\none in markdown"]
    assert made.table("facts").count() == 1
    (root / "wiki/a.md").write_text("# A\n\nchanged\n")
    report = made.ingest(str(root)).first()
    assert (report.discovered, report.ingested, report.superseded) == (3, 1, 1)
    made.remove("wiki/a.md")
    again = made.ingest(str(root), only="wiki/a.txt").first()
    assert again.discovered == 1 and paths(made) == ["wiki/a.txt", "wiki/b.md"]
    assert "one in text" in {r.content for r in made.table("chunks").collect()}


def test_twins_are_told_across_streamed_batches(spark, tmp_path):
    from foliant.streaming.ingest import follow

    root, made, _ = store(spark, tmp_path, {"wiki/a.txt": "one\n"})
    (root / "wiki/a.md").write_text("# A\n\ntwo\n")
    follow(spark, str(root), made, str(tmp_path / "k")).awaitTermination()
    assert paths(made) == ["wiki/a.md"]


@pytest.mark.parametrize("deltas", [16, 2])
def test_incremental_tables_are_those_of_a_fresh_archive(spark, tmp_path, monkeypatch, deltas):
    from foliant.sources import archive

    monkeypatch.setattr(archive, "DELTAS", deltas)
    files = {f"wiki/k{n}.md": f"# Keep {n}\n\nBy [[Keep {(n + 1) % 4}]].\n\n{BOX}| Garrison | {n} |\n| Ruled by | [[House {n % 2}]] |\n" for n in range(4)}
    root, made, _ = store(spark, tmp_path, files)
    (root / "wiki/k1.md").write_text(files["wiki/k1.md"].replace("| 1 |", "| 11 |"))
    (root / "wiki/k9.md").write_text("# Keep 9\n\nnothing\n")
    made.ingest(str(root))
    made.remove("wiki/k9")
    assert [whole for _, whole in made._history()] == [True, False, deltas == 2]
    if deltas == 16:
        assert spark.read.parquet(f"{made.path}/v2/chunks").select("document_id").distinct().count() == 2  # what was parsed, no more
    made.vacuum(1)
    fresh = Archive(spark, str(tmp_path / "fresh"))
    fresh.ingest(str(root), only="wiki/k")
    fresh.remove("wiki/k9")
    for name in (*Archive.NAMES, "vectors"):
        columns = [c for c in made.table(name).columns if c not in ("ingested_at", "embedding")]
        assert sorted(map(repr, made.table(name).select(columns).collect())) == sorted(map(repr, fresh.table(name).select(columns).collect())), name


def test_ingestion_by_prefix_by_number_and_by_force(spark, tmp_path):
    root, made, report = store(spark, tmp_path, {"wiki/a.md": "# A\n\na\n", "wiki/b.md": "# B\n\nb\n", "codex/c.md": "# C\n\nc\n"}, only="wiki/", limit=1)
    assert paths(made) == ["wiki/a.md"] and report.first().discovered == 1
    forced = made.ingest(str(root), force=True).first()
    assert (forced.ingested, forced.unchanged) == (3, 1)
    assert {"chunks", "facts", "vectors"} <= set(made.views())
    assert spark.sql("SELECT count(*) AS n FROM documents").first().n == 3
    made.reset()
    assert made.table("documents").count() == made.table("facts").count() == made.table("chunks").count() == 0
    assert made.vacuum(1) == [1, 2, 3] and made._versions() == [4] and made.table("documents").count() == 0


def test_two_writers_of_one_version_are_told(spark, tmp_path):
    root, made, _ = store(spark, tmp_path, {"wiki/a.md": "# A\n\na\n"})
    made._claim(2)
    with pytest.raises(Conflict):
        made.ingest(str(root))
    made.abandon()
    made.ingest(str(root))
    assert made._versions() == [1, 2]


def test_settings_come_from_the_environment():
    found = Settings.from_environment({"FOLIANT_ITERATIONS": "3", "FOLIANT_SECONDS": "1.5", "FOLIANT_WEIGHT_BM25": "0.7"})
    assert (found.iterations, found.seconds, found.weights["bm25"], found.weights["vector"]) == (3, 1.5, 0.7, 0.3)


def block(text, kind="paragraph", path=()):
    return {"text": text, "content_type": kind, "section_path": list(path), "page": None, "table_id": None, "figure_id": None, "ocr_confidence": None}


def test_a_carried_tail_goes_to_the_section_of_what_follows():
    found = chunk("d", [block("x" * 300, path=["A"]), block("B", "heading", ["B"]), block("of section b", path=["B"])], 1200, 180)
    assert [(c["section_path"], c["content"]) for c in found] == [(["A"], "A\n\n" + "x" * 300), (["B"], "B\n\n" + "x" * 180 + "\n\nof section b")]


def test_tails_at_tables_headings_ends_and_blanks():
    long, table = block("x" * 300, path=["A"]), block("t", "table", ["B"])
    head = block("B", "heading", ["B"])
    sizes = lambda blocks: [len(c["content"].split("\n\n", 1)[-1]) for c in chunk("d", blocks, 1200, 180)]
    assert sizes([long, table, block("after", path=["B"])]) == [300, 1, 5]  # nothing is carried past a table
    assert sizes([long, head, table]) == [300, 180, 1]  # a tail alone is a chunk
    assert sizes([long, head, head]) == [300, 180]  # one of exactly the overlap is not carried again
    assert sizes([long]) == [300] and sizes([block("", "page"), block("  ")]) == []
    assert [c["chunk_id"][-9:] for c in chunk("d", [head, block("a", path=["B"]), head, block("b", path=["B"])])] == ["-s01-c000", "-s02-c001"]
    assert chunk("d", [block("B of all", path=["B"])])[0]["content"] == "B of all"


def test_components_are_those_of_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    topics = [[f"{t}{k}" for k in "abcdefgh"] for t in ("sea", "war", "ice", "sun", "elf", "oak")]
    texts = [" ".join(rng.choice(topics[n % 6], 12)) + f" {topics[(n + 1) % 6][0]}" for n in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    vectors, index, idf, parts = vector.lsa(docs, "doc_id", "text", 5)
    a = np.zeros((len(texts), len(index)))
    for row, text in enumerate(texts):
        counts = {w: text.split().count(w) for w in text.split()}
        for w, c in counts.items():
            if w in index:
                a[row, index[w]] = (0.5 + 0.5 * c / max(counts.values())) * idf[index[w]]
    dense = a @ np.linalg.svd(a, full_matrices=False)[2][:5].T
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    got = np.array([r.embedding for r in vectors.orderBy("doc_id").collect()])
    assert np.abs(got @ got.T - dense @ dense.T).max() < 1e-3


def test_marks_on_letters_are_folded(spark):
    rows = spark.createDataFrame([("a", "Élan vital à l’Étretat"), ("b", "plain elan"), ("c", "ño")], "chunk_id string, content string")
    assert [t.t for t in rows.select(lexical.tokens(F.col("content")).alias("t")).collect()] == [["elan", "vital", "etretat"], ["plain", "elan"], ["no"]]
    asked = spark.createDataFrame([(0, "elan")], "query_id bigint, term string")
    assert {r.chunk_id for r in lexical.bm25(rows, asked).collect()} == {"a", "b"}
    assert lexical.query_terms("The Cinder-Wrought Élan's x") == (["the", "cinder-wrought", "elan's"], [["cinder", "wrought"]])


def test_few_and_many_terms_score_alike(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("content"))
    asked = spark.createDataFrame([(0, "the"), (0, "of"), (1, "the"), (1, "the")], "query_id bigint, term string")
    score = lambda: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in lexical.bm25(docs, asked, "doc_id").collect())
    few = score()
    monkeypatch.setattr(lexical, "TERMS", 1)
    assert few == score() and few


ARTICLES = {
    "wiki/war.md": "# Reed War (conflict)\n\n" + BOX + "| Victor | House Oren |\n",
    "wiki/oren.md": "# House Oren (faction)\n\n" + BOX + "| Doctrine | patience |\n| Seat | [[Heron Vale]] |\n",
    "wiki/keep.md": "# Mist Keep (location)\n\nIt stands by a lake of herons.\n\n" + BOX + "| Known lair-region | none recorded |\n| Location | [[Heron Vale]] |\n",
    "wiki/both.md": "# Grey Lance (artifact)\n\n" + BOX + "| Forged at | [[Mist Keep]] |\n| Forged | 12 AS |\n",
    "wiki/tales.md": "# Tales\n\nThe Pale Ring is old. It was forged in 77 AS. Its history is long.\n",
    "wiki/images/rating_old_wyrm.png": b"not a picture",
}


@pytest.fixture(scope="module")
def tales(spark, tmp_path_factory):
    return store(spark, tmp_path_factory.mktemp("tales"), ARTICLES)[1]


@pytest.mark.parametrize(
    ("question", "how", "expect"),
    [
        ("Who was the victor of the Reed War?", "facts", "House Oren"),
        ("What did House Oren win?", "reverse", "Reed War"),
        ("In which region lies Mist Keep?", "graph", "Heron Vale"),
        ("When was the Pale Ring forged?", "prose", "77 AS"),
    ],
)
def test_where_answers_come_from(tales, question, how, expect):
    names = {"pale ring": "pale_ring"}
    found = ask.Investigator(tales)
    held = found.names_in
    found.names_in = lambda text: held(text) | ({k: v for k, v in names.items() if k in text.lower()})
    answer = found.ask(question)
    assert expect in answer.headline and answer.claims[0]["how"] == how
    assert answer.claims[0]["evidence"] and answer.claims[0]["evidence"][0]["excerpt"]


def test_place_and_time_of_one_word(tales):
    found = ask.Investigator(tales).ask("Where and when was the Grey Lance forged?")
    assert found.question.intent == "multi_fact" and "12 AS" in found.headline and "Mist Keep" in found.headline
    assert ask.Investigator(tales).ask("Where was the Grey Lance forged?").headline == "Mist Keep"


def test_a_plate_without_words_is_named_as_a_gap(tales):
    found = ask.Investigator(tales)
    found.names_in = lambda _: {"old wyrm": "old_wyrm"}
    answer = found.ask("What is the threat rating of Old Wyrm?")
    assert answer.status == "partial_visual" and "Old Wyrm" in answer.visual_gaps[0]

    class Sees:
        available = True

        def describe(self, path, question):
            return "a mark of 7", "seen"

    found = ask.Investigator(tales, vision=Sees())
    found.names_in = lambda _: {"old wyrm": "old_wyrm"}
    answer = found.ask("What is the threat rating of Old Wyrm?")
    assert answer.headline == "a mark of 7" and answer.claims[0]["how"] == "vision"


def test_a_model_fills_gaps_and_overrules_nothing(tales):
    class Model:
        available = True

        def understand(self, question):
            return {"entities": ["Mist Keep"], "attributes": ["garrison_strength"]}

        def queries(self, question, gaps):
            return ["herons lake"]

        def claims(self, question, passages):
            return [{"subject": "Mist Keep", "attribute": "garrison_strength", "value": "herons", "evidence_id": p["evidence_id"]} for p in passages if "herons" in p["content"]]

        def answer(self, question, passages):
            return "prose"

    found = ask.Investigator(tales, model=Model())
    assert found.ask("Who was the victor of the Reed War?").headline == "House Oren"
    answer = found.ask("Tell of the garrison by the lake, Mist Keep")
    assert answer.claims[0]["how"] == "model" and answer.headline == "herons"


@pytest.mark.parametrize(("mode", "channels"), [("hybrid", {"keyword", "vector"}), ("keyword", {"keyword"}), ("vector", {"vector"})])
def test_search_modes(tales, mode, channels):
    hits = Service(tales).search("forged lance keep", mode=mode)
    assert hits and {c for h in hits for c in h["channels"].split("+")} <= channels
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1))


def test_search_stands_without_vectors(tales):
    made = retrieval.of(tales)
    made.parts = made.parts[:, :1]  # vectors of other dimensions than the stored ones
    hits = made.search([(0, "forged lance")]).collect() if made._semantic([(0, "forged lance")], 3) is None else None
    bare = retrieval.Retriever(tales.table("chunks"))
    assert not bare.semantic and bare.search([(0, "forged lance")]).collect()
    assert hits is None or hits


def test_service_answers_with_documents_and_assets(tales):
    made = Service(tales)
    found = made.question("Who was the victor of the Reed War?")
    assert found["claims"][0]["evidence"][0]["relative_path"] == "wiki/war.md" and found["answer_type"] == "entity"
    assert made.modes()["vector"] and made.modes()["keyword"]
    plate = tales.table("figures").first()
    assert made.asset(plate.figure_id, "/data").startswith("/data/") and made.asset("none", "/data") is None
    assert made.indexes()["pages"] == 5 + 1


def test_sweep_and_diagnosis(tales, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"probes": [{"q": "lake of herons", "expect_doc_contains": "keep"}]}))
    rows = Service(tales).sweep(str(tmp_path / "p.json"), 3).collect()
    assert len(rows) == 3 and max(r.recall_5 for r in rows) == 1
    (tmp_path / "q.json").write_text(json.dumps([{"q": "Who was the victor of the Reed War?", "expect": "House Oren"}, {"q": "Who was the victor of the Reed War?", "expect": "House Nobody"}]))
    assert [tuple(r) for r in Service(tales).diagnose(str(tmp_path / "q.json")).collect()] == [("INGESTION", 1)]


@pytest.mark.parametrize(
    ("text", "pairs"),
    [
        ("What percentage of the casualties of X were the casualties of Y?", [("y", "recorded_casualties"), ("x", "recorded_casualties")]),
        ("What is the garrison of X as a percentage of the threat rating of Y?", [("x", "garrison_strength"), ("y", "threat_rating")]),
        ("What percentage of the garrison of X is the threat rating of Y?", [("y", "threat_rating"), ("x", "garrison_strength")]),
    ],
)
def test_denominators_are_named_after_of(text, pairs):
    found = ask.analyse(text.replace("X", "Xan").replace("Y", "Yor"), {"xan": "x", "yor": "y"})
    assert (found.intent, found.operands) == ("calculation", pairs)


def test_cues_are_words_and_openers_name_no_relation():
    assert language.bridge("Which faction won the war?") is None
    assert language.bridge("Which faction is he a member of?") == "member_of"
    assert language.bridge("the place where the wyrm makes its home") == "lair"
    assert language.said("objection", "why would it be a mistake to say so") and not language.said("objection", "why would it incorrect")
    assert not language.said("settled", "an incorrect claim") and language.said("settled", "the correct claim")


def test_names_that_are_alike(spark):
    rows = spark.createDataFrame([("Ash-Wyrm", "the ash wyrm", True), ("Keep", "Crookgate Keep", True), ("", "x", False), ("a", "b", False)], "a string, b string, ok boolean")
    assert rows.filter(C.alike(F.col("a"), F.col("b")) != F.col("ok")).count() == 0


def test_bars_of_a_picture(spark):
    image = np.full((200, 500, 3), 255, np.uint8)
    for top, length, colour in ((20, 89, (60, 90, 160)), (60, 249, (60, 90, 160)), (100, 387, (60, 90, 160)), (140, 153, (200, 60, 40))):
        image[top : top + 20, 50 : 50 + length] = colour
    image[180:185, 10:400] = (60, 90, 160)  # too thin
    assert [(b[1], b[2]) for b in figures.bars(image)] == [(20, 89), (60, 249), (100, 387), (140, 153)]
    assert len({b[4] for b in figures.bars(image)}) == 2
    titles = spark.createDataFrame([("Plate 7 - Recorded garrison strength of the Keep",), ("Threat rating",), ("A view",)], "t string")
    assert [r.a for r in titles.select(figures.attribute_of_title(F.col("t")).alias("a")).collect()] == ["garrison_strength", "threat_rating", None]


def pdf_file(pages, compress=False, packed=False):
    """A PDF of pages of (font size, y, text) lines; ``packed`` puts the page objects into an object stream."""
    import zlib

    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    plain = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", 3: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    streams = {}
    for k, lines in enumerate(pages):
        plain[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R /Resources << /Font << /F1 3 0 R >> >> >>"
        streams[11 + 2 * k] = "\n".join(f"BT /F1 {size} Tf 1 0 0 1 50 {y} Tm ({text}) Tj ET" for size, y, text in lines).encode("latin-1")
    out = b"%PDF-1.5\n"
    if packed:
        bodies = [(n, b.encode()) for n, b in plain.items()]
        places, at = [], 0
        for n, body in bodies:
            places += [n, at]
            at += len(body) + 1
        head = " ".join(map(str, places)).encode() + b"\n"
        data = zlib.compress(head + b"\n".join(b for _, b in bodies) + b"\n")
        out += b"90 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(bodies), len(head), len(data)) + data + b"\nendstream\nendobj\n"
    else:
        out += b"".join(f"{n} 0 obj\n{b}\nendobj\n".encode() for n, b in plain.items())
    for n, body in streams.items():
        data = zlib.compress(body) if compress else body
        out += b"%d 0 obj\n<< %s/Length %d >>\nstream\n" % (n, b"/Filter /FlateDecode " if compress else b"", len(data)) + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGES = [[(18, 700, "Mist Keep"), (12, 660, "It stands by \\(or near\\) a lake"), (12, 646, "of herons."), (12, 600, "A second paragraph.")], [(12, 700, "On the second page.")], []]


@pytest.mark.parametrize(("compress", "packed"), [(False, False), (True, False), (True, True)])
def test_text_layers_of_pdf_files(compress, packed):
    from foliant.sources import parsers

    got = parsers.parse("pdf", pdf_file(PAGES, compress, packed), "d", "a.pdf")
    assert [(b["content_type"], b["text"], b["page"], b["section_path"]) for b in got.blocks] == [
        ("heading", "Mist Keep", 1, ["Mist Keep"]), ("paragraph", "It stands by (or near) a lake of herons.", 1, ["Mist Keep"]),
        ("paragraph", "A second paragraph.", 1, ["Mist Keep"]), ("paragraph", "On the second page.", 2, ["Mist Keep"]),
    ]
    assert got.pages == 3 and len(got.warnings) == 1 and "OCR" in got.warnings[0]


def test_pdf_files_that_cannot_be_read():
    from foliant.sources import parsers, pdf_text

    for data, said in ((b"nothing", "header"), (b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>", "encrypted"), (b"%PDF-1.4\n1 0 obj\n<<>>\nendobj", "no pages"), (pdf_file(PAGES)[:300], "")):
        got = parsers.parse("pdf", data, "d", "a.pdf")
        assert not got.blocks and got.warnings and said in got.warnings[0]
    codes = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0300> <0302> <00E9> endbfrange"
    known = pdf_text._unicode_map(codes)
    assert pdf_text.page_text(b"BT /F2 10 Tf [<0001> -300 <0300> 20 <0302>] TJ ET", {b"F2": known}) == "A \xe9\xeb"


def test_answers_of_a_model_outlive_the_process(tmp_path):
    from foliant.sources.gateway import FileCache, Gateway

    calls = []
    ask_model = lambda prompt: calls.append(prompt) or '{"answer": "x"}'
    for _ in range(2):
        assert Gateway(ask_model, cache=FileCache(str(tmp_path / "answers"))).answer("q", []) == "x"
    held = FileCache(str(tmp_path / "answers"))
    assert len(calls) == len(held) == 1
    held[next(iter(held))] = "{broken"
    assert Gateway(ask_model, cache=held).answer("q", []) == "x" and len(calls) == 2


def test_hops_begin_with_what_the_subject_records(tales):
    answer = ask.Investigator(tales).ask("What is the seat of the victor of the Reed War?")
    assert (answer.question.bridge, answer.headline) == ("victor", "Heron Vale")


@pytest.mark.parametrize(
    ("content", "value", "said"),
    [
        ("Columns: Field | Value\n| **Forged** | [[Mist Keep]] in 12 AS |\nForged | 12 AS and much besides", "12 AS", "Forged — Mist Keep in 12 AS"),
        ("It is *old*. It was forged in\n12 AS, they say. No more.", "12 AS", "It was forged in 12 AS, they say."),
        ("x" * 100 + " forged 12. AS it is " + "y" * 300, "12 AS", "window"),
        ("The Keep is old. Nothing else.", "12 AS", "The Keep is old."),
        ("Nothing at all.", "12 AS", ""),
        ("a | b", " - ", ""),
        ("z " * 300 + "12 AS", "12 AS", "long"),
    ],
)
def test_excerpts(spark, content, value, said):
    from foliant.operators import evidence

    got = spark.createDataFrame([(content, value, "keep")], "c string, v string, s string").select(evidence.excerpt(F.col("c"), F.col("v"), F.col("s")).alias("x")).first().x
    if said == "window":
        assert got.startswith("…") and "12. AS" in got and len(got) <= 220
    elif said == "long":
        assert len(got) <= 220 and got.endswith("…")
    else:
        assert got == said


def test_claims_are_atomic_and_run_out(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root, made, _ = store(spark, tmp_path, {"wiki/a.md": "# A\n\na\n"})
    with ThreadPoolExecutor(8) as pool:
        won = [f.exception() is None for f in [pool.submit(Archive(spark, made.path)._claim, 2) for _ in range(8)]]
    assert sum(won) == 1
    with pytest.raises(Conflict):
        made.ingest(str(root))
    (root / "wiki/b.md").write_text("# B\n\nb\n")
    made.ingest(str(root), Settings(claim_seconds=0.0))  # the dead claim frees itself
    assert made._versions() == [1, 2] and paths(made) == ["wiki/a.md", "wiki/b.md"]
    token = made._claim(3)
    made._claim(3, Settings(claim_seconds=0.0))
    with pytest.raises(Conflict):
        made._commit(3, False, token)


def test_a_twin_takes_the_place_of_a_removed_winner(spark, tmp_path):
    root, made, _ = store(spark, tmp_path, {"wiki/a.txt": "one in text\n", "wiki/a.md": "# A\n\none in markdown\n", "wiki/b.txt": "two\n", "wiki/b.md": "# B\n\ntwo\n"})
    (root / "wiki/b.txt").unlink()
    made.remove("wiki/a.md")
    assert paths(made) == ["wiki/a.txt", "wiki/b.md"] and made.unread().count() == 0
    assert any("one in text" in r.content for r in made.table("chunks").collect())
    made.remove("wiki/b.md")
    assert [r.relative_path for r in made.unread().collect()] == ["wiki/b.txt"]


def test_lookups_read_the_row_groups_of_their_keys(spark, tmp_path, monkeypatch):
    from foliant.sources import archive as A

    monkeypatch.setattr(A, "ROW_GROUP", 1 << 12)
    rows = spark.range(60_000).selectExpr("concat('subject_', lpad(id % 20000, 6, '0')) AS subject_id", "sha2(cast(id AS string), 256) AS value_text", "'x' AS attribute")
    A.clustered(rows, "facts").parquet(str(tmp_path / "facts"))
    one = spark.read.parquet(str(tmp_path / "facts")).filter("subject_id IN ('subject_000777')")
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan()
    one._jdf.collectToPython()
    read = [m for m in str(plan.toString()).split("\n") if "PushedFilters" in m]
    scan = plan.collectLeaves().apply(0)
    assert "subject_000777" in read[0] and scan.metrics().apply("numOutputRows").value() < 15_000


def test_new_chunks_are_folded_into_the_space_until_it_no_longer_fits(spark, tmp_path):
    import random

    import numpy as np

    from foliant.operators import vector

    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("red", "blue", "green", "old") for b in ("fox", "whale", "frog", "leaf", "stone")]
    say = lambda k: " ".join(rng.choice(words[5 * (k % 4) : 5 * (k % 4) + 5]) for _ in range(30))
    root, made, _ = store(spark, tmp_path, {f"wiki/k{k}.txt": say(k) + "\n" for k in range(24)}, settings=Settings(dimensions=6))
    state = lambda: made._space_state(made._history())
    assert (state().fit_version, state().folded) == (1, 0) and made.table("vectors").count() == made.table("chunks").count()
    (root / "wiki/new.txt").write_text(say(1) + "\n")
    made.ingest(str(root), Settings(dimensions=6))
    assert (state().fit_version, state().folded, state().gone) == (1, 1, 0)
    assert made.table("vectors").count() == made.table("chunks").count() == 25
    held = {r.chunk_id: np.array(r.embedding) for r in made.table("vectors").collect()}
    space = made.table("vector_space").orderBy("term").collect()
    chunks = {r.chunk_id: r.content for r in made.table("chunks").collect()}
    want = vector.embed(list(chunks.values()), {r.term: k for k, r in enumerate(space)}, np.array([r.idf for r in space]), np.array([r.component for r in space]))
    assert all(np.allclose(held[c], w, atol=1e-5) for c, w in zip(chunks, want, strict=True))
    (root / "wiki/odd.txt").write_text(" ".join(f"unheard{k} of{k}" for k in range(90)) + "\n")  # no word of the space: too little is kept of it
    made.ingest(str(root), Settings(dimensions=6))
    assert state().fit_version == 3 and state().folded == 0 and made.table("vectors").count() == 26
    made.compact()
    assert made.table("vectors").count() == 26 and state().fit_version == 4
