import pytest

from foliant.operators.chunking import chunk
from foliant.plans import ask
from foliant.sources import parsers
from foliant.sources.archive import Archive, Settings

INFOBOX = "## Infobox\n\n| Field | Value |\n|---|---|\n"
FILES = {
    "wiki/greyfell_keep.md": "# Greyfell Keep (location)\n\nBy [[Morrow Wyrm|the wyrm]].\n\n" + INFOBOX + "| Founded | Contested; no year is stated |\n| Ruled by | [[House Varn]] |\n| Garrison | 3,107 |\n",
    "codex/greyfell_record.md": "# Greyfell Keep\n\n| Field | Value |\n|---|---|\n| Founded | 235 AS |\n| Ruling power | House Varn |\n",
    "wiki/morrow_wyrm.md": "# Morrow Wyrm (creature)\n\n" + INFOBOX + "| Lair | [[Greyfell Keep]] |\n| Threat rating | 9 |\n",
    "wiki/dusk_aegis.md": "# Dusk Aegis (artifact)\n\n" + INFOBOX + "| Housed in | [[Greyfell Keep]] |\n| Artifact class | shield |\n",
    "wiki/ash_war.md": "# Ash War (conflict)\n\n" + INFOBOX + "| Devastated | [[Greyfell Keep]] in 227 AS |\n| Began | 220 AS |\n| Ended | 231 AS |\n| Victor | [[House Varn]] |\n",
    "wiki/night_war.md": "# Night War (conflict)\n\n" + INFOBOX + "| Devastated | Greyfell Keep in 320 AS |\n| Began | 318 AS |\n",
    "ephemera/contract_concerning_dusk_aegis.md": "The Dusk Aegis is old. Its forged year is **354 AS**. No more is known.\n",
    "ephemera/ballad_concerning_greyfell.txt": "A ballad.\n\nGreyfell Keep stood before the sea.\n",
    "wiki/twin.md": "# Twin\n\nOne.\n",
    "wiki/twin.txt": "# Twin\n\nOne.\n",
    "wiki/README.txt": "skipped",
    "wiki/broken.docx": "no zip",
}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    made = Archive(spark, str(tmp_path_factory.mktemp("store") / "a"))
    made.root = str(root)
    made.report = made.ingest(str(root)).first()
    return made


def test_ingest_reports_and_repeats_without_change(archive):
    assert archive.report.discovered == len(FILES) - 1
    assert archive.report.superseded == 1
    before = sorted(r.chunk_id for r in archive.table("chunks").collect())
    again = archive.ingest(archive.root).first()
    assert (again.ingested, again.unchanged) == (0, len(FILES) - 1)
    assert sorted(r.chunk_id for r in archive.table("chunks").collect()) == before


def test_twins_keep_the_preferred_format(archive):
    rows = {r.relative_path: r.superseded_by for r in archive.table("documents").collect()}
    assert rows["wiki/twin.md"] is None
    assert rows["wiki/twin.txt"]


def test_bad_files_are_reported(archive):
    assert any("docx" in r.message for r in archive.table("warnings").collect())


def test_every_fact_names_a_chunk(archive):
    facts, chunks = archive.table("facts"), archive.table("chunks")
    assert facts.count() and facts.join(chunks, "chunk_id", "left_anti").count() == 0


@pytest.mark.parametrize(
    ("question", "intent", "expect"),
    [
        ("In which year was Greyfell Keep truly founded?", "conflict_resolution", "235 AS"),
        ("Who rules the lair of the Morrow Wyrm?", "relation_hop", "House Varn"),
        ("What is the threat rating of Morrow Wyrm?", "attribute_lookup", "9"),
        ("Which creature has the highest threat rating?", "analysis", "Morrow Wyrm"),
        ("What is the difference between the garrison of Greyfell Keep and the threat rating of Morrow Wyrm?", "calculation", "3,098"),
        ("How long did the Ash War last?", "analysis", "11 years"),
        ("Which came first, the Night War or the Ash War?", "analysis", "ash_war (220 AS), then night_war (318 AS)"),
        ("When was the Dusk Aegis forged?", "attribute_lookup", "354 AS"),
        ("Where is the Dusk Aegis housed?", "attribute_lookup", "Greyfell Keep"),
    ],
)
def test_answers(archive, question, intent, expect):
    found = ask.Investigator(archive).ask(question)
    assert found.question.intent == intent
    assert expect in found.headline
    assert found.status == "completed"
    assert all(c["evidence"] for c in found.claims)


def test_conflict_is_settled_by_reliability(archive):
    found = ask.Investigator(archive).ask("In which year was Greyfell Keep truly founded?")
    assert found.conflicts[0]["gap"] == 0.3
    assert found.claims[0]["kind"] == "conflicting"
    assert found.claims[0]["confidence"] == 0.55
    assert found.claims[0]["evidence"][0]["excerpt"] == "Founded — 235 AS"


def test_presence_is_ruled_out_by_a_later_origin(archive):
    found = ask.Investigator(archive).ask("Why would it be incorrect to say the Dusk Aegis was present when Greyfell Keep fell?")
    assert found.question.intent == "temporal_check"
    assert "227 AS" in found.headline and "320 AS" in found.headline


def test_missing_operand_is_named(archive):
    found = ask.Investigator(archive).ask("What percentage of the garrison of Greyfell Keep is the attunement cost of Morrow Wyrm?")
    assert found.status == "partial_no_progress"
    assert "attunement_cost" in found.headline


def test_unknown_entity_and_budget(archive):
    assert ask.Investigator(archive).ask("Tell me of Nobody").status == "no_entity"
    tight = ask.Investigator(archive, Settings(iterations=1)).ask("Who rules the lair of the Morrow Wyrm?")
    assert (tight.stop, tight.status) == ("iteration_budget", "partial_budget")


def test_changed_files_replace_their_old_version(spark, tmp_path):
    root = tmp_path / "c"
    (root / "wiki").mkdir(parents=True)
    (root / "wiki/a.md").write_text("# A\n\none")
    store = Archive(spark, str(tmp_path / "s"))
    store.ingest(str(root))
    (root / "wiki/a.md").write_text("# A\n\ntwo two")
    store.ingest(str(root))
    assert [r.content for r in store.table("chunks").collect()] == ["A\n\ntwo two"]


def test_streamed_files_reach_the_archive(spark, tmp_path):
    from foliant.streaming.ingest import follow

    root = tmp_path / "c"
    (root / "wiki").mkdir(parents=True)
    (root / "wiki/a.md").write_text("# A\n\none")
    store = Archive(spark, str(tmp_path / "s"))
    follow(spark, str(root), store, str(tmp_path / "k")).awaitTermination()
    assert store.table("documents").count() == 1


def test_event_windows_and_sessions(spark):
    from foliant.streaming.ingest import sessions, windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sum(r.n for r in windows(events).collect()) == events.count()
    assert sum(r.n for r in sessions(events).collect()) == events.count()


def _block(text, kind="paragraph", path=(), page=None):
    return {"text": text, "content_type": kind, "section_path": list(path), "page": page, "table_id": None, "figure_id": None, "ocr_confidence": None}


def test_tables_are_never_split_or_merged():
    found = chunk("d", [_block("a" * 100), _block("t" * 5000, "table"), _block("b" * 100)])
    assert [c["content_type"] for c in found] == ["paragraph", "table", "paragraph"]
    assert len(found[1]["content"]) == 5000


def test_overlap_and_pages():
    found = chunk("d", [_block("x" * 1000, page=1), _block("y" * 1000, page=2)], 1200, 180)
    assert found[1]["content"].startswith("x" * 180)
    assert (found[0]["page_start"], found[1]["page_end"]) == (1, 2)
    assert found[0]["char_end"] == found[1]["char_start"]


def test_headings_bind_and_number_sections():
    found = chunk("d", [_block("One", "heading", ["One"]), _block("text", path=["One"]), _block("Two", "heading", ["Two"]), _block("more", path=["Two"])])
    assert [c["content"] for c in found] == ["One\n\ntext", "Two\n\nmore"]
    assert [c["chunk_id"][-9:-5] for c in found] == ["-s01", "-s02"]


def test_markdown_blocks():
    got = parsers.markdown(b"# T\n\npara [[X]]\n\n![cap](a.png)\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "d")
    assert [b["content_type"] for b in got.blocks] == ["heading", "paragraph", "figure", "table"]
    assert got.tables[0]["rows"] == [["1", "2"]]
