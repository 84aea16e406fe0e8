import json
import random

import pytest

from foliant.operators import figures
from foliant.plans.operations import OPERATIONS, detect
from foliant.plans.service import Service
from foliant.sources import gateway
from foliant.sources.archive import Archive


@pytest.mark.parametrize(
    ("text", "operation"),
    [("How long did the siege last?", "duration"), ("How many years after the war?", "date_difference"), ("What percentage of it?", "percentage"), ("Which is larger than the other?", "numeric_comparison"), ("Which source should I trust?", "reliability_ranking"), ("What became of the crown?", "history_trace"), ("Who wielded it?", "entity_trace")],
)
def test_operations(text, operation):
    assert operation in [o["operation"] for o in detect(text)]


def test_what_must_run_first_comes_first():
    names = [o["operation"] for o in detect("Which account is most reliable?")]
    assert names.index("conflict_detection") < names.index("reliability_ranking")
    assert all(isinstance(o.needs, tuple) for o in OPERATIONS)


@pytest.mark.parametrize("text", ['{"intent": "open_question"}', '```json\n{"intent": "open_question"}\n```', 'Sure: {"intent": "open_question"} as asked'])
def test_json_is_found(text):
    assert gateway.understanding(gateway.json_of(text))["intent"] == "open_question"


def test_payloads_are_checked():
    assert gateway.understanding({"intent": "made up", "entities": ["a", None, {}]}) == {"intent": None, "entities": ["a"], "attributes": [], "queries": []}
    assert gateway.extracted_claims({"claims": [{"subject": "a", "attribute": "b", "value": "c"}]}) == []
    assert gateway.merged({"intent": "x", "entities": []}, {"intent": "y", "entities": ["e"]}) == {"intent": "x", "entities": ["e"]}


def test_retry_waits_longer_and_gives_up():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise gateway.RateLimited

    with pytest.raises(gateway.RateLimited):
        gateway.retried(call, waits.append, random.Random(1))
    assert len(calls) == 4 and waits == sorted(waits) and waits[-1] <= 5


def test_breaker_opens_and_rests():
    now = [0.0]
    made = gateway.Gateway(lambda _: 1 / 0, breaker=gateway.Breaker(lambda: now[0]), sleep=lambda _: None)
    assert [made.json("v", str(k)) for k in range(4)] == [None] * 4
    assert made.events[-1] == "breaker open"
    now[0] = 31.0
    assert made.breaker.allows()


def test_answers_are_cached_and_corrupt_ones_asked_again():
    calls = []
    made = gateway.Gateway(lambda p: calls.append(p) or '{"answer": "x"}')
    assert made.answer("q", []) == made.answer("q", []) == "x"
    assert len(calls) == 1
    made.cache = {k: "{broken" for k in made.cache}
    assert made.answer("q", []) == "x" and len(calls) == 2
    assert gateway.Gateway().answer("q", []) is None


def test_claims_must_stand_in_their_passage():
    said = {"claims": [{"subject": "Keep", "attribute": "founded", "value": v, "evidence_id": e} for v, e in (("235 AS", "c1"), ("999 AS", "c1"), ("235 AS", "c2"))]}
    made = gateway.Gateway(lambda _: json.dumps(said))
    assert [c["value"] for c in made.claims("q", [{"evidence_id": "c1", "content": "The Keep was founded in 235 AS."}])] == ["235 AS"]


def test_figures_by_name(spark):
    rows = spark.createDataFrame([("f1", "Garrison plate: Crook Keep", "a.png", "garrison strength 40"), ("f2", "Portrait: Crook Keep", "b.png", ""), ("f3", "Crookback", "c.png", "x")], "figure_id string, caption string, asset_path string, ocr_text string")
    found = figures.lookup(rows, spark.createDataFrame([("crook keep",)], "name string")).collect()
    assert [(r.figure_id, r.readable) for r in found] == [("f1", True), ("f2", False)]


def test_service_and_evaluation(spark, tmp_path):
    (tmp_path / "c/wiki").mkdir(parents=True)
    (tmp_path / "c/wiki/crook_keep.md").write_text("# Crook Keep\n\n| Field | Value |\n|---|---|\n| Garrison | 40 |\n")
    archive = Archive(spark, str(tmp_path / "s"))
    assert Service(archive).health()["status"] == "empty"
    archive.ingest(str(tmp_path / "c"))
    made = Service(archive)
    answer = made.question("What is the garrison of Crook Keep?")
    assert answer["headline"] == "40"
    cited = answer["claims"][0]["evidence"][0]
    assert made.document(cited["document_id"])["title"] == "Crook Keep"
    assert made.chunk(cited["chunk_id"]) and made.chunks(cited["document_id"]) and made.figure("none") is None
    assert made.indexes()["facts"] == 1 and made.conflicts().count() == 0
    (tmp_path / "q.json").write_text(json.dumps([{"q": "What is the garrison of Crook Keep?", "expect": "40", "category": "fact"}, {"q": "Who was Nobody?", "expect_none": True, "category": "refusal"}]))
    total = made.evaluate(str(tmp_path / "q.json")).filter("level = 3").first()
    assert (total.n, total.passed) == (2, 2)
    with pytest.raises(ValueError):
        made.question("x")
