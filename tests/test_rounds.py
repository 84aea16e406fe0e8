"""Questions in a batch: the answers of single questions, in a number of jobs that does not grow with them."""

import pytest
from foliant.plans import ask
from foliant.sources.archive import Archive
from test_archive import FILES

QUESTIONS = [
    "Who rules the lair of the Morrow Wyrm?", "In which year was Greyfell Keep truly founded?", "Why would it be incorrect to say the Dusk Aegis was present when Greyfell Keep fell?",
    "What percentage of the garrison of Greyfell Keep is the attunement cost of Morrow Wyrm?", "Tell me of Nobody", "What is the threat rating of the Morrow Wyrm?", "Which war began first, the Ash War or the Night War?", "Where is the Dusk Aegis housed?",
]
MORE = {
    "wiki/reed_hold.md": "# Reed Hold (location)\n\n## Infobox\n\n| Field | Value |\n|---|---|\n| Garrison | 55 |\n",
    "codex/reed_hold_record.md": "# Reed Hold\n\n| Field | Value |\n|---|---|\n| Garrison | many troops |\n",
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name, text in (FILES | MORE).items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    made = Archive(spark, str(tmp_path_factory.mktemp("store") / "a"))
    made.ingest(str(root))
    return ask.Investigator(made)


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def plain(answer):
    return answer.headline, answer.status, answer.stop, [(c["text"], c["confidence"], len(c["evidence"])) for c in answer.claims], answer.trace


def test_a_batch_answers_as_single_questions_do(spark, found):
    several = found.ask_many(QUESTIONS)
    for text, answer in list(zip(QUESTIONS, several, strict=True))[:3]:
        assert plain(found.ask(text)) == plain(answer)
    _, few = jobs(spark, "few", lambda: found.ask_many(QUESTIONS))
    many, more = jobs(spark, "many", lambda: found.ask_many(QUESTIONS * 25))
    assert [plain(a) for a in many] == [plain(a) for a in several] * 25
    assert more <= few * 1.3 + 5


def test_a_best_value_that_is_no_number_is_named_and_not_replaced(found):
    answer = found.ask("What percentage of the garrison of Greyfell Keep is the garrison of Reed Hold?")
    assert "many troops" in answer.headline and "no number" in answer.headline and answer.status != "completed"


def test_where_a_thing_is_kept_now_is_told_apart_from_then(found):
    answer = found.ask(QUESTIONS[2])
    step = next(s for s in answer.steps if s.action == "relation")
    assert step.done and step.rows[0]["is_custody"] and "housed in" in step.value and "no evidence of then" in step.value
    assert "is later than" in answer.headline and any(c["step"] == "relation" and c["evidence"] for c in answer.claims)
