"""Questions by their form: meanings, operations, intents and the relations that they go through."""

from __future__ import annotations

import pytest

from foliant.plans import ask, language

NAMES = {
    "gravemaw wyrm": "wyrm", "ederon fellgard": "ederon", "winter reckoning": "winter", "leaden accord": "leaden", "endless vigil": "vigil", "hollowreach": "hollow", "greyfell citadel": "greyfell",
    "crookgate keep": "crook", "bound lantern": "lantern", "emberdeep": "ember", "weeping lurker": "lurker", "thorn wraith": "wraith", "cindermere hold": "cinder", "iron cartel": "cartel",
}


@pytest.mark.parametrize(
    ("text", "intent", "told"),
    [
        ("What is the recorded garrison strength of Crookgate Keep?", "attribute_lookup", ["garrison_strength"]),
        ("How many souls stand under arms at Hollowreach?", "attribute_lookup", ["garrison_strength"]),
        ("Where does the Thorn Wraith make its home?", "attribute_lookup", ["lair"]),
        ("In which year was the Bound Lantern forged?", "attribute_lookup", ["forging_date"]),
        ("Where was the Bound Lantern forged?", "attribute_lookup", ["forging_site"]),
        ("What is the seat of the Iron Cartel?", "attribute_lookup", ["seat"]),
        ("In which year was Emberdeep truly founded?", "conflict_resolution", ["founded"]),
        ("Which creature lairs in Emberdeep?", "attribute_lookup", ["lair"]),
        ("What are the threat ratings of the Weeping Lurker and the Thorn Wraith?", "multi_fact", ["threat_rating"]),
        ("Where and in which year was the Bound Lantern forged?", "multi_fact", ["forging_site", "forging_date"]),
    ],
)
def test_lookups(text, intent, told):
    q = ask.analyse(text, NAMES)
    assert (q.intent, q.attributes) == (intent, told)


@pytest.mark.parametrize(
    ("text", "relation", "target"),
    [
        ("Whose dominion encompasses the lair of the Gravemaw Wyrm?", "lair", "ruled_by"),
        ("Who rules the place where the Gravemaw Wyrm lairs?", "lair", "ruled_by"),
        ("Who rules the Gravemaw Wyrm's lair?", "lair", "ruled_by"),
        ("Who rules the place where the Bound Lantern is housed?", "housed_in", "ruled_by"),
        ("Who rules the fortress in which the Bound Lantern is displayed?", "housed_in", "ruled_by"),
        ("Who rules the city where the Bound Lantern was forged?", "forging_site", "ruled_by"),
        ("Which region contains the place where the Gravemaw Wyrm lairs?", "lair", "region"),
        ("Which faction is Ederon Fellgard a member of, and where is it seated?", "member_of", "seat"),
        ("Which accord was won by the faction of Ederon Fellgard?", "member_of", "victor"),
        ("What is the seat of the faction that rules Emberdeep?", "ruled_by", "seat"),
    ],
)
def test_relations(text, relation, target):
    q = ask.analyse(text, NAMES)
    assert (q.intent, q.bridge, q.attributes) == ("relation_hop", relation, [target])


@pytest.mark.parametrize(
    ("text", "intent", "detail"),
    [
        ("How long did the Winter Reckoning last?", "analysis", "duration"),
        ("Which began first, the Leaden Accord or the Winter Reckoning?", "analysis", "ordering"),
        ("Was the Leaden Accord older than the Winter Reckoning, or which is the older?", "analysis", "ordering"),
        ("Which conflict recorded the most casualties?", "analysis", "superlative:recorded_casualties"),
        ("Which conflict recorded the fewest casualties?", "analysis", "superlative:recorded_casualties"),
        ("Which has the larger garrison strength, Hollowreach or Greyfell Citadel?", "analysis", "comparison"),
        ("What percentage of the Endless Vigil's casualties were the Winter Reckoning's casualties?", "calculation", "percentage"),
        ("What is the difference between the casualties of the Endless Vigil and the Winter Reckoning?", "calculation", "difference"),
        ("How many more casualties had the Endless Vigil than the casualties of the Winter Reckoning?", "calculation", "difference"),
        ("What is the combined garrison strength of Crookgate Keep and Hollowreach?", "calculation", "total"),
        ("What is the average garrison strength of Crookgate Keep and Hollowreach?", "calculation", "average"),
        ("Why would it be wrong to conclude that the Bound Lantern was present at Cindermere Hold when it was devastated in 271 AS?", "temporal_check", None),
    ],
)
def test_analyses(text, intent, detail):
    q = ask.analyse(text, NAMES)
    assert (q.intent, q.calculation if intent == "calculation" else q.analysis) == (intent, detail)


@pytest.mark.parametrize("text", ["How many siblings does Ederon Fellgard have?", "What is the Gravemaw Wyrm's favourite food?", "How many airships does the Iron Cartel operate?"])
def test_what_names_no_attribute_is_open(text):
    assert ask.analyse(text, NAMES).intent == "open_question"


@pytest.mark.parametrize(("adjective", "forms"), [("big", ("bigger", "biggest")), ("early", ("earlier", "earliest")), ("large", ("larger", "largest")), ("few", ("fewer", "fewest")), ("weak", ("weaker", "weakest")), ("new", ("newer", "newest"))])
def test_compared_forms(adjective, forms):
    assert language.compared(adjective) == forms


def test_lowest_follows_direction():
    assert language.said("lowest", "the fewest casualties") and not language.said("lowest", "the most casualties")


def test_meanings_over_a_column_are_those_of_single_questions(spark):
    texts = ["How long did it last?", "how long after the war was it forged?", "Which is older?", "why can't it be?", "Could it have been there?", "HOW MUCH later?", "Who wielded it?", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    found = rows.select("i", *[language.shown(m, rows["q"]).alias(m) for m in language.MEANINGS]).orderBy("i").collect()
    for row, text in zip(found, texts, strict=True):
        assert {m for m in language.MEANINGS if row[m]} == {m for m in language.MEANINGS if text is not None and language.said(m, text)}
