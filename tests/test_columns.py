import pytest
from pyspark.sql import functions as F

from foliant.functions import columns as C


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "key"),
    [("The Gloaming Reach", "gloaming reach"), ("3,107", "3107"), ("5805 souls under arms", "5805"), ("5805 troops", "5805"), ("235 AS", "235 as"), ("", "")],
)
def test_value_key(spark, raw, key):
    assert one(spark, C.value_key(F.col("v")), v=raw) == key


@pytest.mark.parametrize(("raw", "number"), [("354 AS", 354.0), ("3,107", 3107.0), ("Crookgate Keep, 3rd hall", None), ("-4.5", -4.5), ("", None)])
def test_numeric_value(spark, raw, number):
    assert one(spark, C.numeric_value(F.col("v")), v=raw) == number


@pytest.mark.parametrize(("label", "attribute"), [("Forged", "forging_date"), ("**Garrison**", "garrison_strength"), ("Columns: A", None), ("225 AS", "timeline_event"), ("Name", None), ("Odd Label!", "odd_label"), ("known members", "has_member")])
def test_attribute(spark, label, attribute):
    assert one(spark, C.attribute(F.trim(F.regexp_replace("v", r"\*", ""))), v=label) == attribute


@pytest.mark.parametrize(("name", "found"), [("Greyfell Keep (location)", "greyfell_keep"), ("The O'Dell—House", "the_o_dell_house"), ("  ", "")])
def test_entity_id(spark, name, found):
    assert one(spark, C.entity_id(F.col("v")), v=name) == found


def test_dated_places(spark):
    rows = one(spark, C.dated_places(F.col("v")), v="Devastated Greyfell Citadel in 337 AS; Palewell Abbey in 338 AS; nowhere")
    assert [(r.place, r.year) for r in rows] == [("Greyfell Citadel", 337), ("Palewell Abbey", 338)]


@pytest.mark.parametrize(
    ("path", "kind"),
    [("wiki/a.md", "wiki"), ("codex/b.pdf", "codex"), ("chronicles/c.txt", "chronicle"), ("ephemera/ballad_concerning_x.txt", "ballad"), ("wiki/images/d.png", "figure_plate"), ("ephemera/other.txt", "unknown"), ("misc/e.md", "unknown")],
)
def test_source_class(spark, path, kind):
    assert one(spark, C.source_class(F.col("v")), v=path) == kind


def test_confidence_caps_and_penalties(spark):
    score = lambda **v: one(spark, F.round(C.confidence(F.col("b"), F.col("d"), F.col("h"), F.col("c") == 1), 6), **v)
    assert score(b=1.0, d=1, h=0, c=0) == 0.92
    assert score(b=1.0, d=9, h=0, c=0) == 0.99
    assert score(b=1.0, d=1, h=0, c=1) == 0.55
    assert score(b=0.25, d=1, h=5, c=0) == 0.05


def test_equal_years_do_not_rule_presence_out(spark):
    from foliant.operators import temporal

    subjects = spark.createDataFrame([("a", 320), ("b", 354)], "key string, year int")
    events = spark.createDataFrame([("a", "x", 320), ("b", "x", 227), ("b", "y", 400)], "key string, event string, event_year int")
    found = {r.key: r for r in temporal.verdicts(temporal.anachronisms(subjects, events)).collect()}
    assert not found["a"].any_impossible
    assert found["b"].mixed


def test_names_of_any_length_are_matched_without_overlap(spark):
    import random
    import re

    from foliant.operators import evidence

    rng = random.Random(3)
    vocabulary = ["the", "the", "the", "lost", "keep", "of", "northern", "grey", "lance"]
    name = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    names = [name(rng.choice((1, 2, 3, 7, 9))) for _ in range(40)] + ["The Keep, of the lost northern grey lance of old", ""]
    texts = [" ".join(rng.choice([*vocabulary, rng.choice(names)]) for _ in range(12)) for _ in range(30)] + ["The keep of the lost northern grey lance, of old!", "", None]

    def brute(text):
        words = re.findall(r"\w+", (text or "").lower())
        hits = []
        for n in {tuple(re.findall(r"\w+", x.lower())) for x in names} - {()}:
            hits += [(-len(n), i + 1, " ".join(n)) for i in range(len(words)) if tuple(words[i : i + len(n)]) == n]
        kept = []
        for less, at, found in sorted(hits):
            if all(at - less <= b or b - m <= at for m, b, _ in kept):
                kept.append((less, at, found))
        return {(found, at) for _, at, found in kept}

    asked = spark.createDataFrame(list(enumerate(texts)), "question_id bigint, question string")
    got = {}
    for r in evidence.entity_matches(asked, spark.createDataFrame([(n,) for n in names], "name string")).collect():
        got.setdefault(r.question_id, set()).add((r.name, r.at))
    assert got == {k: b for k, t in enumerate(texts) if (b := brute(t))}
