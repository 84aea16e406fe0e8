"""Operations a question may ask for: the meanings that tell them, what they need and what must run before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans import language


@dataclass(frozen=True)
class Need:
    """Findings of one kind; ``most`` is None where there may be any number."""

    kind: str
    least: int = 1
    most: int | None = 1


@dataclass(frozen=True)
class Operation:
    name: str
    meanings: tuple[str, ...]
    needs: tuple[Need, ...]
    after: tuple[str, ...] = ()


_YEARS, _NUMBERS = Need("year", 2, 2), Need("number", 2, 2)
_ALL_NUMBERS, _RECORDS = Need("number", 1, None), Need("dated record", 1, None)
_VALUES = Need("sourced value", 2, None)

# The names of operations, and which must run before which.
OPERATIONS = (
    Operation("duration", ("duration",), (_YEARS,)),
    Operation("date_difference", ("apart",), (_YEARS,)),
    Operation("date_ordering", ("order",), (Need("year", 2, None),)),
    Operation("timeline", ("timeline", "past"), (_RECORDS,)),
    Operation("existence_check", ("possible",), (_YEARS,), ("date_ordering",)),
    Operation("percentage", ("percentage",), (_NUMBERS,)),
    Operation("ratio", ("ratio",), (_NUMBERS,)),
    Operation("difference", ("difference",), (_NUMBERS,)),
    Operation("total", ("total",), (_ALL_NUMBERS,)),
    Operation("average", ("average",), (_ALL_NUMBERS,)),
    Operation("sorting", ("ranking",), (_ALL_NUMBERS,)),
    Operation("numeric_comparison", ("comparison",), (_NUMBERS,)),
    Operation("conflict_detection", ("contested",), (_VALUES,)),
    Operation("reliability_ranking", ("trusted",), (_VALUES,), ("conflict_detection",)),
    Operation("source_comparison", ("accounts",), (_VALUES,)),
    Operation("cause_effect", ("cause",), (Need("event"), Need("passage", 1, None))),
    Operation("impact_analysis", ("impact",), (Need("event"), Need("passage", 1, None))),
    Operation("history_trace", ("past",), (_RECORDS,)),
    Operation("location_event_link", ("at_place",), (_RECORDS,)),
    Operation("multi_hop", ("hop",), (Need("relation"), Need("value"))),
    Operation("entity_trace", ("holders",), (_RECORDS,)),
)


def detect(text: str) -> list[dict]:
    """The operations of a question, with the cue that told and what they need; what must run first comes first."""
    by = {o.name: o for o in OPERATIONS}
    found = {o.name: next((m[0] for meaning in o.meanings if (m := language.said(meaning, text))), None) for o in OPERATIONS}
    names: list[str] = []
    for o in OPERATIONS:
        if found[o.name]:
            names += [x for x in (*o.after, o.name) if x not in names]
    return [{"operation": n, "cue": found[n], "needs": [{"kind": x.kind, "least": x.least, "most": x.most} for x in by[n].needs]} for n in names]


def told(questions: DataFrame, text: str = "question") -> DataFrame:
    """question_id, operation: what each question of a table asks for itself, without what must run before."""
    shows = {o.name: [language.shown(meaning, F.col(text)) for meaning in o.meanings] for o in OPERATIONS}
    found = F.array(*[F.when(F.greatest(*either) if len(either) > 1 else either[0], F.lit(name)) for name, either in shows.items()])
    return questions.select("question_id", F.explode(F.array_compact(found)).alias("operation"))
