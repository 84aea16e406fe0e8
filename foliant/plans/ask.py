"""Answering questions: a question becomes a list of steps, steps become lookups, findings become cited claims.

The control plane is small and runs on the driver: words to attributes and entities, an intent, steps
with what each needs.  An investigation yields its needs and goes on with what it is sent, so any number of questions run
side by side: ``rounds`` answers the needs of all of them with one join a kind.  The loop of a question stops by budget, by
standstill or when nothing is left to do, and says which.
"""

from __future__ import annotations

import re
import time
from dataclasses import asdict, dataclass, field

from foliant.functions import vocab
from foliant.operators import figures, retrieval
from foliant.plans import language as W
from foliant.plans.rounds import Investigation, Need, Rounds
from foliant.sources.adapters import NullModel, NullVision
from foliant.sources.archive import Archive, Settings
from foliant.sources.gateway import merged

#: Passages that a model is shown.
SHOWN = 10
#: Edge predicates that say what an attribute says.
PREDICATES_OF: dict[str, list[str]] = {}
for _label, _attribute in vocab.ATTRIBUTES.items():
    if _label in vocab.PREDICATES:
        PREDICATES_OF.setdefault(_attribute, []).append(vocab.PREDICATES[_label])


@dataclass
class Question:
    text: str
    intent: str = "open_question"
    entities: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    bridge: str | None = None
    calculation: str | None = None
    analysis: str | None = None
    operands: list[tuple[str, str]] = field(default_factory=list)
    expects_conflict: bool = False
    answer_type: str = "value"


def analyse(text: str, names: dict[str, str]) -> Question:
    """A typed question; ``names`` maps lower-case surface forms to entity ids."""
    q = Question(text, expects_conflict=W.said("settled", text) is not None)
    who = W.spans(text, [n for n in names if len(n) > 2 and n not in W.PHRASES])
    q.entities = list(dict.fromkeys(names[n] for _, _, n in who))
    masked = text
    for a, z, _ in who:
        masked = masked[:a] + "\0" * (z - a) + masked[z:]
    told = [(at, end, attribute) for at, end, phrase in W.spans(masked, W.PHRASES) for attribute in _meant(text, W.PHRASES[phrase])]
    q.attributes = list(dict.fromkeys(a for _, _, a in told))
    numeric = [(at, a) for at, _, a in told if a in vocab.NUMERIC_ATTRIBUTES]
    pairs = _bound(text, [x for x in told if x[2] in vocab.NUMERIC_ATTRIBUTES], [(a, names[n]) for a, _, n in who])
    q.calculation = next((kind for kind in ("percentage", "ratio", "difference", "total", "average") if W.said(kind, text)), None)
    bridge = W.bridge(masked.replace("\0", "x"))
    target = next((a for a in q.attributes if a != bridge), None)
    single = numeric[0][1] if len({a for _, a in numeric}) == 1 else None
    if q.calculation and len(pairs) > 1:
        q.intent, q.operands = "calculation", _ordered(text, q.calculation, pairs, numeric, [(a, names[n]) for a, _, n in who])
    elif W.said("ranking", text) and len(q.entities) <= 1 and single:
        q.intent, q.analysis = "analysis", f"superlative:{single}"
    elif W.said("duration", text) and q.entities:
        q.intent, q.analysis, q.operands = "analysis", "duration", [(q.entities[0], "began"), (q.entities[0], "ended")]
    elif W.said("order", text) and len(q.entities) > 1:
        when = next((a for a in q.attributes if a in W.TIME_ATTRIBUTES), "began")
        q.intent, q.analysis, q.operands = "analysis", "ordering", [(e, when) for e in q.entities]
    elif W.said("comparison", text) and len(q.entities) > 1 and single:
        q.intent, q.analysis, q.operands = "analysis", "comparison", [(e, single) for e in q.entities]
    elif W.said("objection", text) and W.said("presence", text) and len(q.entities) > 1:
        q.intent = "temporal_check"
    elif bridge and target and q.entities:
        q.intent, q.bridge, q.attributes = "relation_hop", bridge, [target]
    elif len(q.entities) * len(q.attributes) > 1 and q.entities and q.attributes:
        q.intent = "multi_fact"
        one = len(q.attributes) == 1 or len(q.entities) != len(q.attributes)
        q.operands = [(e, a) for a in q.attributes for e in q.entities] if one else list(zip(q.entities, q.attributes, strict=True))
    elif q.expects_conflict and q.attributes and q.entities:
        q.intent = "conflict_resolution"
    elif q.attributes and q.entities:
        q.intent = "attribute_lookup"
    elif q.attributes:
        q.intent = "inverse_hop"
    q.answer_type = _answer_type(text, (q.attributes or [None])[0])
    return q


def _answer_type(text: str, attribute: str | None) -> str:
    first = text.lower().split()[:2]
    if first in (["how", "many"], ["how", "much"]) or attribute in vocab.NUMERIC_ATTRIBUTES:
        return "number"
    if attribute in W.YEAR_ATTRIBUTES:
        return "year"
    return "entity" if first[:1] and first[0] in ("which", "who", "whose") else "value"


def _meant(text: str, attribute: str) -> list[str]:
    """The attribute that a phrase names or its sibling: by whether the question asks where, when, or both."""
    pair = {attribute, W.SIBLINGS.get(attribute)}
    place, time_ = next((a for a in W.PLACE_ATTRIBUTES if a in pair), None), next((a for a in W.TIME_ATTRIBUTES if a in pair), None)
    if None in pair or not place or not time_:
        return [attribute]
    asked = [a for a, meaning in ((place, "where"), (time_, "when")) if W.said(meaning, text)]
    return asked or [attribute]


def _bound(text: str, numeric: list[tuple[int, int, str]], who: list[tuple[int, str]]) -> list[tuple[str, str]]:
    """Each numeric attribute (start, end, name) with the entity that "of" ties to it, else the one before it, else after it;
    a lone attribute goes with every entity."""
    if len({a for _, _, a in numeric}) == 1 and len(who) > 1:
        return list(dict.fromkeys((e, numeric[0][2]) for _, e in who))
    out = []
    for start, end, attribute in numeric:
        before, after = [e for p, e in who if p < start], [(p, e) for p, e in who if p >= end]
        tied = bool(after) and re.fullmatch(r"\s+(?:of|at|for|in|held by)\s+(?:the\s+)?", text[end : after[0][0]], re.I)
        if tied or (after and not before):
            out.append((after[0][1], attribute))
        elif before:
            out.append((before[-1], attribute))
    return list(dict.fromkeys(out))


def _ordered(text: str, kind: str, pairs, numeric, who) -> list[tuple[str, str]]:
    """Operands of a quotient with the denominator last: what is named first after "percentage of" or "ratio of"."""
    base = W.said("base", text) if kind in ("percentage", "ratio") and len(pairs) == 2 else None
    if base is None:
        return pairs
    alike = pairs[0][1] == pairs[1][1]
    after = next((name for at, name in (who if alike else numeric) if at >= base.end()), None)
    under = next((k for k, pair in enumerate(pairs) if pair[0 if alike else 1] == after), None)
    return pairs if under is None else [pairs[1 - under], pairs[under]]


@dataclass
class Step:
    key: str
    action: str
    subject: str | None = None
    attribute: str | None = None
    done: bool = False
    tried: bool = False
    value: str | None = None
    how: str = "facts"
    rows: list[dict] = field(default_factory=list)


def plan(q: Question) -> list[Step]:
    operands = [Step(f"operand:{i}", "operand", e, a) for i, (e, a) in enumerate(q.operands)]
    first, attribute = (q.entities or [None])[0], (q.attributes or [None])[0]
    by_intent = {
        "calculation": [*operands, Step("compute", "compute")],
        "analysis": [Step("aggregate", "aggregate", attribute=(q.analysis or "").partition(":")[2]), Step("analyse", "analyse")] if (q.analysis or "").startswith("superlative") else [*operands, Step("analyse", "analyse")],
        "temporal_check": [Step("origin", "origin", first), Step("events", "events", (q.entities + [None, None])[1]), Step("relation", "relation", first), Step("temporal", "temporal")],
        "multi_fact": [*operands, Step("assemble", "assemble")],
        "relation_hop": [Step("bridge", "lookup", first, q.bridge), Step("target", "hop", attribute=attribute)],
        "conflict_resolution": [Step("target", "lookup", first, attribute), Step("resolve", "resolve", first, attribute)],
        "attribute_lookup": [Step("target", "lookup", first, attribute), *([Step("resolve", "resolve", first, attribute)] if q.expects_conflict else [])],
        "inverse_hop": [Step("inverse", "search")],
        "open_question": [Step("evidence", "scan", first)],
    }
    return by_intent[q.intent]


@dataclass
class Answer:
    question: Question
    steps: list[Step]
    stop: str = ""
    status: str = ""
    headline: str = ""
    claims: list[dict] = field(default_factory=list)
    conflicts: list[dict] = field(default_factory=list)
    visual_gaps: list[str] = field(default_factory=list)
    trace: list[str] = field(default_factory=list)
    prose: str | None = None
    #: Recorded values of operands that are no numbers.
    rejected: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


class Investigator:
    """Asks an archive.  Facts stay on the cluster; what a question needs of them comes by ``Rounds``."""

    def __init__(self, archive: Archive, settings: Settings = Settings(), model=None, vision=None):  # noqa: B008
        self.archive, self.settings, self.model, self.vision = archive, settings, model or NullModel(), vision or NullVision()
        self.retriever = retrieval.of(archive, settings.weights)
        self.rounds = Rounds(archive, self.retriever)

    def names_in(self, text: str) -> dict[str, str]:
        """Names of entities and subjects that a text may hold: those whose every word it has.  One set on an investigator, or
        overridden, is asked in place of the archive's dictionary."""
        return self.rounds.drive([_Run(self, text).recorded(text)])[0]

    @property
    def own_names(self) -> bool:
        return "names_in" in vars(self) or type(self).names_in is not Investigator.names_in

    def ask(self, text: str) -> Answer:
        return self.ask_many([text])[0]

    def ask_many(self, texts: list[str]) -> list[Answer]:
        """Answers, in order.  The number of jobs does not grow with that of the questions, up to ``rounds.BLOCK`` of them."""
        return self.rounds.drive([_Run(self, text).answer() for text in texts])


class _Run:
    """One question's investigation; its methods yield needs."""

    def __init__(self, of: Investigator, text: str):
        self.of, self.text, self.settings, self.model, self.vision = of, text, of.settings, of.model, of.vision
        self.queries, self.known = 0, {}
        self.out: Answer

    def _need(self, kind: str, *args) -> Investigation:
        self.queries += 1
        found = yield Need(kind, args)
        return [dict(r) for r in found] if found and isinstance(found, list) and isinstance(found[0], dict) else found

    def _all(self, needs: list[Need]) -> Investigation:
        """Several needs at once, which count as one query."""
        self.queries += bool(needs)
        return (yield needs) if needs else []

    def names(self, text: str) -> Investigation:
        found = self.of.names_in(text) if self.of.own_names else (yield from self.recorded(text))
        self.known |= {e: n for n, e in found.items()}
        return found

    def recorded(self, text: str) -> Investigation:
        said = re.findall(r"\w+", text.lower())
        words = tuple(sorted({*said, *(w[:-1] for w in said if w.endswith("s"))}))
        return dict((yield Need("names", (words,)))) if words else {}

    def _name(self, subject: str | None) -> str:
        return self.known.get(subject or "", (subject or "").replace("_", " "))

    def _best(self, subject: str | None, attribute: str | None) -> Investigation:
        """Facts of the value to believe, and the competing values (value_text, reliability, sources), of facts about one thing."""
        rows = yield from self._need("ranked", subject or "", attribute or "")
        first = {}
        for r in rows:
            first.setdefault(r["rank"], r)
        positions = [{"subject": r["subject_id"], "attribute": r["attribute"], "value": r["shown"], "reliability": r["best"], "sources": r["sources"], "gap": r["gap"]} for r in first.values()]
        return [r for r in rows if r["rank"] == 1], positions

    def _lookup(self, step: Step) -> Investigation:
        """The recorded value; else the same relation from its other end, the graph, a plate, a sentence, a passage that a model reads."""
        out, subject, attribute, operand = self.out, step.subject or "", step.attribute or "", step.action == "operand"
        best, values = yield from self._best(subject, attribute)
        if len(values) > 1:
            out.conflicts.append({"subject": subject, "attribute": attribute, "positions": values, "gap": values[0]["gap"]})
        stated = [r for r in best if not any(x in r["value_text"].lower() for x in vocab.NOT_RECORDED)]
        if stated and operand and out.question.intent in ("calculation", "analysis") and attribute in vocab.NUMERIC_ATTRIBUTES:
            # the value to believe is ranked first and tested then: a weaker source's number does not stand in for it
            step.rows, step.value = stated, stated[0]["value_text"]
            if (yield from self._number(step)) is None:
                out.rejected.append(f'{self._name(subject)} {attribute.replace("_", " ")} is recorded as "{step.value}", which is no number')
                step.rows, step.value = [], None
                return
        if stated or (best and not operand and not figures.routed(attribute)):
            step.rows, step.done, step.value = stated or best, True, (stated or best)[0]["value_text"]
            step.value = self._narrowed(step.value) if step.key == "target" else step.value
            return
        ways = [self._plate, self._sentence] if operand or best else [self._other_end, self._neighbour, self._plate, self._sentence, self._read]
        for way in ways:
            if (yield from way(step)):
                step.done = True
                return
        if best and not operand:
            step.rows, step.done, step.value = best, True, best[0]["value_text"]

    def _narrowed(self, value: str) -> str:
        """Of several named things the one of the kind that the question speaks of."""
        parts = [p.strip() for p in value.split(";") if p.strip()]
        wanted = [w for w in W.EVENT_WORDS if re.search(rf"\b{w}\b", self.text, re.I)]
        return next((p for p in parts for w in wanted if re.search(rf"\b{w}\b", p, re.I)), value) if len(parts) > 1 else value

    def _other_end(self, step: Step) -> Investigation:
        """The inverse relation of the subject itself, then who names the subject under the attribute or its inverse."""
        inverse = vocab.INVERSE_ATTRIBUTES.get(step.attribute or "")
        if inverse:
            best, _ = yield from self._best(step.subject, inverse)
            if best:
                step.rows, step.value, step.how = best, self._narrowed(best[0]["value_text"]), "inverse"
                return True
        rows = yield from self._need("naming", step.subject or "", tuple(a for a in (step.attribute, inverse) if a))
        if not rows:
            return False
        value = self._narrowed("; ".join(dict.fromkeys(r["subject_name"] for r in rows)))
        chosen = next((r["subject_name"] for r in rows if r["subject_name"] == value), rows[0]["subject_name"])
        step.rows, step.value, step.how = [r | {"value_text": r["subject_name"]} for r in rows if r["subject_name"] == chosen], chosen, "reverse"
        return True

    def _neighbour(self, step: Step) -> Investigation:
        """What an edge of the attribute's predicate leads to."""
        rows = yield from self._need("neighbours", step.subject or "", (*PREDICATES_OF.get(step.attribute or "", []), step.attribute or ""))
        if rows:
            step.rows, step.how = [r | {"value_text": r["name"] or r["other"], "subject_id": step.subject} for r in rows], "graph"
            step.value = ", ".join(dict.fromkeys(r["value_text"] for r in step.rows))
        return bool(rows)

    def _plate(self, step: Step) -> Investigation:
        """What a plate prints, or a vision model sees on it, for attributes that plates carry; else the plate is named as a gap."""
        if not figures.routed(step.attribute or ""):
            return False
        hits = yield from self._need("plates", self._name(step.subject))
        for hit in hits[:1]:
            source = {"chunk_id": hit["chunk_id"], "document_id": hit["document_id"], "page": hit["page"], "source_class": hit["source_class"] or "figure_plate", "reliability": vocab.RELIABILITY["figure_plate"], "subject_id": step.subject}
            if hit["readable"]:
                step.value, step.how = f"see figure: {' '.join(hit['ocr_text'].split())[:80]}", "figure"
            elif self.vision.available:
                seen, status = self.vision.describe(hit["asset_path"], self.text)
                if seen:
                    step.value, step.how = seen, "vision"
                    self.out.visual_gaps.append(f"{hit['caption']} was read by a vision model, not stated in text")
                else:
                    self.out.visual_gaps.append(f"{hit['caption']}: {status}")
            if step.value:
                step.rows = [source | {"value_text": step.value}]
                return True
            self.out.visual_gaps.append(f"{hit['caption']} ({(hit['asset_path'] or '').rsplit('/', 1)[-1]}) may show it, but no label could be read from it")
        return False

    def _sentence(self, step: Step) -> Investigation:
        rows = yield from self._prose(step.subject or "", step.attribute or "")
        if rows:
            step.rows, step.value, step.how = rows, rows[0]["value_text"], "prose"
        return bool(rows)

    def _prose(self, subject: str, attribute: str) -> Investigation:
        if attribute not in vocab.PROSE:
            return []
        name = self._name(subject)
        rows = yield from self._need("sentences", name, attribute)
        return [r | {"subject_id": subject, "subject_name": name, "value_text": r["value"], "value_number": None} for r in rows]

    def _read(self, step: Step) -> Investigation:
        """Passages are context and no answer; a model's claims from them count if their passage holds them."""
        hits = yield from self._passages(f"{self._name(step.subject)} {(step.attribute or '').replace('_', ' ')}", [self._name(step.subject)])
        step.rows = []
        if not hits or not self.model.available:
            return False
        told = self.model.claims(self.text, [{"evidence_id": h["chunk_id"], "content": h["content"]} for h in hits[:SHOWN]])
        by = {h["chunk_id"]: h for h in hits}
        kept = [c for c in told if c.get("evidence_id") in by]
        if kept:
            step.rows = [by[c["evidence_id"]] | {"value_text": str(c["value"]), "subject_id": step.subject} for c in kept]
            step.value, step.how = str(kept[0]["value"]), "model"
        return bool(kept)

    def _passages(self, text: str, names: list[str]) -> Investigation:
        asked = (text, *(self.model.queries(text, []) if self.model.available else []))
        rows = yield from self._need("passages", asked, tuple(names))
        return [r | {"value_text": r["content"][: vocab.EXCERPT]} for r in {r["chunk_id"]: r for r in reversed(rows)}.values()][::-1]

    def _search(self, step: Step) -> Investigation:
        step.rows = yield from self._passages(self.text, [self._name(e) for e in ([step.subject] if step.subject else [])])
        step.how, step.done = "text", bool(step.rows)

    def _scan(self, step: Step) -> Investigation:
        """What is recorded about a subject; else passages about it."""
        recorded = yield from self._need("attributes", step.subject or "")
        yield from self._search(step)
        if recorded:
            step.done, step.value = True, f"recorded of {self._name(step.subject)}: {', '.join(recorded[:8])}"

    def answer(self) -> Investigation:
        text = self.text
        q = analyse(text, (yield from self.names(text)))
        if self.model.available and q.intent == "open_question":
            yield from self._advised(q)
        if q.intent == "relation_hop":
            yield from self._oriented(q)
        out = self.out = Answer(q, plan(q))
        began, stale, rounds, self.queries = time.monotonic(), 0, 0, 0
        if not q.entities and q.intent not in ("inverse_hop", "analysis"):
            yield from self._search(out.steps[0])
            out.stop = "no_entity"
        while not out.stop:
            step = next((s for s in out.steps if not s.done and not s.tried), None)
            if step is not None and self._settled(step):
                continue
            if step is None:
                out.stop = "all_supported" if all(s.done for s in out.steps) else "insufficient_evidence"
            elif rounds >= self.settings.iterations:
                out.stop = "iteration_budget"
            elif self.queries >= self.settings.queries:
                out.stop = "query_budget"
            elif time.monotonic() - began > self.settings.seconds:
                out.stop = "time_budget"
            elif stale >= self.settings.stale_rounds and not step.key.startswith("operand"):
                out.stop = "insufficient_evidence"
            else:
                rounds += 1
                step.tried = True
                yield from self._act(step)
                out.trace.append(f"{step.key}: {step.action} {step.subject or ''} {step.attribute or ''} -> {step.value if step.done else 'nothing'}")
                stale = 0 if step.done else stale + 1
        yield from self._finish()
        return out

    def _oriented(self, q: Question) -> Investigation:
        """Which relation of a hop comes first: the one that the named subject records."""
        recorded = yield from self._need("attributes", q.entities[0])
        if q.bridge not in recorded and q.attributes[0] in recorded:
            q.bridge, q.attributes = q.attributes[0], [q.bridge]

    def _advised(self, q: Question) -> Investigation:
        """What a model understood of a question that the grammar did not: names that the archive knows, and attributes."""
        told = self.model.understand(self.text) or {}
        known = yield from self.names(" ".join(map(str, told.get("entities") or [])))
        said = {"entities": list(dict.fromkeys(known.values())), "attributes": [a for a in told.get("attributes") or [] if a in vocab.ATTRIBUTES.values()]}
        both = merged({"entities": q.entities, "attributes": q.attributes}, said)
        q.entities, q.attributes = both["entities"], both["attributes"]
        if q.entities and q.attributes:
            q.intent = "attribute_lookup"

    def _settled(self, step: Step) -> bool:
        """A conflict step without a conflict costs no query: the one value that was read stands."""
        out = self.out
        by = {s.key: s for s in out.steps}
        if step.action != "resolve" or "target" not in by or not by["target"].tried or out.conflicts:
            return False
        step.tried, step.done, step.rows, step.value = True, by["target"].done, by["target"].rows, by["target"].value
        out.trace.append(f"{step.key}: one value is recorded and stands" if step.done else f"{step.key}: no value to rank")
        return True

    def _gap(self, step: Step, operands: list[Step]) -> bool:
        """Names the operands that are missing, where a step needs them all."""
        missing = [s for s in operands if not s.done]
        if missing:
            self.out.trace.append(f"{step.key}: missing {', '.join(f'{s.subject} {s.attribute}' for s in missing)}")
        return bool(missing)

    def _act(self, step: Step) -> Investigation:
        q, by = self.out.question, {s.key: s for s in self.out.steps}
        operands = [s for s in self.out.steps if s.key.startswith("operand")]
        if step.action in ("compute", "assemble", "analyse") and operands and self._gap(step, operands) and step.action != "assemble":
            return
        if step.action in ("lookup", "operand"):
            yield from self._lookup(step)
        elif step.action == "scan":
            yield from self._scan(step)
        elif step.action == "hop":
            for target in (yield from self._need("hop_targets", by["bridge"].value)) if by["bridge"].rows else []:
                step.subject = target
                yield from self._lookup(step)
                if step.done:
                    return
        elif step.action == "resolve":
            step.done, step.rows = by["target"].done, by["target"].rows
            step.value = by["target"].value
        elif step.action == "aggregate":
            step.rows = yield from self._need("extremes", step.attribute, bool(W.said("lowest", self.text)))
            step.done = bool(step.rows)
        elif step.action == "origin":
            step.rows = yield from self._need("origins", step.subject or "")
            for attribute in ("forging_date", "founded"):
                if not step.rows:
                    told = yield from self._prose(step.subject or "", attribute)
                    step.rows = [r | {"year": int(re.search(r"\d+", r["value_text"])[0])} for r in told][:1]
            step.done, step.value = bool(step.rows), str(step.rows[0]["year"]) if step.rows else None
        elif step.action == "events":
            step.rows = (yield from self._need("dated", step.subject)) if step.subject else []
            step.done, step.value = bool(step.rows), ", ".join(str(r["year"]) for r in step.rows) or None
        elif step.action == "relation":
            yield from self._relation(step)
        elif step.action == "temporal" and by["origin"].done and by["events"].done:
            born = int(by["origin"].value or 0)
            step.rows = by["origin"].rows + by["events"].rows
            late = [r["year"] for r in by["events"].rows if born > r["year"]]
            step.done = True
            step.value = f"origin {born} AS is later than {', '.join(f'{y} AS' for y in late)}" if late else f"origin {born} AS does not rule out presence"
        elif step.action == "compute" and all(s.done for s in operands):
            numbers = []
            for s in operands:
                numbers.append((yield from self._number(s)))
            if None not in numbers:
                step.value, step.rows = (yield from self._computed(q.calculation or "", numbers)), [r for s in operands for r in s.rows[:1]]
                step.done = step.value is not None
        elif step.action == "assemble":
            step.done = all(s.done for s in operands)
            step.value = "; ".join(f"{s.subject} {s.attribute}: {s.value}" for s in operands if s.done)
        elif step.action == "analyse":
            yield from self._analyse(step, by, operands)
        elif step.action == "search":
            yield from self._search(step)

    def _relation(self, step: Step) -> Investigation:
        """What links a thing to the place of the events today: where it is kept now says nothing of where it was then."""
        entities = self.out.question.entities
        if len(entities) < 2:
            return
        place = self._name(entities[1])
        step.rows, step.done = (yield from self._need("relations", step.subject or "", place)), True
        kept = [r for r in step.rows if r["is_custody"]]
        told = "; ".join(f"{r['attribute'].replace('_', ' ')}: {r['value_text']}" for r in kept or step.rows)
        step.value = f"{told}, which is no evidence of then" if kept else told or f"no direct link to {place} is recorded"

    def _analyse(self, step: Step, by: dict[str, Step], operands: list[Step]) -> Investigation:
        kind = (self.out.question.analysis or "").partition(":")[0]
        if kind == "superlative" and by["aggregate"].done:
            step.rows, step.done = by["aggregate"].rows[:1], True
            step.value = f"{step.rows[0]['subject_name']} ({step.rows[0]['value_text']})"
        elif operands and all(s.done for s in operands):
            found = []
            for s in operands:
                found.append((s.subject, (yield from self._number(s)) if kind == "comparison" else (yield from self._need("years", s.value))))
            if any(n is None for _, n in found):
                return
            step.rows, step.done = [r for s in operands for r in s.rows[:1]], True
            if kind == "duration":
                step.value = f"{found[1][1] - found[0][1]} years"
            elif kind == "ordering":
                step.value = ", then ".join(f"{e} ({y} AS)" for e, y in sorted(found, key=lambda x: x[1]))
            else:
                (e, high), (_, low) = sorted(found, key=lambda x: -x[1])[:2]
                step.value = f"{e} by {high - low:g}"

    def _number(self, step: Step) -> Investigation:
        """The number of an operand's value: as stored, else as the value reads."""
        held = next((r["value_number"] for r in step.rows if r.get("value_number") is not None), None)
        return held if held is not None else (yield from self._need("numbers", step.value))

    def _computed(self, kind: str, n: list[float]) -> Investigation:
        """A result as text; null where it can't be told, as of a quotient by 0."""
        if kind in ("total", "average") and len(n) > 2:
            n = [sum(n), 0.0] if kind == "total" else [2 * sum(n) / len(n), 0.0]
        return (yield from self._need("results", kind, float(n[0]), float(n[1])))

    def _finish(self) -> Investigation:
        """Claims with confidence and excerpts, the status and the headline."""
        out = self.out
        derived = ("compute", "temporal", "analyse", "hop")
        supported = [s for s in out.steps if s.done and s.rows and s.action not in ("assemble", "search", "scan")]
        contested = {(c["subject"], c["attribute"]) for c in out.conflicts}
        rows = []
        for s in supported:
            hops, split = int(s.action in derived or s.how in ("graph", "model", "vision")), (s.subject, s.attribute) in contested
            rows.append((float(max(r["reliability"] for r in s.rows)), len({r["document_id"] for r in s.rows}), hops, split))
        cites = [[Need("excerpts", (r["chunk_id"] or "", r["value_text"], self._name(r.get("subject_id")))) for r in s.rows] for s in supported]
        told = yield from self._all([*(Need("confidences", r) for r in rows), *(n for own in cites for n in own)])
        scores, shown = told[: len(rows)], iter(told[len(rows) :])
        for s, (best, documents, hops, split), (score, label) in zip(supported, rows, scores, strict=True):
            kind = "inferred" if hops else "conflicting" if split else "direct"
            cited = [{"document_id": r["document_id"], "chunk_id": r["chunk_id"], "page": r.get("page"), "source_class": r["source_class"], "reliability": r["reliability"], "excerpt": next(shown)} for r in s.rows]
            reasons = [f"best source has reliability {best:g}", f"{documents} document{'s' * (documents != 1)}", *["derived, not stated"] * hops, *["sources disagree"] * split]
            out.claims.append({"step": s.key, "text": f"{s.subject or ''} {s.attribute or s.action}: {s.value}".strip(), "kind": kind, "how": s.how, "confidence": score, "label": label, "reasons": reasons, "evidence": cited})
        unmet = sum(not s.done for s in out.steps)
        read = sum(s.action in ("search", "scan") and s.done for s in out.steps)
        unresolved = sum((c["gap"] or 0) < vocab.DECISIVE_GAP for c in out.conflicts)
        bare = sum(not c["evidence"] for c in out.claims)
        out.status = yield from self._need("statuses", out.stop, len(out.claims) + read, unmet, len(out.visual_gaps) if unmet else 0, 0, unresolved, bare)
        last = next((s for s in reversed(out.steps) if s.done and s.value and s.action != "relation"), None)
        missing = [f"{s.subject or ''} {s.attribute or s.key}".strip() for s in out.steps if not s.done and s.action in ("operand", "lookup", "origin", "events")]
        out.headline = last.value if last and not (missing and out.question.intent == "calculation") else "; ".join(out.rejected) or "No recorded value" + (f" for {', '.join(missing)}" if missing else "")
        if last is None and out.visual_gaps:
            out.headline += f". {out.visual_gaps[-1]}"
        passages = [r for s in out.steps if s.how == "text" for r in s.rows][:SHOWN]
        if self.model.available and out.question.intent == "open_question" and passages and out.status != "no_entity":
            out.prose = self.model.answer(out.question.text, [{"evidence_id": r["chunk_id"], "content": r["content"]} for r in passages])


__all__ = ["Answer", "Investigator", "Question", "Step", "analyse", "plan", "spans"]
