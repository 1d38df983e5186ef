"""Providers without a model: deterministic rules, and replay of recorded answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from typing import Any

from kgloom.providers.base import ProviderError, Request, Response, Usage

_QUANTITY = re.compile(r"(?P<name>[A-Za-z][A-Za-z ]{1,40}?)\s*(?:is|of|:|=)\s*(?P<value>-?\d+(?:[.,]\d+)?)\s*(?P<unit>[A-Za-z°%/²^-]{1,12})?")
_NAME = re.compile(r"\b(?:[A-Z][\w-]*\d[\w-]*|[A-Z][a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})+)\b")

_VALUE = re.compile(r"(?<![\w.-])(-?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?)(?:[eE][+-]?\d+)?)(?!(?:st|nd|rd|th)\b)(?:\s?-\s?(\d+(?:\.\d+)?)(?![-\d]))?")
_THING = re.compile(r"(?<!\w)[A-Z][\w-]*(?:\s+[A-Z][\w-]*)*(?:\s+\d+(?=\s+(?:has|have|had|is|are|was|were|weighs|with|whose)\b))?")
_CONFLICT = re.compile(
    r"(?P<subject>(?:\b(?:the|an?)\s+(?:[\w-]+\s+){0,3}?[\w-]+)|[A-Z][\w-]*(?:\s[A-Z][\w-]*)*)\s+(?P<verb>exceed(?:s|ed)|violate[sd]|contradict(?:s|ed)|conflict(?:s|ed) with|is incompatible with|fell below|falls below|fail(?:s|ed) to meet)"
    r"\s+(?P<object>(?:the|an?)\s+[\w-]+(?:\s+(?!of\b|in\b|for\b|by\b|at\b|with\b|during\b|while\b|and\b)[\w-]+)?|[A-Z][\w-]*(?:\s[A-Z][\w-]*)*)?",
    re.I,
)
_OPENERS = frozenset("The A An Its It This That These Those Each Every All Both In At On For Of With If When While However Its Total Maximum Minimum".split())
#: Words that may stand between two values of one attribute.
_LINKS = frozenset("a an the and or but while whereas that those one of for is are was were has have had to at with it its weighs weigh measures measure reaches reach shows show gives give each about approximately nearly only just up than more less over under between from respectively by in on as well also both".split())


def statements(text: str, attribute: str) -> list[dict[str, str | None]]:
    """thing, other, value, quote for every value that a sentence gives for the attribute.

    A sentence speaks of the attribute if it holds all its words. Its values are the number after each
    mention, the number right before one ("3 kg mass"), and those that follow a value with nothing but
    names, units and linking words between; both ends of a range; without any of these, every number.
    Digits of names are no values. ``thing`` is named right after the mention or last before the value;
    as many names as values in a row are paired in order. ``other`` is the first other name before.
    What kind of thing a name is, is not known here, so a rule's types do not filter the statements.
    """
    words = re.sub(r"(?<=[a-z])(?=[A-Z])|_", " ", attribute).lower().split()
    mention = re.compile("|".join([r"[\s_]*".join(map(re.escape, words)), *[rf"(?<![a-z]){re.escape(w)}(?:e?s)?(?![a-z])" for w in words if w.isalpha()]]), re.I) if words else re.compile(r"\A")
    out: list[dict[str, str | None]] = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text):
        lower = re.sub(r"(?<=[a-z])(?=[A-Z])|_", " ", sentence).lower()
        if not all(w in lower for w in words):
            continue
        plain = re.sub("[\u2212\u2013]", "-", sentence)
        mentions = [m.span() for m in mention.finditer(plain)]
        blank = mention.sub(lambda m: "\0" * len(m[0]), plain)
        names = []
        for m in _THING.finditer(blank):
            kept = re.sub(rf"^(?:(?:{'|'.join(_OPENERS)})(?:\s+|$))+", "", m[0])
            if kept and not re.search(r"(?<![\w-])-?\d[\d.,]*\s*$", blank[: m.start()]):  # else the unit of a number
                names.append((m.end() - len(kept), m.end(), sentence[m.end() - len(kept) : m.end()]))
        numbers = [m for m in _VALUE.finditer(blank) if not any(a <= m.start() < b for a, b, _ in names)]
        taken: list[int] = []
        for i, m in enumerate(numbers):
            since = numbers[i - 1].end() if i else 0
            after = any(since <= a < m.start() for a, _ in mentions)
            before = any(re.fullmatch(r"\s*(?:[^\W\d][\w/%\u00b0\u00b2^]*\s+)?", blank[m.end() : a]) for a, _ in mentions if a >= m.end())
            gap = blank[since : m.start()]
            for a, b, _ in names:
                if since <= a and b <= m.start():
                    gap = gap.replace(blank[a:b], " ")
            gap = re.sub(r"^\s*[^\W\d][\w/%\u00b0\u00b2^]*", " ", gap) if not re.match(rf"\s*(?:{'|'.join(_LINKS)})\b", gap) else gap
            carried = bool(taken) and taken[-1] == i - 1 and all(w.lower() in _LINKS for w in re.findall(r"[^\W\d_]+", gap))
            if after or before or carried:
                taken.append(i)
        taken = taken or list(range(len(numbers)))
        at = 0
        while at < len(taken):
            # A run: values without a name or mention between them.
            end = at + 1
            marks = [a for a, *_ in names] + [a for a, _ in mentions]
            while end < len(taken) and not any(numbers[taken[end - 1]].end() <= a < numbers[taken[end]].start() for a in marks):
                end += 1
            run, first = [numbers[i] for i in taken[at:end]], numbers[taken[at]].start()
            since = numbers[taken[at - 1]].end() if at else 0
            new = [n for n in names if since <= n[0] < first]
            known = [n for n in names if n[0] < first]
            own = [n for n in known for _, b in mentions if n[0] >= max(b, since) and re.fullmatch(r"\s+(?:of|for)\s+(?:the\s+|The\s+)?", blank[b : n[0]])]
            paired = len(run) > 1 and len(new) == len(run)
            for k, m in enumerate(run):
                thing = new[k][2] if paired else own[-1][2] if own else known[-1][2] if known else names[0][2] if len(names) == 1 else None
                other = None if paired else next((n[2] for n in known if n[2] != thing), None)
                for v in m.groups():
                    if v is not None:
                        v = v.replace(",", "") if re.fullmatch(r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?:[eE].*)?", v) else v.replace(",", ".")
                        out.append({"thing": thing, "other": other, "value": v, "quote": sentence})
            at = end
    return out


class ReplayProvider:
    """Answers from a table of recorded responses by request key; an unknown request is an error."""

    name = "replay"

    def __init__(self, recorded: Mapping[str, str] | None = None):
        self.recorded = dict(recorded or {})

    def complete(self, request: Request) -> Response:
        try:
            return Response(json.loads(self.recorded[request.key()]))
        except KeyError as e:
            raise ProviderError(f"no recorded answer for a request of task {request.task}") from e


class RuleProvider:
    """Answers every task by fixed rules on the payload, the same way each time."""

    name = "rule"

    def complete(self, request: Request) -> Response:
        try:
            handler: Callable[[dict[str, Any]], dict[str, Any]] = getattr(self, f"_{request.task}")
        except AttributeError as e:
            raise ProviderError(f"unknown task {request.task}") from e
        return Response(handler(request.payload), Usage(len(request.user) // 4, 0))

    def _extract(self, p: dict[str, Any]) -> dict[str, Any]:
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", p["text"]):
            for name in dict.fromkeys(_NAME.findall(sentence)):
                known = [c for c in p.get("classes", []) if c.lower() in name.lower().replace(" ", "")]
                attributes = [{"name": re.sub(r"\W+", "_", m["name"].strip().lower()), "raw_text": m[0], "value": m["value"], "unit": m["unit"]} for m in _QUANTITY.finditer(sentence)]
                out.append({"text_span": name, "entity_type": max(known, key=len) if known else None, "confidence": 0.9 if known else 0.5, "attributes": attributes, "relationships": []})
        return {"entities": out}

    def _map(self, p: dict[str, Any]) -> dict[str, Any]:
        local = re.sub(r"\W+", "_", p["text_span"]).strip("_")
        triples = [{"predicate": a["name"], "object": a["value"], "datatype": "xsd:decimal" if re.fullmatch(r"-?\d+(\.\d+)?", a["value"] or "") else "xsd:string"} for a in p.get("attributes") or [] if a["value"]]
        triples += [{"predicate": r["predicate"], "object": r["target"], "datatype": None} for r in p.get("relationships") or []]
        return {"subject": local, "cls": p.get("entity_type") or "Entity", "description": p.get("section_context") or "", "triples": triples}

    def _same_entity(self, p: dict[str, Any]) -> dict[str, Any]:
        a, b = (set(re.findall(r"[a-z0-9]+", x.lower())) for x in (p["a"], p["b"]))
        return {"same_entity": a <= b or b <= a, "confidence": 0.9 if a <= b or b <= a else 0.6, "canonical": max(p["a"], p["b"], key=lambda x: (len(x), x))}

    def _synthesize(self, p: dict[str, Any]) -> dict[str, Any]:
        return {"title": p["label"], "paragraphs": [f"{p['label']}: {f['predicate']} is {f['object']} {f['anchor']}." for f in p["facts"]]}

    def _plain_english(self, p: dict[str, Any]) -> dict[str, Any]:
        about = p.get("object_type") or p.get("subject_type") or "it"
        return {"text": f"Check that the {p['attribute']} of each {about} stays within what is allowed."}

    def _check_document(self, p: dict[str, Any]) -> dict[str, Any]:
        paired = p.get("object_type") is not None
        return {"statements": [{"subject": x["other"] if paired else x["thing"], "object": x["thing"] if paired else None, "value": x["value"], "quote": x["quote"]} for x in statements(p["text"], p["attribute"])]}

    def _extract_direct(self, p: dict[str, Any]) -> dict[str, Any]:
        entities = self._extract({"text": p["text"], "classes": p.get("classes", [])})["entities"]
        rows = [{"subject": re.sub(r"\W+", "_", e["text_span"]), "cls": e["entity_type"], "property": a["name"], "value": a["value"]} for e in entities for a in e["attributes"]]
        return {"triples": rows}

    def _discover_rules(self, p: dict[str, Any]) -> dict[str, Any]:
        """Numbers far from those of the other individuals of their class: a rule that each breaks."""
        if "individuals" not in p:
            return {"rules": p.get("hints", [])}
        seen: dict[tuple[str, str], list[tuple[float, str]]] = {}
        for one in p["individuals"]:
            facts = json.loads(one["facts"])
            for name, value in facts.items():
                if name != "rdf_type" and re.fullmatch(r"-?\d+(?:\.\d+)?", value or ""):
                    seen.setdefault((facts.get("rdf_type", ""), name), []).append((float(value), one["name"]))
        rules = []
        for (cls, name), values in sorted(seen.items()):
            numbers = sorted(v for v, _ in values)
            if len(numbers) >= 8:
                low, high = numbers[len(numbers) // 4], numbers[3 * len(numbers) // 4]
                floor, roof = low - 3 * (high - low), high + 3 * (high - low)
                for v, who in values:
                    if not floor <= v <= roof:
                        rules.append({"subject": who, "object": None, "attribute": name, "operator": ">" if v > roof else "<", "value": f"{roof if v > roof else floor:g}", "reason": f"{name} of {cls} lies between {floor:g} and {roof:g}"})
        return {"rules": rules}

    def _direct_conflicts(self, p: dict[str, Any]) -> dict[str, Any]:
        """Sentences in which one thing is said to break another: what stands before and behind the verb."""
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", p["text"]):
            for m in _CONFLICT.finditer(sentence):
                before, behind = (re.sub(r"(?i)^(?:the|an?)\s+", "", x.strip()) for x in (m["subject"], m["object"] or ""))
                if before:
                    out.append({"subject": before, "object": behind or None, "conflict_type": re.sub(r"\W+", "_", m["verb"].lower()), "evidence": sentence.strip()})
        return {"conflicts": out}
