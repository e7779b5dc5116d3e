"""Model backends: functions from a batch of prompts' contents to answers, by name.

A backend is made once a task by its factory. ``rules`` needs no model and is deterministic; a
real model registers itself with ``register``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain

Backend = Callable[[Sequence[str], Sequence[str], int], list[str]]  # (prompts, contents, max_tokens)
_factories: dict[tuple[str, str], Callable[[], Backend]] = {}

# Patterns are tried where a number is, and not at every character. A run of digits is looked at once.
_RUN = re.compile(r"\d\d*+(?=((?:\.\d++)?+))")  # group 1: the number's fraction
_UNITS = {
    "temperature": re.compile(r"\s?(?:°\s?C|K\b)"),
    "flow_rate_total": re.compile(r"\s?(?:mL/min|uL/min|L/h|mL·min−1|mL min-1)"),
    "pressure": re.compile(r"\s?(?:bar|MPa|kPa|psi)\b"),
    "diameter": re.compile(r"\s?(?:mm|µm|um)\b"),
}
_TIME = re.compile(r"(?i)\s?(?:min|s|h)\b")
_PERCENT = re.compile(r"\s?%")
NUMBER = r"[-+]?\d+(?:\.\d+)?"
_TIMED = re.compile(rf"(?i)residence times?\D{{0,20}}?({NUMBER}\s?(?:min|s|h)\b)")
_REACTOR = re.compile(r"(?i)\b(microreactor|tubular reactor|packed[- ]bed reactor|coil|microchannel|chip)\b")
_REACTORS = ("reactor", "coil", "microchannel", "chip")
_LEAD = len("packed-bed ")  # the most that stands before a word of _REACTORS
_FOLDED = "İıſK"  # letters beyond a to z that a pattern takes for one of them
_MEASURE = {k: (re.compile(rf"(?i)\b{k}s?\b\D{{0,20}}?({NUMBER})\s?%"), re.compile(rf"(?i)\s?%\s+{k}\b")) for k in ("conversion", "yield", "selectivity")}
#: Characters before a number in which the words are that it may belong to ("residence times", "selectivitys",
#: 20 characters and a sign).
_BEFORE = 40
_FACT = re.compile(r"\s?(?:°\s?C|K|min|mL/min|µL/min|uL/min|mm|bar|MPa|kPa|%)")


def same_micro(text: str) -> str:
    """One code point for micro, one for the product dot and one for minus."""
    return text.replace("μ", "µ").replace("−", "-").replace("⋅", "·")


def _reactor(text: str) -> re.Match | None:
    if not text.isascii() and any(c in text for c in _FOLDED):
        return _REACTOR.search(text)
    low = text.lower()
    places = [at for word in _REACTORS if (at := low.find(word)) >= 0]
    return _REACTOR.search(text, max(0, min(places) - _LEAD)) if places else None


def _quantities(text: str) -> tuple[dict[str, str], dict[str, float]]:
    """The first number with each unit, as it is written; the first percentage of each measure."""
    found: dict[str, str] = {}
    measures: dict[str, float] = {}
    for run in _RUN.finditer(text):
        begin, end = run.start(), run.end(1)
        if begin and text[begin - 1] in "+-":
            begin -= 1
        for name, unit in _UNITS.items():
            if name not in found and (m := unit.match(text, end)):
                found[name] = text[begin : m.end()]
        if "residence_time" not in found and (m := _TIME.match(text, end)):
            if timed := _TIMED.search(text, max(0, begin - _BEFORE), m.end()):
                found["residence_time"] = timed[1]
        if len(measures) < len(_MEASURE) and (m := _PERCENT.match(text, end)):
            for name, (before, behind) in _MEASURE.items():
                if name not in measures:
                    if told := before.search(text, max(0, begin - _BEFORE), m.end()):
                        measures[name] = float(told[1])
                    elif behind.match(text, end):
                        measures[name] = float(text[begin:end])
    return found, measures


def extracted(text: str) -> dict:
    """The reaction summary that plain patterns find in a text; null or empty where none does."""
    text = same_micro(text)
    units, percents = _quantities(text.replace("µL/min", "uL/min"))
    found = {k: units[k] for k in ("temperature", "residence_time", "flow_rate_total", "pressure") if k in units}
    measures = {k: percents.get(k) for k in _MEASURE}
    reactor = _reactor(text)
    plain = lambda x: int(x) if x is not None and x == int(x) else x
    measures = {k: plain(v) for k, v in measures.items()}
    return {
        "reaction_summary": {
            "reaction_type": None,
            "reactants": [],
            "products": [{"name": None, "yield_optimal": measures["yield"], "unit": "%"}] if measures["yield"] is not None else [],
            "conditions": [{"type": k, "value": v} for k, v in found.items()],
            "reactor": {"type": reactor[1].lower() if reactor else None, "inner_diameter": units.get("diameter")},
            "metrics": {**measures, "unit": "%"},
        }
    }


def has_fact(text: str) -> bool:
    """Whether a number with a unit stands in the text."""
    return any(_FACT.match(text, run.end(1)) for run in _RUN.finditer(text))


def _classify() -> Backend:
    return lambda prompts, contents, n: ["Yes" if has_fact(same_micro(c)) else "No" for c in contents]


def _abstract() -> Backend:
    """Leading sentences up to four characters a token. Nothing is read behind them."""
    border = re.compile(r"\s(?<=[.!?]\s)\s*")

    def answer(prompts: Sequence[str], contents: Sequence[str], n: int) -> list[str]:
        out = []
        for text in contents:
            taken, at = "", 0
            for m in chain(border.finditer(text), (None,)):
                sentence = text[at : m.start() if m else None]
                if taken and len(taken) + len(sentence) + 1 > 4 * n:
                    break
                taken = f"{taken} {sentence}".strip()
                at = m.end() if m else at
            out.append(taken)
        return out

    return answer


def _extract() -> Backend:
    return lambda prompts, contents, n: [json.dumps(extracted(c), ensure_ascii=False) for c in contents]


def register(stage: str, name: str, factory: Callable[[], Backend]) -> None:
    _factories[stage, name] = factory


for _stage, _factory in (("classify", _classify), ("abstract", _abstract), ("summary", _extract), ("overall", _extract)):
    register(_stage, "rules", _factory)


def resolve(stage: str, name: str, model_dir: str = "models", strict: bool = False, fallbacks: Sequence[str] = ("rules",)) -> Callable[[], Backend]:
    """The factory of a backend, chosen on the driver before a job.

    Order: the name itself, then (not if strict) the fallbacks; a name that is a model file is
    looked for in model_dir and then in the user's cache folder. Nothing is downloaded. In strict
    mode PAPERLOOM_STRICT_MODEL names the backend if no name is given. LookupError if none is found.
    """
    if strict and not name:
        name = os.environ.get("PAPERLOOM_STRICT_MODEL", "")
    for candidate in [name, *([] if strict else fallbacks)]:
        for key in ((stage, candidate), *((stage, os.path.join(folder, candidate)) for folder in (model_dir, os.path.expanduser("~/.cache/models")))):
            if key in _factories:
                return _factories[key]
    raise LookupError(f"no backend {name!r} for {stage}")
