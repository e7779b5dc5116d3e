"""Configuration of the extraction engine: one frozen record, every value a parameter."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

# Word lists, markers and reference texts of the flow-chemistry domain.
BACK_MATTER = (
    "Acknowledgements", "Acknowledgement", "Data availability", "ASSOCIATED CONTENT", "Conflict of interest",
    "Conflicts of interest", "Conflict of interests", "Conflicts of interests",
)
GATE_KEYWORDS = (
    "flow chemistry", "continuous flow", "residence time", "flow rate", "mL/min", "µL/min", "ul/min", "reactor",
    "tubular", "coil", "microreactor", "inner diameter", "i.d.", "mm", "μm", "temperature", "°c", "selectivity",
    "conversion", "yield", "bpr", "bar", "back pressure", "min", "pressure",
)
SECTION_KEYWORDS = (
    ("abstract", ("abstract", "summary")),
    ("conclusion", ("conclusion", "conclusions", "final remarks", "summary of findings")),
    ("results", ("results", "findings", "performance", "optimization", "design of experiments", "DoE")),
    ("methods", ("methods", "methodology", "experimental", "experimental section", "materials and methods")),
    ("setup", ("reactor setup", "flow setup", "continuous flow setup", "apparatus")),
    ("flow", ("flow chemistry", "process development", "continuous flow", "microreactor", "tubular reactor")),
)
SECTIONS = ("abstract", "conclusion", "results", "introduction", "methods", "other")
PRIORITY = ("abstract", "conclusion", "results", "setup")
EMBEDDING_REFERENCE = (
    "flow chemistry, continuous flow, process development, residence time, "
    "flow rate, mL/min, µL/min, temperature °C, catalyst, reagent feed, "
    "reactor type, tubular reactor, microreactor, microchannel, coil, "
    "inner diameter ID, mm, μm, conversion %, yield %, selectivity %, "
    "optimization, space time yield, mixer, back pressure regulator"
)
ABSTRACT_REFERENCE = (
    "conclusion abstract summary findings results flow chemistry continuous flow process development reactor "
    "flow rate residence time optimization scale-up yield conversion selectivity catalyst temperature pressure"
)

# Prompts of this engine; a model backend may be given others.
SYSTEM_PROMPT = "You read chemistry papers and answer from the given text alone."
CLASSIFY_TASK = "Does this paragraph report experimental facts on flow chemistry or process development? Reply Yes or No."
ABSTRACT_TASK = "State in a few sentences the reaction, the substances, the reactor, the conditions and the outcome that the paragraph reports."
SUMMARY_TASK = "Return one JSON object reaction_summary with reaction_type, reactants, products, conditions, reactor and metrics. Use null where the paragraph says nothing and keep its units."
OVERALL_TASK = "Return one JSON object reaction_summary for the whole document, with the best reported conditions. Write nothing but JSON."


@dataclass(frozen=True)
class Config:
    top_n: int = 10
    max_tokens: int = 200
    title_chars: int = 200
    abstract_chars: int = 400
    overall_chars: int = 12_000
    back_matter: tuple[str, ...] = BACK_MATTER
    gate_keywords: tuple[str, ...] = GATE_KEYWORDS
    section_keywords: tuple[tuple[str, tuple[str, ...]], ...] = SECTION_KEYWORDS
    sections: tuple[str, ...] = SECTIONS
    priority: tuple[str, ...] = PRIORITY
    embedding_reference: str = EMBEDDING_REFERENCE
    abstract_reference: str = ABSTRACT_REFERENCE
    system_prompt: str = SYSTEM_PROMPT
    classify_task: str = CLASSIFY_TASK
    abstract_task: str = ABSTRACT_TASK
    summary_task: str = SUMMARY_TASK
    overall_task: str = OVERALL_TASK
    backends: dict[str, str] = field(default_factory=lambda: {"classify": "rules", "abstract": "rules", "summary": "rules", "overall": "rules", "embed": "hash"})
    model_dir: str = "models"
    strict: bool = False

    @classmethod
    def from_environment(cls, **changes) -> Config:
        """Defaults, then the environment (PAPERLOOM_TOP_N), then the arguments."""
        config = cls()
        if os.environ.get("PAPERLOOM_TOP_N"):
            config = replace(config, top_n=int(os.environ["PAPERLOOM_TOP_N"]))
        return replace(config, **changes)
