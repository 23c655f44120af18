"""Label domain, alias table and grouping defaults.

Labels, aliases and grouping columns are arguments everywhere; the values below are
only the defaults used by the fixtures, the registered queries and the tests.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (must equal the evaluated label set and its alias table) ---------
# Class labels, in the order used for every per-class table and for macro averages.
DEFAULT_LABELS: list[str] = ["ASD", "VSD", "PDA", "Normal"]

# Synonyms a model may answer with, per label (all lower case), in priority order.
DEFAULT_ALIASES: dict[str, list[str]] = {
    "ASD": [
        "asd",
        "atrial septal defect",
        "atrial septal",
        "ostium secundum",
        "secundum asd",
        "right heart enlargement",
    ],
    "VSD": [
        "vsd",
        "ventricular septal defect",
        "ventricular septal",
        "interventricular communication",
        "interventricular defect",
    ],
    "PDA": [
        "pda",
        "patent ductus arteriosus",
        "ductus arteriosus",
        "ductal",
        "patent duct",
    ],
    "Normal": [
        "normal",
        "no chd",
        "no congenital",
        "no defect",
        "no abnormality",
        "healthy",
        "unremarkable",
        "within normal limits",
        "no significant abnormality",
    ],
}

# JSON keys tried, in order, when a model answers with a JSON object.
DEFAULT_JSON_KEYS: list[str] = [
    "diagnosis", "label", "classification", "prediction", "class", "result",
]

# Placeholder for an unparsed prediction: always wrong, and its own kappa class.
NONE_LABEL = "__NONE__"
# -----------------------------------------------------------------------------------

DEFAULT_GROUP_COLS: list[str] = ["model_name", "prompt_id"]


@dataclass(frozen=True)
class LabelSpec:
    """Label domain plus alias table; compiled into Column literals by the parser."""

    labels: list[str] = field(default_factory=lambda: list(DEFAULT_LABELS))
    aliases: dict[str, list[str]] = field(
        default_factory=lambda: {k: list(v) for k, v in DEFAULT_ALIASES.items()}
    )
    json_keys: list[str] = field(default_factory=lambda: list(DEFAULT_JSON_KEYS))

    def prob_cols(self) -> dict[str, str]:
        return {label: f"prob_{label}" for label in self.labels}
