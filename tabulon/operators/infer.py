"""What columns mean: from their labels, from the shape of their values, and from both together."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

from tabulon import types as t
from tabulon.operators.profile import Profile

# Fixed values of the inference rules: parts of labels, the first rule that fits counts.
LABEL_RULES = (
    ("IDENTIFIER", ("_id", "uuid", "guid", "key")),
    ("MONETARY", ("price", "amount", "revenue", "cost", "total", "salary", "fee", "balance", "suma", "cena")),
    ("COUNTRY", ("country", "krajina")),
    ("EMAIL", ("mail",)),
    ("PERCENTAGE", ("percent", "ratio", "rate")),
    ("TIMESTAMP", ("time", "_at")),
    ("DATE", ("date", "datum")),
    ("STATUS", ("status", "state", "stav")),
    ("CATEGORY", ("category", "type", "kind", "kategoria")),
    ("QUANTITY", ("count", "qty", "quantity", "num", "pocet")),
    ("FLAG", ("is_", "has_", "flag")),
)
WHOLE_LABELS = {"id": "IDENTIFIER", "iso": "COUNTRY"}
DEFAULT_NAMES = {"IDENTIFIER": "id", "MONETARY": "amount"}
LEAST_CONFIDENCE = 0.50
CONFLICT_CONFIDENCE = 0.20
LABEL_CONFIDENCE = 0.65
AGREEMENT = (0.15, 0.95)
#: Names for columns without labels, by how many of a meaning came before.
CONVENTIONS = {"IDENTIFIER": ("transaction_id", "user_id", "entity_id"), "TEXT": ("description", "text_2"), "EMAIL": ("email", "email"), "PERCENTAGE": ("percentage", "percentage")}


@dataclass(frozen=True)
class Hint:
    """A proposal for one column."""

    index: int
    name: str
    semantic_type: str
    confidence: float
    why: str


def normalised(label: str) -> str:
    """Lower case with single underscores between; a leading digit gets a letter before it."""
    out = re.sub(r"[^a-z0-9]+", "_", re.sub(r"[A-Z]", lambda m: m[0].lower(), label)).strip("_")
    return f"c{out}" if out[:1].isdigit() else out


def from_label(name: str) -> str:
    if "id" in name.split("_"):
        return "IDENTIFIER"
    for meaning, parts in LABEL_RULES:
        if any(part in name for part in parts) or WHOLE_LABELS.get(name) == meaning:
            return meaning
    return "UNKNOWN"


def from_shape(p: Profile) -> tuple[str, float, str]:
    """(meaning, confidence, reason) from the values alone."""
    match p.type:
        case t.DECIMAL:
            marked = p.share("currency") > 0.10
            return ("MONETARY", 0.90, "amounts with a currency") if marked else ("MONETARY", 0.75, "decimal amounts")
        case t.DATE:
            return "DATE", 0.90, "dates"
        case t.DATETIME:
            return "TIMESTAMP", 0.90, "dates with times"
        case t.BOOLEAN:
            return "FLAG", 0.85, "two values, true and false"
        case t.INT64:
            if p.unique_ratio >= 0.95 and p.non_negative and not p.nulls:
                return "IDENTIFIER", 0.70, "nearly all different whole numbers without gaps"
            return "QUANTITY", 0.55, "whole numbers that repeat"
        case t.FLOAT64:
            return ("PERCENTAGE", 0.85, "numbers with a percent sign") if p.share("percent") >= 0.90 else ("QUANTITY", 0.55, "real numbers")
        case t.CATEGORICAL:
            return ("COUNTRY", 0.85, "few two-letter codes") if p.share("code") >= 0.95 and p.distinct <= 300 else ("CATEGORY", 0.60, f"{p.distinct} different texts")
        case t.UTF8:
            if p.share("email") >= 0.90:
                return "EMAIL", 0.90, "e-mail addresses"
            return ("COUNTRY", 0.70, "two-letter codes") if p.share("code") >= 0.95 else ("TEXT", 0.50, "free text")
    return "UNKNOWN", 0.0, ""


def contradicts(label: str, shape: str, kind: str) -> bool:
    """Whether a label's meaning can't be that of such values."""
    if "UNKNOWN" in (label, shape) or label == shape:
        return False
    allowed = {"MONETARY": t.NUMERIC, "COUNTRY": t.TEXT, "EMAIL": t.TEXT, "DATE": t.TEMPORAL, "TIMESTAMP": t.TEMPORAL}
    if label == "IDENTIFIER":
        return kind == t.BOOLEAN or kind in t.TEMPORAL
    return label in allowed and kind not in allowed[label]


def hints(profiles: list[Profile], has_header: bool) -> list[Hint]:
    """A proposal for every column; names are unique but for those of columns in contradiction."""
    out, uses = [], Counter()
    for k, p in enumerate(profiles):
        label = normalised(p.name) if has_header else ""
        said = from_label(label) if label else "UNKNOWN"
        shape, confidence, why = from_shape(p)
        if contradicts(said, shape, p.type):
            out.append(Hint(k, label, "UNKNOWN", CONFLICT_CONFIDENCE, f"called {said}, but made of {p.type}: {why}"))
            continue
        meaning = shape
        if said != "UNKNOWN":
            more, most = AGREEMENT
            agree = said == shape
            meaning, confidence, why = said, min(most, confidence + more) if agree else LABEL_CONFIDENCE, f"called so, and made of {why}" if agree else f"called so; {p.type} values don't speak against it"
        if confidence < LEAST_CONFIDENCE:
            meaning, why = "UNKNOWN", why or "neither label nor values tell"
        name = label or (f"column_{k}" if meaning == "UNKNOWN" else DEFAULT_NAMES.get(meaning, meaning.lower()))
        uses[name] += 1
        out.append(Hint(k, name if uses[name] == 1 else f"{name}_{uses[name]}", meaning, confidence, why))
    return out


def named_by_convention(found: list[Hint]) -> list[Hint]:
    """Names for a file without labels; columns of unknown meaning keep their place as a name."""
    seen, out = Counter(), []
    for hint in found:
        if hint.semantic_type == "UNKNOWN":
            out.append(replace(hint, name=f"column_{hint.index}"))
            continue
        base = DEFAULT_NAMES.get(hint.semantic_type, hint.semantic_type.lower())
        choices = CONVENTIONS.get(hint.semantic_type, (base, f"{base}_2"))
        out.append(replace(hint, name=choices[min(seen[hint.semantic_type], len(choices) - 1)]))
        seen[hint.semantic_type] += 1
    return out


def overlay(schema: t.Schema, found: list[Hint]) -> t.Schema:
    """The schema with proposals for columns that nobody has confirmed."""
    by_index = {h.index: h for h in found}
    columns = [c if c.confirmed or c.index not in by_index else replace(c, semantic_name=(h := by_index[c.index]).name, semantic_type=h.semantic_type, confidence=h.confidence) for c in schema.columns]
    return schema.with_columns(columns)


def build(dialect: t.Dialect, profiles: list[Profile], dataset: str = "") -> t.Schema:
    """A schema of profiled columns with what labels and values say."""
    columns = tuple(t.Column(p.name, k, p.type) for k, p in enumerate(profiles))
    return overlay(t.Schema(columns, dialect, dataset), hints(profiles, dialect.has_header))
