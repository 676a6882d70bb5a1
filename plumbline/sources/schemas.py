"""JSON Schema of preset and label files."""

from __future__ import annotations

from dataclasses import fields

from ..operators.validate import Criteria

_DRAFT = "https://json-schema.org/draft/2020-12/schema"
_TEXT, _NUMBER, _INTEGER, _FLAG = {"type": "string"}, {"type": "number"}, {"type": "integer"}, {"type": "boolean"}


def _texts() -> dict:
    return {"type": "array", "items": _TEXT}


def preset() -> dict:
    """A preset file: its name, what it excludes, and questions by id."""
    levels = {"anyOf": [_texts(), {"type": "object", "additionalProperties": {"type": ["string", "null"]}}]}
    part = {"type": ["number", "null"], "minimum": 0, "maximum": 1}
    question = {
        "type": "object",
        "required": ["type"],
        "properties": {
            "type": {"enum": ["score", "noul", "choice"]},
            "label": _TEXT,
            "instructions": _TEXT,
            "criteria": levels,
            "weight": {"type": ["number", "null"], "minimum": 0},
            "min_threshold": part,
            "max_threshold": part,
            "max_drop": part,
            "preflight": {"enum": ["credentials", "pii", None]},
            "advisory": _FLAG,
        },
    }
    properties = {
        "name": _TEXT,
        "preset": _TEXT,
        "title": _TEXT,
        "description": _TEXT,
        "exclude": _texts(),
        "provider": _TEXT,
        "model": _TEXT,
        "thresholds_as_warnings": _FLAG,
        "include_images": _FLAG,
        "max_images_per_doc": _INTEGER,
        "sanitizer": {"type": "object", "properties": {"role_emails": _texts()}},
        "questions": {"type": "object", "additionalProperties": question},
    }
    return {"$schema": _DRAFT, "title": "preset", "type": "object", "properties": properties}


def labels() -> dict:
    """A label file: documents and pairs with what is expected of their questions, and criteria."""
    kinds = {"float": _NUMBER, "int": _INTEGER, "str": {"enum": ["kind", "pair"]}, "tuple": _texts()}
    criteria = {f.name: next(v for k, v in kinds.items() if str(f.type).startswith(k)) for f in fields(Criteria)}
    expect = lambda *words: {"type": "object", "additionalProperties": {"enum": list(words)}}
    strict = lambda properties, *required: {"type": "object", "additionalProperties": False, "required": list(required), "properties": properties}
    document = strict({"path": _TEXT, "expect": expect("present", "absent")}, "path", "expect")
    pair = strict(
        {"before": _TEXT, "after": _TEXT, "expect": expect("down", "neutral"), "kind": _TEXT, "doc_id": _TEXT, "runs": _INTEGER}, "before",
        "after", "expect"
    )
    properties = {
        "preset": _TEXT, "config": _TEXT, "runs": _INTEGER, "criteria": strict(criteria), "documents": {"type": "array", "items": document},
        "pairs": {"type": "array", "items": pair}
    }
    return {"$schema": _DRAFT, "title": "labels", **strict(properties)}
