"""Project configuration: found upward from a folder, merged over a preset."""

from __future__ import annotations

import tomllib
from pathlib import Path

from ..functions import fixed as V

NAMES = (".plumbline.yaml", ".plumbline.yml")
_FIELDS = ("preset", "question", "type", "label", "weight", "min_threshold", "max_threshold", "preflight", "advisory", "criteria")


def found(start: str | Path = ".") -> Path | None:
    """The nearest configuration at or above ``start``; the search ends at a repository's root."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        for name in NAMES:
            if (folder / name).is_file():
                return folder / name
        table = folder / "pyproject.toml"
        if table.is_file() and "plumbline" in tomllib.loads(table.read_text(encoding="utf-8")).get("tool", {}):
            return table
        if (folder / ".git").exists():
            return None
    return None


def merged(config: dict) -> tuple[str, list[tuple]]:
    """(preset name, question rows): questions of the named preset updated field by field, new ones appended."""
    base = config.get("preset")
    rows = [dict(zip(_FIELDS, r, strict=True)) for r in V.QUESTIONS if base and r[0].replace("-", "_") == base.lower().replace("-", "_")]
    if base and not rows:
        raise ValueError(f"unknown preset: {base}")
    name = config.get("name") or base or "project"
    by_id = {r["question"]: r for r in rows}
    for q, given in (config.get("questions") or {}).items():
        by_id[q] = by_id.get(q, dict.fromkeys(_FIELDS) | {"question": q, "advisory": False, "criteria": []}) | {k: v for k, v in given.items() if k in _FIELDS}
        if not by_id[q]["type"]:
            raise ValueError(f"question {q} has no type")
    return name, [tuple(r[k] for k in _FIELDS) for r in (r | {"preset": name} for r in by_id.values())]


def loaded(start: str | Path = ".") -> tuple[str, list[tuple]] | None:
    import yaml

    if (path := found(start)) is None:
        return None
    text = path.read_text(encoding="utf-8")
    config = tomllib.loads(text)["tool"]["plumbline"] if path.suffix == ".toml" else yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} is no mapping")
    return merged(config)
