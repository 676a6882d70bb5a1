"""Providers that answer questions: a JSON service over HTTP, a plug-in class, and the choice between them.

A provider is any picklable object with ``decide(state, questions)``. ``state`` has ``document`` and ``images`` (data URLs); ``questions``
maps an id to ``type`` (noul, score or choice), ``instructions`` and ``criteria``. It returns a mapping of id to a probability, or to a
mapping with ``probability``, ``score`` or ``choice``; under ``_usage`` it may give ``input_tokens``, ``output_tokens`` and ``model``.
"""

from __future__ import annotations

import importlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable

_TYPES = {"noul": "predicate", "score": "score", "choice": "choice"}


def _criteria(question: dict) -> list[tuple[str, str]]:
    """(key, description) of a question's levels or choices; of a list of levels the key is the number, of choices the text."""
    given = question.get("criteria") or []
    if isinstance(given, dict):
        return [(str(k), str(k if v is None else v)) for k, v in given.items()]
    texts = [(i, str(x)) for i, x in enumerate(given) if x is not None]
    return [(str(i) if question["type"] == "score" else x, x) for i, x in texts]


def request_body(state: dict, questions: dict[str, dict], model: str | None) -> dict:
    """The JSON that is posted: the document, as parts where there are images, and the questions by name."""
    asked = []
    for name, q in questions.items():
        one = {"name": name, "type": _TYPES[q["type"]], "instructions": q.get("instructions", "")}
        if q["type"] == "score":
            one["levels"] = [{"label": k, "description": d} for k, d in _criteria(q)]
        elif q["type"] == "choice":
            one["choices"] = [{"value": k, "description": d} for k, d in _criteria(q)]
        asked.append(one)
    text, images = state.get("document") or "", state.get("images") or []
    parts = [{"type": "input_text", "text": text}, *({"type": "input_image", "image_url": u} for u in images)]
    return {"model": model, "input": parts if images else text, "questions": asked}


def answers_of(raw: dict, questions: dict[str, dict]) -> dict:
    """Answers by name, from a list of answers or decisions, or from a mapping of decisions."""
    found = raw.get("answers") if isinstance(raw.get("answers"), list) else raw.get("decisions") or []
    if isinstance(found, dict):
        found = [{"name": k, **v} for k, v in found.items() if isinstance(v, dict)]
    keys = {"noul": "probability", "score": "score", "choice": "choice"}
    out: dict = {}
    for one in found:
        name = str(one.get("name") or one.get("id") or "")
        if name in questions:
            key = keys[questions[name]["type"]]
            out[name] = {key: one.get(key, "" if key == "choice" else 0.0), "confidence": float(one.get("confidence", 1.0))}
    usage = raw.get("usage") if isinstance(raw.get("usage"), dict) else {}
    tokens = lambda *names: next((int(usage[n]) for n in names if usage.get(n)), 0)
    out["_usage"] = {
        "input_tokens": tokens("input_tokens", "prompt_tokens"), "output_tokens": tokens("output_tokens", "completion_tokens"),
        "model": raw.get("model")
    }
    return out


class HttpProvider:
    """Posts to ``url``/decisions. Refused keys are errors at once; 429, 5xx and network failures are raised for the caller to retry."""

    def __init__(self, url: str, key: str | None = None, model: str | None = None, timeout: float = 30.0):
        self.url, self.key, self.model, self.timeout = url.rstrip("/"), key, model, timeout

    def decide(self, state: dict, questions: dict[str, dict]) -> dict:
        if not self.key:
            raise PermissionError("no key for the provider: set PLUMBLINE_API_KEY or pass one")
        if not questions:
            return {}
        data = json.dumps(request_body(state, questions, self.model)).encode()
        request = urllib.request.Request(f"{self.url}/decisions", data, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return answers_of(json.load(reply), questions)
        except urllib.error.HTTPError as error:
            kind = PermissionError if error.code in (401, 403) else RuntimeError
            raise kind(f"provider answered {error.code}: {error.read().decode(errors='replace')[:300]}") from error
        except urllib.error.URLError as error:
            raise RuntimeError(f"connection to the provider failed: {error.reason}") from error


class _Plugin:
    """A class named module:Class, made in the worker."""

    def __init__(self, name: str, options: dict):
        self.name, self.options = name, options

    def __call__(self):
        module, _, attribute = self.name.partition(":")
        return getattr(importlib.import_module(module), attribute)(**self.options)


def provider(name: str = "auto", url: str | None = None, key: str | None = None, model: str | None = None) -> Callable[[], object]:
    """A function that makes the provider in a worker: ``http``, ``module:Class``, or ``auto``, which is http where a service is known."""
    url, key = url or os.environ.get("PLUMBLINE_PROVIDER_URL"), key or os.environ.get("PLUMBLINE_API_KEY")
    chosen = name.strip()
    if chosen.lower() in ("auto", "http"):
        if not url:
            raise ValueError("no provider: give its URL or set PLUMBLINE_PROVIDER_URL")
        return lambda: HttpProvider(url, key, model)
    if ":" not in chosen:
        raise ValueError(f"unknown provider {name!r}: auto, http or module:Class")
    return _Plugin(chosen, {"model": model} if model else {})
