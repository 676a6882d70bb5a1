"""Priority scan of texts for credentials, secrets, e-mail addresses, URLs, IP addresses and phone numbers.

One Arrow-batched UDF a document: the kinds are scanned in order of priority, and a match that overlaps an accepted span is dropped.
Accepted spans are kept sorted, so an overlap is found by bisection, and lines by bisection in the newline index. Values never leave the
UDF: a span carries its place, placeholder, replacement and features.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import urllib.parse
from bisect import bisect_left, bisect_right
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import fixed as V

SPAN = (
    "struct<kind: string, type: string, start: int, end: int, ord: int, placeholder: string, replacement: string, line: int, column: int, "
    "end_line: int, end_column: int, is_example: boolean, is_redaction: boolean, "
    "domain_type: string, local_part_shape: string, known_role_word: boolean, matches_custom_role: boolean, "
    "country_format: string, looks_like_support: boolean, is_support_prefix: boolean, near_support_keyword: boolean, is_mobile: boolean, "
    "ip_type: string, is_example_domain: boolean, is_internal_tld: boolean, is_public_common: boolean, suffix_class: string, "
    "key_name: string, value_length: int, character_classes: array<string>, placeholder_syntax: boolean, near_example_words: boolean, "
    "location: string, is_known_format: boolean>"
)
RESULT = f"struct<spans: array<{SPAN}>, masked: string>"
_FIELDS = re.findall(r"(\w+): ", SPAN)
_CREDENTIALS = [(re.compile(p, re.I if i else 0), t, real, example) for p, i, t, real, example in V.CREDENTIALS]
#: What a text must hold for a pattern to match at all: a cheap search spares most texts the pattern.
_HINTS = ["akia", "gh", "sk_", "sk-", "apikey_", "bearer", "private key", "xox"]
_KEY_HINTS = ["password", "passwd", "pwd", "api_key", "apikey", "token", "secret"]
_DIGIT = re.compile("[0-9]")
_IP_HINT = re.compile(r"\d\.\d|[0-9a-fA-F:]:")
_PHONE_HINT = re.compile(r"\+[1-9]|\b0[1-9]|\b1-800")
_KEY_VALUE, _EMAIL, _URL, _IP, _PHONE = re.compile(V.KEY_VALUE, re.I), re.compile(V.EMAIL), re.compile(V.URL, re.I), re.compile(V.IP), re.compile(V.PHONE)


class _Places:
    """Non-overlapping half-open intervals."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        if i < len(self.starts) and self.starts[i] < end:
            return False
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True

    def free(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return not (i < len(self.starts) and self.starts[i] < end)


def email_features(address: str, role_globs: tuple[str, ...] = ()) -> dict:
    local, _, domain = address.lower().partition("@")
    shape = "dotted_name" if "." in local else "hyphenated" if "-" in local else "single_word" if local.replace("_", "").isalnum() else "other"
    role = local in V.ROLE_WORDS or any(local.startswith(a) or local.endswith(a) for a in V.ROLE_AFFIXES)
    return {
        "domain_type": "free_mail" if domain in V.FREE_MAIL else "corporate", "local_part_shape": shape, "known_role_word": role,
        "matches_custom_role": any(fnmatchcase(local, g.lower()) for g in role_globs)
    }


def ip_type(text: str) -> str | None:
    """Category of an address; null if it is none."""
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    documented = any(text.startswith(p) for p in V.DOCUMENTATION_V4) if ip.version == 4 else ip in ipaddress.ip_network("2001:db8::/32")
    return "documentation" if documented else "loopback" if ip.is_loopback else "private" if ip.is_private else "public"


def phone_features(number: str, around: str) -> dict:
    prefix, mobile = number.startswith(tuple(V.SUPPORT_PREFIXES)), number.startswith(("090", "080", "070"))
    near = any(w in around.lower() for w in V.SUPPORT_WORDS)
    country = "US" if number.startswith(("+1", "1-800")) else "international" if number.startswith("+") else "JP"
    return {
        "country_format": country, "looks_like_support": prefix or (near and not mobile), "is_support_prefix": prefix,
        "near_support_keyword": near, "is_mobile": mobile
    }


def url_features(url: str) -> dict:
    trimmed = url.rstrip(".,])>")
    try:
        host = (urllib.parse.urlparse(trimmed if "://" in trimmed else "http://" + trimmed).hostname or "").lower()
    except ValueError:
        host = ""
    kind = ip_type(host) if host else None
    ending = next((e for e in [*V.INTERNAL_ENDINGS, *V.EXAMPLE_ENDINGS] if host.endswith(e)), None)
    example = kind in ("loopback", "documentation") or host in V.EXAMPLE_DOMAINS or host.endswith(tuple(V.EXAMPLE_ENDINGS)) or host.startswith(
        ("example.", "api.example.")
    )
    return {
        "ip_type": kind, "is_example_domain": example, "is_internal_tld": host.endswith(tuple(V.INTERNAL_ENDINGS)),
        "is_public_common": host == "github.com" or host.endswith(".github.com"), "suffix_class": ending
    }


def secret_features(key: str, raw: str, around: str, known: bool) -> dict:
    value, lower = raw.strip("\"'"), around.lower()
    classes = [
        n for n,
        test in (
            ("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit), ("symbol", lambda c: not c.isalnum())
        ) if any(map(test, value))
    ]
    bracketed = any(value.startswith(a) and value.endswith(b) for a, b in (("${", "}"), ("<", ">"), ("{{", "}}")))
    name = "\n" + key.lower()
    place = "env_block" if "```env" in lower or name + "=" in lower or name + ":" in lower else "code_block" if "`" in around else "prose"
    return {
        "key_name": key, "value_length": len(value), "character_classes": classes,
        "placeholder_syntax": bracketed or any(p in value.lower() for p in V.SECRET_PLACEHOLDERS),
        "near_example_words": any(w in lower for w in V.NEAR_EXAMPLE), "location": place, "is_known_format": known
    }


def is_placeholder(token: str) -> bool:
    return token in V.EXAMPLE_KEYS if token.startswith("AKIA") else any(p in token.lower() for p in V.PLACEHOLDER_SUBSTRINGS)


def scan_text(text: str, role_globs: tuple[str, ...] = (), mask: bool = True) -> tuple[list[dict], str]:
    """(spans in scan order, masked text)."""
    places, spans, edits = _Places(), [], []
    lower = text.lower()
    newlines: list[int] = []

    def at(offset: int) -> tuple[int, int]:
        if not newlines:  # most texts have no span and need no index
            newlines.extend([m.start() for m in re.finditer("\n", text)] or [len(text)])
        line = bisect_left(newlines, offset)
        return line + 1, offset - (newlines[line - 1] if line else -1)

    def accept(kind: str, m: re.Match, replacement: str, placeholder: str, n: int | None, example: bool, **features) -> None:
        places.take(m.start(), m.end())
        (line, column), (end_line, end_column) = at(m.start()), at(m.end())
        edits.append((m.start(), m.end(), replacement))
        spans.append(
            dict.fromkeys(_FIELDS) | {
                "kind": kind, "start": m.start(), "end": m.end(), "ord": n, "placeholder": placeholder, "replacement": replacement,
                "line": line, "column": column, "end_line": end_line, "end_column": end_column, "is_example": example, "is_redaction": True
            } | features
        )

    secrets = 0
    for hint, (pattern, name, real, example) in zip(_HINTS, _CREDENTIALS, strict=True):
        for m in pattern.finditer(text) if hint in lower else ():
            if not places.free(*m.span()):
                continue
            if is_placeholder(m[0]):
                accept("credential", m, example, example, None, True, type=f"example_{name}", is_redaction=False)
            else:
                secrets += 1
                accept("credential", m, real, real, secrets, False, type=name, **secret_features(name, m[0], text[max(0, m.start() - 60) : m.end() + 60], True))
    for m in _KEY_VALUE.finditer(text) if any(h in lower for h in _KEY_HINTS) else ():
        if places.free(*m.span()):
            secrets += 1
            features = secret_features(m["key"], m["val"], text[max(0, m.start() - 60) : m.end() + 60], False)
            quote, placeholder = m["quote"] or "", f"[SECRET_{secrets}]"
            example = features["placeholder_syntax"]
            accept(
                "secret", m, f"{quote}{m['key']}{quote}{': ' if m['delim'] == ':' else '='}{placeholder}", placeholder, secrets, example,
                type="example_secret" if example else "ambiguous_secret", is_redaction=not example, **features
            )

    def numbered(kind: str, pattern: re.Pattern, features_of, type_of, key=lambda v: v) -> None:
        seen: dict[str, tuple[int, dict]] = {}
        for m in pattern.finditer(text):
            if not places.free(*m.span()):
                continue
            value = key(m[0])
            if value not in seen:
                if (features := features_of(value, m)) is None:
                    continue
                seen[value] = (len(seen) + 1, features)
            n, features = seen[value]
            name = type_of(features)
            accept(kind, m, f"[{kind.upper()}_{n}]", f"[{kind.upper()}_{n}]", n, name.startswith("example"), type=name, **features)

    if "@" in text:
        numbered(
            "email", _EMAIL, lambda v, m: email_features(v, role_globs),
            lambda f: "email_free_mail" if f["domain_type"] == "free_mail" else "email_role" if f["known_role_word"] or f[
                "matches_custom_role"
            ] else "email_personal",
            str.lower
        )
    if "://" in text:
        numbered(
            "url", _URL, lambda v, m: url_features(v),
            lambda f: "example_url" if f[
                "is_example_domain"
            ] or f["is_public_common"] else "url_internal" if f["is_internal_tld"] else "url_public"
        )
    digits = _DIGIT.search(text)
    if (digits or ":" in text) and _IP_HINT.search(text):
        numbered(
            "ip", _IP, lambda v, m: {"ip_type": t} if (t := ip_type(v)) else None,
            lambda f: {"documentation": "example_ip", "loopback": "example_ip", "private": "ip_private"}.get(f["ip_type"], "ip_public")
        )
    if digits and _PHONE_HINT.search(text):
        numbered(
            "phone", _PHONE, lambda v, m: phone_features(v, text[max(0, m.start() - 50) : m.end() + 50]),
            lambda f: "phone_support" if f["looks_like_support"] else "phone_personal"
        )
    if not mask:
        return spans, text
    parts, last = [], 0
    for start, end, replacement in sorted(edits):
        parts += [text[last:start], replacement]
        last = end
    return spans, "".join(parts) + text[last:]


def scan(text: Column, role_globs: tuple[str, ...] = (), mask: bool = True) -> Column:
    """Struct (spans, masked); null texts give no spans and a null text."""
    batches.bounded()

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [scan_text(t, role_globs, mask) if isinstance(t, str) else ([], None) for t in texts]
        return pd.DataFrame({"spans": [f[0] for f in found], "masked": [f[1] for f in found]})

    return run(text)


def token_hashes(text: Column, role_globs: tuple[str, ...] = ()) -> Column:
    """(placeholder, hash) of every value that a scan finds. Two texts hold the same value, as a whole and not as a part of a longer one, if
    they share a hash; the values themselves never leave the worker."""
    batches.bounded()

    @F.pandas_udf("array<struct<placeholder: string, hash: string>>")
    def run(texts: pd.Series) -> pd.Series:
        def of(t: str) -> list[dict]:
            found = scan_text(t, role_globs, False)[0]
            return [{"placeholder": s["placeholder"], "hash": hashlib.sha256(t[s["start"] : s["end"]].encode()).hexdigest()} for s in found]

        return texts.map(lambda t: of(t) if isinstance(t, str) else [])

    return run(text)


def placed(placeholder: Column, whole: Column, part: Column) -> Column:
    """Whether a chunk of an unmasked text holds the value of a placeholder; ``whole`` and ``part`` are :func:`token_hashes` of both."""
    own = F.transform(F.filter(whole, lambda t: t["placeholder"] == placeholder), lambda t: t["hash"])
    return F.arrays_overlap(own, F.transform(part, lambda t: t["hash"]))


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), role_globs: tuple[str, ...] = ()) -> DataFrame:
    """One row a span, with the ``keep`` columns."""
    batches.bounded(docs.sparkSession)  # a stream's batch has a session of its own
    return docs.select(*keep, F.explode(scan(F.col(text), role_globs)["spans"]).alias("s")).select(*keep, "s.*")


def distinct_candidates(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """First occurrence of each numbered value; secrets are never merged, examples of credentials are none."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(*keys, "kind", "ord").orderBy("start"))
    return spans.where(F.col("ord").isNotNull()).withColumn("_nth", first).where("_nth = 1").drop("_nth")


def counters(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Occurrence-level counters of each document that has spans. Spans are counted by type first, which also tells kind and flags, so the scan
    runs once and a document has few rows after it."""
    kind, type_ = F.col("kind"), F.col("type")
    by = spans.groupBy(*keys, "kind", "type", "is_redaction", "is_example").agg(F.count(F.lit(1)).alias("_n"))
    counted = lambda test: F.sum(F.when(test, F.col("_n")).otherwise(0))
    pii = kind.isin("email", "phone") | type_.isin("url_internal", "url_public", "ip_private", "ip_public")
    personal = type_.isin("email_free_mail", "email_personal", "url_internal", "ip_private", "phone_personal")
    return by.groupBy(*keys).agg(
        counted(F.col("is_redaction")).alias("total"),
        counted((kind == "credential") & ~F.col("is_example")).alias("credentials"),
        counted(pii).alias("pii"),
        counted(personal).alias("pii_personal"),
        counted(type_.isin("email_role", "phone_support")).alias("pii_role"),
        counted(F.col("is_example")).alias("examples"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.col("_n"))))).alias("by_type"),
    )
