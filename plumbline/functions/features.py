"""Features of e-mail addresses, IPv4 addresses, URLs and paths as native column expressions."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression that Java understands."""
    return re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"(?s)^(?:\1)$", fnmatch.translate(pattern)).replace("(?>", "(?:")


def email_domain_type(address: Column) -> Column:
    return F.when(F.lower(F.split_part(address, F.lit("@"), F.lit(2))).isin(V.FREE_MAIL), "free_mail").otherwise("corporate")


def email_shape(address: Column) -> Column:
    local = F.split_part(address, F.lit("@"), F.lit(1))
    return F.when(local.contains("."), "dotted_name").when(local.contains("-"), "hyphenated").when(
        F.replace(local, F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$"), "single_word"
    ).otherwise("other")


def email_role(address: Column, globs: tuple[str, ...] = ()) -> Column:
    local = F.lower(F.split_part(address, F.lit("@"), F.lit(1)))
    return local.isin(V.ROLE_WORDS) | any_of(
        [local.startswith(a) | local.endswith(a) for a in V.ROLE_AFFIXES]
    ) | any_of([local.rlike(glob_regex(g.lower())) for g in globs])


def ipv4_type(address: Column) -> Column:
    """documentation, loopback, private or public; null if an octet is over 255. Ranges are explicit, so no library version matters."""
    octets = F.transform(F.split(address, r"\."), lambda o: o.cast("long"))
    n = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    within = lambda first, bits: F.shiftright(n, 32 - bits) == (
        sum(int(o) << s for o, s in zip(first.split("."), (24, 16, 8, 0), strict=True)) >> (32 - bits)
    )
    private = ["0.0.0.0/8", "10.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "240.0.0.0/4"]
    return (
        F.when(~F.forall(octets, lambda o: o <= 255), F.lit(None))
        .when(any_of([within(p + "0", 24) for p in V.DOCUMENTATION_V4]), "documentation")
        .when(within("127.0.0.0", 8), "loopback")
        .when(any_of([within(p.split("/")[0], int(p.split("/")[1])) for p in private]), "private")
        .otherwise("public")
    )


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def url_suffix(host: Column) -> Column:
    return F.coalesce(*[F.when(host.endswith(e), F.lit(e)) for e in [*V.INTERNAL_ENDINGS, *V.EXAMPLE_ENDINGS]])


def url_is_example(host: Column) -> Column:
    documented = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    kind = F.when(documented, ipv4_type(F.when(documented, host)))
    return host.isin(V.EXAMPLE_DOMAINS) | any_of([host.endswith(e) for e in V.EXAMPLE_ENDINGS]) | host.startswith("example.") | host.startswith("api.example.") | F.coalesce(
        kind.isin("loopback", "documentation"), F.lit(False)
    )


def url_is_internal(host: Column) -> Column:
    return any_of([host.endswith(e) for e in V.INTERNAL_ENDINGS])


def url_is_public_common(host: Column) -> Column:
    return (host == "github.com") | host.endswith(".github.com")


def path_excluded(path: Column, patterns: list[str], root: str = "") -> Column:
    """Exclude patterns fit the base name, the path, /path, or a directory above it."""
    base = F.element_at(F.split(path, "/"), -1)
    tests = []
    for p in patterns:
        for form in (p, p.rstrip("/") + "/*", "*/" + p.rstrip("/") + "/*"):
            rx = glob_regex(form)
            tests += [base.rlike(rx), path.rlike(rx), F.concat(F.lit("/"), path).rlike(rx)]
        tests.append(path.startswith(p.rstrip("/") + "/"))
    return any_of(tests)


def default_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in V.IGNORED_PARTS]))


def normalised_path(path: Column) -> Column:
    """Leading dots and slashes go, character by character."""
    return F.regexp_replace(path, r"^[./]+", "")


def document_type(path: Column, default: str = "generic") -> Column:
    p = F.lower(path)
    has = lambda *parts: any_of([p.contains(x) for x in parts])
    return F.when(has("design_doc", "designdoc"), "design_doc").when(
        has("pr_description", "prdescription"), "pr_description"
    ).when(has("article", "zenn"), "article").otherwise(default)
