"""SQL that gives the rows of the queries that SQL can express, by the definitions and without the methods."""

from __future__ import annotations

from .queries import BAD_WORDS, URL_RULES
from .url_filter import STEPS, Z

# A document's multiset of five-word runs, all pairs that share a run, their weighted Jaccard similarity, and what can be reached over links.
NEAR_DEDUP = r"""
    WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS a FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(generate_series(1, len(a) - 4), lambda i: array_to_string(a[i : i + 4], ' '))
                                     WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [chr(1) || text] END) AS run FROM w),
    c AS (SELECT doc_id, run, count(*) AS n FROM s GROUP BY ALL),
    b AS (SELECT doc_id, sum(n) AS size, md5(string_agg(run || chr(2) || n, chr(3) ORDER BY run)) AS bag FROM c GROUP BY doc_id),
    k AS (SELECT doc_id, size, min(doc_id) OVER (PARTITION BY bag) AS node FROM b),
    o AS (SELECT c.doc_id, run, n, size FROM c JOIN k ON c.doc_id = k.node AND k.doc_id = k.node),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared, any_value(x.size + y.size) AS total FROM o x JOIN o y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p WHERE shared >= 0.8 * (total - shared) UNION ALL SELECT b, a FROM p WHERE shared >= 0.8 * (total - shared)),
    r AS (SELECT DISTINCT node AS a, node AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    t AS (SELECT a AS node, min(b) AS class_id FROM r GROUP BY a),
    f AS (SELECT k.doc_id, t.class_id FROM k JOIN t ON k.node = t.node)
    SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows, doc_id = class_id AS kept FROM f"""


def _shaped(s: str) -> str:
    stem = f"regexp_extract({s}, '^(.*?)(\\.[A-Za-z]{{1,5}})?$', 1)"
    fits = lambda p: f"regexp_full_match({stem}, '{p}')"
    digit, letter = f"regexp_matches({stem}, '[0-9]')", f"regexp_matches({stem}, '[A-Za-z]')"
    kind = f"CASE WHEN {fits('[0-9]+([-_.][0-9]+)*')} THEN '{{n}}' WHEN {fits('[0-9a-fA-F-]{8,}')} AND {digit} THEN '{{x}}' WHEN {fits('[A-Za-z0-9_-]{6,}')} AND {digit} AND {letter} THEN '{{id}}' END"
    return f"coalesce({kind} || substr({s}, length({stem}) + 1), {s})"


def _rule(what: int) -> str:
    """The longest fitting rule, or its verdict."""
    cases = []
    for rule in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule[1].partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{rule[what]}'")
    return "CASE " + " ".join(cases) + " END"


def url_filter(depth: int = 6, most_children: int = 16, rare: float = 8.0, weight: float = 1.0, reject: float = 0.7, least_words: int = 30) -> str:
    """The path-template tree, a group of tables for each level."""
    words = "|".join(BAD_WORDS)
    visible = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = "string_split(regexp_replace(path, '^/', ''), '/')"
    cut = f"CASE WHEN len({parts}) > {depth} THEN list_append(({parts})[1:{depth}], array_to_string(({parts})[{depth + 1}:], '/')) ELSE {parts} END"
    out = [
        "u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)",
        f"h AS (SELECT page_id, html, CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') END AS host, CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path FROM u)",
        f"l AS (SELECT page_id, host, path, {_rule(1)} AS rule, {_rule(0)} AS ruled, {visible} AS seen, list_transform({cut}, lambda s: {_shaped('s')}) AS raw FROM h)",
        f"m AS (SELECT *, coalesce(ruled = 'block', CASE WHEN regexp_matches(seen, '(?i)(^|[^\\p{{L}}])({words})([^\\p{{L}}]|$)') THEN true WHEN len(regexp_split_to_array(trim(seen, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) >= {least_words} THEN false END) AS bad FROM l)",
        "t0 AS (SELECT host, raw, count(*) AS n, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE NOT bad) AS good, '' AS template FROM m GROUP BY host, raw)",
    ]
    p, n = "bad / (bad + good)::DOUBLE", "(bad + good)"
    z2 = f"({Z} * {Z})"
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n}))"
    for i in range(depth + 1):
        child = f"raw[{i + 1}]"
        out += [
            f"c{i} AS (SELECT host, template, {child} AS child, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM t{i} WHERE len(raw) > {i} GROUP BY ALL)",
            f"k{i} AS (SELECT *, count(*) OVER v > {most_children} AND sum(n) OVER v / count(*) OVER v::DOUBLE < {rare} AS wild, CASE WHEN bad + good > 0 THEN round({p} * {STEPS}) END AS step FROM c{i} WINDOW v AS (PARTITION BY host, template))",
            f"s{i} AS (SELECT host, template, step, min({centre} - {half}) AS low, max({centre} + {half}) AS high, min(child) AS first, count(*) AS size FROM k{i} WHERE NOT wild AND bad + good > 0 GROUP BY ALL)",
            f"g{i} AS (SELECT *, sum(starts) OVER (PARTITION BY host, template ORDER BY step) AS branch FROM (SELECT *, CASE WHEN coalesce(lag(high) OVER (PARTITION BY host, template ORDER BY step) < low, true) THEN 1 ELSE 0 END AS starts FROM s{i}))",
            f"b{i} AS (SELECT host, template, step, min(first) OVER v || '~' || CAST(sum(size) OVER v AS BIGINT) AS name, sum(size) OVER v AS members FROM g{i} WINDOW v AS (PARTITION BY host, template, branch))",
            f"d{i} AS (SELECT k.host, k.template, child, CASE WHEN wild THEN '*' ELSE coalesce(b.name, child) END AS part FROM k{i} k LEFT JOIN b{i} b ON NOT k.wild AND k.host = b.host AND k.template = b.template AND k.step = b.step AND b.members > 1)",
            f"t{i + 1} AS (SELECT t.host, raw, n, bad, good, CASE WHEN len(raw) > {i} THEN t.template || '/' || part ELSE t.template END AS template FROM t{i} t LEFT JOIN d{i} d ON len(raw) > {i} AND t.host = d.host AND t.template = d.template AND {child} = d.child)",
        ]
    last = f"t{depth + 1}"
    out += [
        f"q AS (SELECT coalesce(sum(bad) / nullif(sum(bad) + sum(good), 0)::DOUBLE, 0.0) AS prior FROM {last})",
        f"e AS (SELECT host, template, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM {last} GROUP BY ALL)",
        f"o AS (SELECT host, (sum((bad + {weight} * prior) / (bad + good + {weight})) + any_value(prior)) / (count(*) + 1) AS host_purity FROM e, q GROUP BY host)",
        f"j AS (SELECT e.host, template, CAST(n AS BIGINT) AS template_urls, (bad + {weight} * host_purity) / (bad + good + {weight}) AS purity FROM e JOIN o ON e.host = o.host)",
    ]
    return (
        "WITH " + ",\n    ".join(out) + f" SELECT page_id, m.host, path, rule, coalesce(ruled, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(purity, 9) AS purity, template_urls "
        f"FROM m JOIN {last} t ON m.host = t.host AND m.raw = t.raw JOIN j ON t.host = j.host AND t.template = j.template"
    )


SQL: dict[str, str] = {"op2_url_filter": url_filter(), "op9_near_dedup": NEAR_DEDUP}
