"""SQL twins for DuckDB, written as brute force: every block against every template, every page against every rule."""

from __future__ import annotations

import math
import re

from txnwatch.llm import licenses, manifest, urls

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{licenses._UPPER}', '{licenses._LOWER}')"


def license_scan(templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float) -> str:
    """All places of the phrases, and all pairs of blocks and templates."""
    listed = []
    for label, text in templates:
        own = sorted({w for w in re.split(licenses._APART, text.lower()) if w})
        listed.append(f"({_text(label)}, [{', '.join(map(_text, own))}], {math.ceil(threshold * len(own) - 1e-9)})")
    places, names = [], []
    for phrase, label in phrases.items():
        words = phrase.split()
        test = " AND ".join(f"words[i + {k}] = {_text(w)}" for k, w in enumerate(words))
        places.append(f"[x - 1 FOR x IN [i FOR i IN range(1, len(words) + 1) IF {test}]]")
        names.append(f"CASE WHEN len([i FOR i IN range(1, len(words) + 1) IF {test}]) > 0 THEN {_text(label)} END")
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_lowered('text')} AS low FROM documents),
w AS (SELECT *, regexp_extract_all(low, '{_WORD}') AS words FROM d),
p AS (SELECT doc_id, r, len(words) AS n_words, list_concat({', '.join(places)}) AS starts,
 list_sort(list_distinct([x FOR x IN [{', '.join(names)}] IF x IS NOT NULL])) AS base FROM w),
t AS (SELECT * FROM (VALUES {', '.join(listed)}) AS v(label, own, need)),
b AS (SELECT r, unnest(regexp_split_to_array(low, '\\n|[.;!?]\\s+')) AS block FROM d),
h AS (SELECT r, list_distinct(regexp_extract_all(block, '{_WORD}')) AS held FROM b),
m AS (SELECT r, label, max(len(list_intersect(own, held)) / CAST(len(own) AS DOUBLE)) AS share FROM h, t WHERE len(list_intersect(own, held)) >= need GROUP BY ALL),
f AS (SELECT r, list(label) AS found, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
 array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
 CASE WHEN len(starts) > 0 THEN 1e0 ELSE coalesce(share, 0e0) END AS score FROM p LEFT JOIN f USING (r)"""


def url_verdicts(rules: list[urls.Rule]) -> str:
    """The tree level by level. A segment is typed by whole-segment patterns; the last one may end in a file type."""
    listed = ", ".join(f"({_text(r.verdict)}, {_text(r.host)}, {_text(r.path)})" for r in rules)
    typed = r"""CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?') THEN '{date}' WHEN regexp_matches(s, '^[0-9]+(\.|$)') THEN regexp_replace(s, '^[0-9]+', '{n}')
 WHEN regexp_matches(s, '^[0-9a-fA-F-]{8,}(\.|$)') AND regexp_matches(regexp_extract(s, '^[0-9a-fA-F-]+'), '[0-9]') THEN regexp_replace(s, '^[0-9a-fA-F-]+', '{hash}') ELSE s END"""
    levels = []
    for n in range(urls.DEPTH):
        levels.append(f"""c{n} AS (SELECT host, template, segments[{n + 1}] AS child, sum(pages) AS pages FROM g{n} WHERE len(segments) > {n} GROUP BY ALL),
v{n} AS (SELECT host, template FROM c{n} GROUP BY ALL HAVING count(*) >= {urls.CHILDREN} AND sum(pages) < {urls.PAGES_PER_CHILD} * count(*)),
g{n + 1} AS (SELECT g.* REPLACE (CASE WHEN len(segments) <= {n} THEN g.template WHEN v.host IS NOT NULL THEN list_append(g.template, '*') ELSE list_append(g.template, segments[{n + 1}]) END AS template)
 FROM g{n} g LEFT JOIN v{n} v ON g.host = v.host AND g.template = v.template)""")
    return f"""WITH a AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, r, {_lowered("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
l AS (SELECT * FROM (VALUES {listed}) AS v(verdict, rule_host, rule_path)),
k AS (SELECT r, arg_max({{'rule': rule_host || rule_path, 'verdict': verdict}}, len(rule_host || rule_path) * 1000 + len(rule_host)) AS told
 FROM u JOIN l ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
s AS (SELECT u.*, told.rule AS rule, told.verdict AS told, [{typed} FOR s IN string_split(regexp_replace(path, '^/', ''), '/')] AS every FROM u LEFT JOIN k USING (r)),
q AS (SELECT *, CASE WHEN len(every) > {urls.DEPTH} THEN list_append(every[:{urls.DEPTH - 1}], '**') ELSE every END AS segments FROM s),
g0 AS (SELECT host, segments, CAST([] AS VARCHAR[]) AS template, count(*) AS pages, count(told) AS labelled, count(*) FILTER (WHERE told = 'block') AS blocked FROM q GROUP BY ALL),
{', '.join(levels)},
leaf AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked FROM g{urls.DEPTH} GROUP BY ALL),
hs AS (SELECT host, (sum(blocked) + {urls.HOST_PRIOR} * coalesce((SELECT sum(blocked) / nullif(sum(labelled), 0) FROM leaf), 0)) / (sum(labelled) + {urls.HOST_PRIOR}) AS host_share FROM leaf GROUP BY host),
kn AS (SELECT *, (blocked + {urls.TEMPLATE_PRIOR} * host_share) / (labelled + {urls.TEMPLATE_PRIOR}) AS share, template[:len(template) - 1] AS parent FROM leaf JOIN hs USING (host)),
lg AS (SELECT *, lag(share) OVER o AS p, lag(labelled) OVER o AS n FROM kn WINDOW o AS (PARTITION BY host, parent ORDER BY share, template)),
br AS (SELECT *, sum(CASE WHEN p IS NULL OR share - p > {urls.APART} * sqrt(share * (1 - share) / (labelled + {urls.TEMPLATE_PRIOR}) + p * (1 - p) / (n + {urls.TEMPLATE_PRIOR})) THEN 1 ELSE 0 END)
 OVER (PARTITION BY host, parent ORDER BY share, template ROWS UNBOUNDED PRECEDING) AS branch FROM lg),
pu AS (SELECT host, template, (sum(blocked) OVER e + {urls.TEMPLATE_PRIOR} * host_share) / (sum(labelled) OVER e + {urls.TEMPLATE_PRIOR}) AS purity FROM br WINDOW e AS (PARTITION BY host, parent, branch)),
vd AS (SELECT g.host, g.segments, round(purity, 9) >= {urls.REJECT} AS rejected FROM g{urls.DEPTH} g JOIN pu ON g.host = pu.host AND g.template = pu.template)
SELECT page_id, q.host, q.path, q.rule, coalesce(q.told, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM q JOIN vd ON q.host = vd.host AND q.segments = vd.segments"""


def _joined_runs(leaves: str, top: str, levels: int) -> str:
    """CTEs ``{top}0`` to ``{top}{levels}``: the levels of all trees; a tree with one node left stays as it is."""
    k = manifest.FANOUT
    parts = [f"{top}0 AS (SELECT tree, pos, n, h FROM {leaves})"]
    for i in range(levels):
        parts.append(f"""{top}{i + 1} AS (SELECT tree, pos // {k} AS pos, (n + {k - 1}) // {k} AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
 FROM {top}{i} GROUP BY tree, pos // {k}, n)""")
    for i in range(levels):
        o = f"PARTITION BY tree, pos // {k} ORDER BY pos ROWS BETWEEN"
        parts.append(f"""{top}s{i} AS (SELECT tree, pos, coalesce(string_agg(h, '') OVER ({o} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
 coalesce(string_agg(h, '') OVER ({o} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {top}{i} WHERE n > 1)""")
    return ",\n".join(parts)


def _folds(rows: str, top: str, levels: int, name: str) -> str:
    """CTEs that lead ``rows`` (tree, pos, f, proof, ...) up through the levels."""
    parts, k = [f"{name}0 AS (SELECT * FROM {rows})"], manifest.FANOUT
    for i in range(levels):
        parts.append(f"""{name}{i + 1} AS (SELECT d.* REPLACE (CASE WHEN s.l IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f, proof || coalesce(s.l || s.r, '') AS proof)
 FROM {name}{i} d LEFT JOIN {top}s{i} s ON d.tree = s.tree AND d.pos // {k ** i} = s.pos)""")
    return ",\n".join(parts)


def manifest_proofs(fields: tuple[str, ...], levels: int = 16, source_levels: int = 10) -> str:
    """Every level of every tree, and every leaf led up to the root. Enough for 3^levels leaves a source and 3^source_levels sources."""
    def leaf(text: str) -> str:
        said = [f"CAST({c} AS VARCHAR)" if c != "text" else text for c in fields]
        return f"sha256({' || '.join(f"CASE WHEN {s} IS NULL THEN '-' ELSE CAST(strlen({s}) AS VARCHAR) || ':' || {s} END" for s in said)})"
    bits = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"
    own = "[CAST(ord(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {own}), lambda a, b: {bits}), 4294967295::UBIGINT)"
    return f"""WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS given FROM documents),
q AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
 count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM d),
{_joined_runs('q', 't', levels)},
sub AS (SELECT tree, h AS subroot FROM t{levels}),
o AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, subroot AS h FROM sub),
{_joined_runs('o', 'u', source_levels)},
g AS (SELECT doc_id, leaf, tree, pos, given AS f, '' AS proof FROM q),
{_folds('g', 't', levels, 'f')},
w AS (SELECT doc_id, leaf, subroot, 0 AS tree, f.tree AS pos, f, proof FROM f{levels} f JOIN sub ON f.tree = sub.tree),
{_folds('w', 'u', source_levels, 'e')}
SELECT doc_id, leaf, subroot, (SELECT h FROM u{source_levels}) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT h FROM u{source_levels}) AS verified FROM e{source_levels}"""
