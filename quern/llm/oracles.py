"""SQL for DuckDB with the results of operators that SQL can express, built from their parameters."""

from __future__ import annotations

import math

from quern.llm import licenses, secrets, urls

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lower(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_UPPER.lower()}')"


def secret_scan() -> str:
    parts = []
    for rank, k in enumerate(secrets.KINDS):
        mark = f"chr(1) || '\\0' || chr(2) || '\\{k.group}' || chr(1)"
        tests = [f"length(tested) BETWEEN {k.least} AND {k.most}"]
        tests += [f"regexp_matches(tested, '{c}')" for c in (("[0-9]", "[a-z]", "[A-Z]") if k.mixed else ("[0-9]",) if k.digit else ())]
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{k.name}' AS kind, '{k.role}' AS role, {str(k.strong).lower()} AS strong, stop - length(shown) AS a, stop AS z FROM ("
            f"SELECT *, sum(length(shown)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM ("
            f"SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN split_part(p, chr(2), 1) ELSE p END AS shown, CASE WHEN i % 2 = 0 THEN split_part(p, chr(2), 2) END AS tested FROM ("
            f"SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM ("
            f"SELECT doc_id, string_split(regexp_replace(clean, {_quoted(k.pattern)}, {mark}, 'g'), chr(1)) AS parts FROM texts WHERE regexp_matches(clean, {_quoted(k.pattern)}))))) "
            f"WHERE i % 2 = 0 AND {' AND '.join(tests)}")
    near = lambda role: (f"EXISTS (SELECT 1 FROM spans q WHERE q.doc_id = p.doc_id AND q.role = '{role}' AND q.z + {secrets.SCOPE} > p.a AND q.a - {secrets.SCOPE} < p.z)")
    base = "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank, z) FILTER (strong), '')"
    count = lambda kind: f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}"
    return (
        "WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS clean FROM documents), "
        f"spans AS MATERIALIZED ({' UNION ALL '.join(parts)}), "
        "kept AS (SELECT * FROM spans WHERE strong UNION ALL SELECT * FROM spans p WHERE NOT strong "
        "AND NOT EXISTS (SELECT 1 FROM spans q WHERE q.doc_id = p.doc_id AND q.strong AND q.z > p.a AND q.a < p.z) "
        f"AND CASE role WHEN 'secret' THEN {near('id')} WHEN 'id' THEN {near('secret')} ELSE {near('id')} AND {near('secret')} END) "
        f"SELECT d.doc_id, {count('assign')}, {count('access')}, {count('hex')}, sha256({base}) AS base_sha256, "
        "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank, z), '') AS spans, CAST(count(*) FILTER (NOT strong) AS BIGINT) AS n_linked "
        "FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id")


def license_scan() -> str:
    gap = _quoted("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    words = lambda text: f"[w FOR w IN string_split_regex({_lower(text)}, {gap}) IF w <> '']"
    places = " || ".join(
        f"[{{'k': i, 'label': '{label}'}} FOR i IN range(1, len(w) + 1) IF {' AND '.join(f'w[i + {j}] = {_quoted(p)}' for j, p in enumerate(phrase))}]"
        for label, phrase in licenses.PHRASES.items())
    values = []
    for label, notice in licenses.TEMPLATES:
        tokens = sorted(set(licenses.words_of(notice)))
        values.append(f"('{label}', [{', '.join(map(_quoted, tokens))}], {math.ceil(round(licenses.THRESHOLD * len(tokens), 9))}, {int(licenses.SPREAD * len(licenses.words_of(notice)))})")
    return (
        f"WITH templates(label, tokens, need, run) AS (VALUES {', '.join(values)}), "
        "texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
        f"split AS MATERIALIZED (SELECT doc_id, {words('text')} AS w, string_split_regex(text, '\\r\\n|[\\r\\n]') AS l FROM texts), "
        f"found AS (SELECT doc_id, len(w) AS n_words, {places} AS places FROM split), "
        "likely AS MATERIALIZED (SELECT doc_id, w, l, label, tokens, need, run FROM split JOIN templates ON len(list_intersect(list_distinct(w), tokens)) >= need), "
        "sets AS (SELECT doc_id, label, tokens, need, unnest([list_distinct(w[i : i + run - 1]) FOR i IN range(1, len(w) + 1) IF list_contains(tokens, w[i])]) AS s FROM likely "
        f"UNION ALL SELECT doc_id, label, tokens, need, list_distinct({words('b')}) FROM (SELECT doc_id, label, tokens, need, unnest(l) AS b FROM likely)), "
        "matched AS (SELECT doc_id, label, len(list_intersect(s, tokens)) / len(tokens) AS held FROM sets WHERE len(list_intersect(s, tokens)) >= need), "
        "best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(held) AS held FROM matched GROUP BY doc_id), "
        "named AS (SELECT *, list_distinct([p.label FOR p IN places]) AS base FROM found) "
        "SELECT n.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min([p.k FOR p IN places]) - 1 AS BIGINT) AS first_word, "
        "CAST(list_max([p.k FOR p IN places]) - 1 AS BIGINT) AS last_word, array_to_string(list_sort(base), ',') AS base_labels, "
        "array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(held, 0.0) END AS score "
        "FROM named n LEFT JOIN best b ON b.doc_id = n.doc_id")


def url_filter() -> str:
    rules = sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1:], r[0]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, h + p) for v, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, _, r in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits) + " END"
    margin = math.log(2 / urls.CONFIDENCE) / 2
    share = lambda level: (f"(SELECT host, template, (sum(bad) + {urls.PSEUDO} * min(share)) / (sum(good) + sum(bad) + {urls.PSEUDO}) AS own FROM {level} GROUP BY 1, 2)")
    steps = [f"s0 AS MATERIALIZED {share('l0')}"]
    for d in range(urls.DEPTH):
        here = f"(SELECT l.* EXCLUDE (share), own AS share FROM l{d} l JOIN s{d} s USING (host, template) WHERE len(form) > {d})"
        steps.append(f"h{d} AS MATERIALIZED {here}")
        steps.append(f"b{d} AS MATERIALIZED (SELECT host, template, form[{d + 1}] AS seg, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM h{d} GROUP BY 1, 2, 3)")
        steps.append(f"n{d} AS MATERIALIZED (SELECT host, template, count(*) AS branches, sum(n) AS all_n, sum(good) AS all_good, sum(bad) AS all_bad FROM b{d} GROUP BY 1, 2)")
        mine, other = "(good + bad)", "(all_good + all_bad - good - bad)"
        steps.append(
            f"m{d} AS MATERIALIZED (SELECT host, template, seg FROM b{d} JOIN n{d} USING (host, template) WHERE (branches > {urls.BRANCHES} AND branches > {urls.VARIETY} * all_n) OR "
            f"CASE WHEN least({mine}, {other}) >= {urls.LEAST_LABELLED} THEN abs(bad / {mine} - (all_bad - bad) / {other}) <= sqrt({margin} / {mine}) + sqrt({margin} / {other}) ELSE false END)")
        steps.append(
            f"l{d + 1} AS MATERIALIZED (SELECT l.host, l.form, l.n, l.good, l.bad, l.template || [CASE WHEN m.seg IS NULL THEN l.form[{d + 1}] ELSE '*' END] AS template, l.share "
            f"FROM h{d} l LEFT JOIN m{d} m ON m.host = l.host AND m.template = l.template AND m.seg = l.form[{d + 1}])")
        steps.append(f"s{d + 1} AS MATERIALIZED {share(f'l{d + 1}')}")
    ends = " UNION ALL ".join(f"SELECT host, form, template, own AS bad_share FROM l{d} JOIN s{d} USING (host, template) WHERE len(form) = {d}" for d in range(1, urls.DEPTH + 1))
    form = "string_split(regexp_replace(regexp_replace(regexp_replace(path, '[0-9a-fA-F]{16,}', '{x}', 'g'), '[0-9]+', '{n}', 'g'), '^/', ''), '/')"
    deep = f"CASE WHEN len(f) <= {urls.DEPTH} THEN f ELSE f[1 : {urls.DEPTH - 1}] || [array_to_string(f[{urls.DEPTH} : len(f)], '/')] END"
    return (
        f"WITH split AS (SELECT page_id, {_lower(chr(34) + 'h' + chr(34))} AS host, path FROM (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS h, "
        "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)), "
        f"ruled AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled, {deep} AS form FROM (SELECT *, {form} AS f FROM split)), "
        "l0 AS MATERIALIZED (SELECT host, form, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad, CAST([] AS VARCHAR[]) AS template, CAST(" + str(urls.PRIOR) + " AS DOUBLE) AS share FROM ruled GROUP BY 1, 2), "
        + ", ".join(steps)
        + f", ends AS MATERIALIZED ({ends}) "
        f"SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN bad_share >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(l.template, '/') AS template, "
        "bad_share FROM ruled r JOIN ends l ON l.host = r.host AND l.form = r.form")


def near_duplicates(size: int = 3, percent: int = 85) -> str:
    """All pairs that share a shingle, and the closure of their links."""
    words = f"[w FOR w IN string_split_regex({_lower('text')}, '[\\x20\\x09-\\x0D]+') IF w <> '']"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return (
        f"WITH RECURSIVE words AS (SELECT doc_id, {words} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), "
        f"sets AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {size} THEN [{shingle} FOR i IN range(1, len(w) - {size - 2})] "
        "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words), "
        "sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1), "
        "pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2), "
        f"links AS MATERIALIZED (SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= {percent} * (x.n + y.n - p.n)), "
        "edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), "
        "reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other) "
        "SELECT r.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept "
        "FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id")


ORACLE_SQL = {"op2_secret_scan": secret_scan(), "op10_license_scan": license_scan(), "op4_url_filter": url_filter(), "op6_minhash_near_dedup": near_duplicates()}
