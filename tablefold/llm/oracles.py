"""SQL for DuckDB that gives the rows of queries of this package, where SQL can express them."""

from __future__ import annotations

from . import license_scan, quality_rules, secret_scan, source_mixing

WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1:p + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS p FROM w)),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM windows JOIN firsts USING (h) WHERE least < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1:p + 5], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS p FROM w WHERE len(ws) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS d FROM grams GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, y.d AS d, x.d <> y.d AS other FROM meets JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 10 * meets.n >= 8 * (x.n + y.n - meets.n)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, root FROM reach JOIN links ON a = doc_id),
classes AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
copies AS (SELECT d, min(doc_id) AS copy_of, count(*) AS n_copies FROM sets GROUP BY d),
counts AS (SELECT a, count(*) AS n_links, count(DISTINCT CASE WHEN other THEN d END) AS n_text_links FROM links GROUP BY a)
SELECT w.doc_id, class_id, coalesce(copy_of, w.doc_id) AS copy_of, coalesce(n_copies, 1) AS n_copies, coalesce(n_text_links, 0) AS n_text_links, coalesce(n_links, 0) AS n_links
FROM w JOIN classes USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN copies USING (d) LEFT JOIN counts ON a = w.doc_id
"""


def quality_rules_sql(rules: dict[str, tuple[str, str]] = quality_rules.RULES, rounds: int = 50) -> str:
    n = len(rules)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in rules.values())
    part = lambda v, good, bad: f"list_product(list_transform(range(1, {n + 1}), lambda j: CASE {v}[j] WHEN 1 THEN {good} WHEN -1 THEN {bad} ELSE 1::DOUBLE END))"
    good = lambda v: f"(prior * {part(v, 'keeps[j]', '1 - keeps[j]')})"
    bad = lambda v: f"((1 - prior) * {part(v, '1 - finds[j]', 'finds[j]')})"
    q = lambda v: f"({good(v)} / ({good(v)} + {bad(v)}))"
    total = lambda x: f"list_sum(list_transform(w, lambda x: {x}))"

    inside = lambda x: f"least({1 - 1e-6}::DOUBLE, greatest(1e-6::DOUBLE, {x}))"
    start_keeps, start_finds, start_good, weight = quality_rules.KEEPS, quality_rules.FINDS, quality_rules.GOOD, quality_rules.WEIGHT / 100

    def accuracy(start: float, share: str, vote: int) -> str:
        said = total(f"x.n * {share} * CASE WHEN x.v[j] = {vote} THEN 1 ELSE 0 END")
        cast = total(f"x.n * {share} * abs(x.v[j])")
        return f"list_transform(range(1, {n + 1}), lambda j: {inside(f'(m * {start} + {said}) / (m + {cast})')})"

    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
windows AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + 8], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 7)) AS p FROM t)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(p, p + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM windows) WHERE c > 1) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_doubled,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS n_marks
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM t) LEFT JOIN repeats r USING (doc_id)),
voted AS (SELECT *, [{votes}] AS v FROM counted),
patterns AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS p, 1 + sum(n) * {weight}::DOUBLE AS m FROM (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v)),
em AS (
  SELECT 0 AS i, {start_good}::DOUBLE AS prior, list_transform(range({n}), lambda x: {start_keeps}::DOUBLE) AS keeps, list_transform(range({n}), lambda x: {start_finds}::DOUBLE) AS finds
  UNION ALL
  SELECT i + 1, {inside(f"(m * {start_good} + {total('x.n * x.q')}) / (m + {total('x.n')})")}, {accuracy(start_keeps, "x.q", 1)}, {accuracy(start_finds, "(1 - x.q)", -1)}
  FROM (SELECT em.*, m, list_transform(p, lambda x: {{'v': x.v, 'n': x.n, 'q': {q("x.v")}}}) AS w FROM em, patterns WHERE i < {rounds})),
judged AS (SELECT voted.*, {q("v")} AS posterior, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM voted, em WHERE i = {rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept FROM judged
"""


def license_scan_sql(k: int = 3, drift: int = 2, gap: int = 12, share: float = 0.8, extra: float = 0.3) -> str:
    rows, run = [], license_scan.PHRASE_RUN
    named = [(t, label, False) for t, label in license_scan.TEMPLATES.items()] + [(t, label, True) for t, label in license_scan.BASE_PHRASES.items()]
    for number, (text, label, base) in enumerate(named):
        words, length = text.split(), run if base else k
        rows += [f"('{' '.join(words[i : i + length])}', {number}, {i}, {len(words) - length + 1}, {len(words)}, '{label}', {str(base).lower()})" for i in range(len(words) - length + 1)]
    labels = lambda c: f"array_to_string(list_sort(list_distinct({c})), ',')"
    whose = "doc_id, template, label, size, span"
    return rf"""
WITH templates(gram, template, tpos, n_grams, size, label, base) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {run - 1})) AS p FROM w),
hits AS (SELECT doc_id, p, t.* FROM (SELECT doc_id, p, unnest([array_to_string(ws[p + 1:p + {run}], ' '), CASE WHEN p + {k} <= len(ws) THEN array_to_string(ws[p + 1:p + {k}], ' ') END]) AS gram FROM places) JOIN templates t USING (gram)),
phrases AS (SELECT doc_id, label, min(p) AS s FROM hits WHERE base GROUP BY doc_id, template, label, n_grams, p - tpos HAVING count(*) = n_grams),
diagonals AS (SELECT doc_id, template, p - tpos AS d, min(p) AS s, max(p) AS l FROM hits WHERE NOT base GROUP BY ALL),
near AS (SELECT *, CASE WHEN d - lag(d) OVER o <= {drift} AND greatest(s, lag(s) OVER o) - least(l, lag(l) OVER o) <= {gap + k} THEN 0 ELSE 1 END AS new
            FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY d)),
merged AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY d) AS span FROM near),
chained AS (SELECT h.*, m.span, count(*) FILTER (tpos = 0) OVER (PARTITION BY h.doc_id, h.template, m.span ORDER BY p, tpos) AS chain
            FROM hits h JOIN merged m ON h.doc_id = m.doc_id AND h.template = m.template AND h.p - h.tpos = m.d WHERE NOT base),
-- the template's words that the chain's steps hold, as a set
steps AS (SELECT *, tpos > coalesce(max(tpos) OVER (PARTITION BY {whose}, chain ORDER BY p, tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS on_way FROM chained),
held AS (SELECT {whose}, chain, min(p) AS s, max(p) + {k} AS e, len(list_distinct(flatten(list([tpos + x FOR x IN range({k})])))) AS words FROM steps WHERE on_way GROUP BY ALL),
spans AS (SELECT doc_id, label, words / size AS share FROM held WHERE words / size >= {share} AND e - s - words <= size * {extra}),
base AS (SELECT doc_id, count(*) AS n, min(s) AS first_word, max(s) AS last_word, list(label) AS b FROM phrases GROUP BY doc_id),
more AS (SELECT doc_id, list(label) AS l, max(share) AS best FROM spans GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce({labels("b")}, '') AS base_labels, coalesce({labels("list_concat(coalesce(b, []), coalesce(l, []))")}, '') AS labels,
       (CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END)::DOUBLE AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN more ON more.doc_id = w.doc_id
"""


def secret_scan_sql(scope: int = 200) -> str:
    """Every match by its place, parts linked by a plain comparison of all parts of a text.

    DuckDB's patterns have no look-around: an address is a whole run of digits and
    dots, and its port is read behind it.
    """
    kinds = secret_scan.STRONG | secret_scan.WEAK
    runs = kinds["endpoint"][0].split("|(?<!")[0] + "|[0-9.]+"
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        pattern = (runs if kind == "endpoint" else pattern).replace("'", "''")
        holds = "".join(f" AND regexp_matches(hit, '{x}')" for x in secret_scan.HOLDS.get(kind, ()))
        address = " AND (hit LIKE '%://%' OR regexp_full_match(hit, '([0-9]{1,3}[.]){3}[0-9]{1,3}'))" if kind == "endpoint" else ""
        port = "CASE WHEN hit LIKE '%://%' THEN 0 ELSE length(regexp_extract(substr(text, e + 1, 6), '^:[0-9]{2,5}')) END" if kind == "endpoint" else "0"
        found.append(f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, s, e + {port} AS e FROM (
      SELECT doc_id, text, hit, part, (sum(length(gap) + length(hit)) OVER w - length(hit))::BIGINT AS s, (sum(length(gap) + length(hit)) OVER w)::BIGINT AS e
      FROM (SELECT doc_id, text, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[1:len(hits)]) AS gap
            FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS parts, string_split_regex(text, '{pattern}') AS gaps FROM t))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE length(part) >= {least}{holds}{address}""")
    secrets = ", ".join(f"'{k}'" for k in secret_scan.SECRETS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(found)}),
linked AS (SELECT a.* FROM spans a WHERE a.r >= {len(secret_scan.STRONG)} AND EXISTS (
  SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND (a.kind IN ({secrets})) <> (b.kind IN ({secrets}))
  AND greatest(a.s, b.s) - least(a.e, b.e) BETWEEN 0 AND {scope})),
base AS (SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex, {joined} AS b
         FROM spans WHERE r < {len(secret_scan.STRONG)} GROUP BY doc_id),
every AS (SELECT doc_id, {joined} AS x FROM (SELECT * FROM spans WHERE r < {len(secret_scan.STRONG)} UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM t LEFT JOIN base ON base.doc_id = t.doc_id LEFT JOIN every ON every.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": source_mixing.ORACLE_SQL,
        "op2_quality_rules": quality_rules_sql(),
        "op4_license_scan": license_scan_sql(),
        "op5_substring_dedup": SUBSTRING_DEDUP,
        "op7_ngram_join": NGRAM_JOIN,
        "op10_secret_scan": secret_scan_sql(),
    }
