"""DuckDB SQL for the queries, written apart from their Spark code."""

from __future__ import annotations

from hushgrain.functions.generalise import CITY_COUNTRY, COUNTRY_CONTINENT, DEM_BROADER
from hushgrain.functions.labels import CONLL, ONTONOTES, PRESIDIO
from hushgrain.plans.casefiles import CASES_SQL
from hushgrain.plans.wordfiles import WORDS_SQL

SQL: dict[str, str] = {}


def _map(values: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _cases(body: str) -> str:
    """body: further tables and the query, after the case tables."""
    return "WITH RECURSIVE " + CASES_SQL + body


# Recognisers. RE2's classes are ASCII; the tables' digits and addresses are, too.
_PATTERNS = (
    (r"\b(?:Application|App\.?|Case)\s+[Nn]o\.?\s*\d{1,7}/\d{2,4}\b", "CODE"),
    (r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{4}\b", "CODE"),
    (r"\b[A-Z]{2}\d{2}[\s\-]?(?:[A-Z0-9]{4}[\s\-]?){2,7}[A-Z0-9]{1,4}\b", "CODE"),
    (r"\b[\w._%+\-]+@[\w.\-]+\.[A-Za-z]{2,}\b", "MISC"),
    (r"(?:\+\d{1,3}\s?)?(?:\(\d{1,4}\)\s?|\d{1,4}[\s\-]?)\d{3,4}[\s\-]?\d{3,4}\b", "MISC"),
)


def _spans(table: str, key: str, text: str, more: str = "0") -> str:
    """Tables up to `found`(row, doc_id, s, e, kind, txt): matches by pattern, then by precedence."""
    out = f"WITH src AS (SELECT row_number() OVER () AS row, {more} AS more, {key} AS doc_id, replace({text}, chr(1), chr(2)) AS t FROM {table})"
    kept = []
    for i, (pattern, kind) in enumerate(_PATTERNS):
        out += f""",
p{i} AS (SELECT row, doc_id, unnest(string_split(m, chr(1))) AS part, generate_subscripts(string_split(m, chr(1)), 1) AS i
  FROM (SELECT row, doc_id, regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g') AS m FROM src) WHERE contains(m, chr(1))),
a{i} AS (SELECT * FROM (
  SELECT row, doc_id, i, part AS txt, CAST(sum(length(part)) OVER (PARTITION BY row ORDER BY i) AS INTEGER) AS e FROM p{i}) WHERE i % 2 = 0),
k{i} AS (SELECT row, doc_id, CAST(e - length(txt) AS INTEGER) AS s, e, '{kind}' AS kind, txt FROM a{i} x"""
        if kept:
            before = " UNION ALL ".join(f"SELECT row, s, e FROM {k}" for k in kept)
            out += f" WHERE NOT EXISTS (SELECT 1 FROM ({before}) y WHERE y.row = x.row AND y.s < x.e AND y.e > x.e - length(x.txt))"
        out += ")"
        kept.append(f"k{i}")
    return out + ",\nfound AS (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in kept) + ")\n"


_SHOW = "SELECT doc_id, s AS start, e AS \"end\", kind AS entity_type, txt AS text, 'regex' AS source FROM found"
SQL["detect_spans_documents"] = _spans("documents", "doc_id", "text") + _SHOW
SQL["detect_spans_pages"] = _spans("pages", "page_id", "html") + _SHOW
SQL["detect_spans_conversations"] = _spans("conversations", "conv_id", "text", "turn") + _SHOW.replace("SELECT doc_id", "SELECT src.doc_id AS conv_id, src.more AS turn").replace("FROM found", "FROM found JOIN src USING (row)")
SQL["span_type_counts"] = _spans("documents", "doc_id", "text") + "SELECT kind AS entity_type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY 1"
SQL["redact_contacts"] = (
    _spans("documents", "doc_id", "text")
    + """, cut AS (
  SELECT row, s, e, kind, coalesce(lag(e) OVER (PARTITION BY row ORDER BY s), 0) AS before, row_number() OVER (PARTITION BY row ORDER BY s DESC) AS from_end FROM found),
made AS (
  SELECT c.row, count(*) AS n, string_agg(substr(t, before + 1, s - before) || '[' || kind || ']' || CASE WHEN from_end = 1 THEN substr(t, e + 1) ELSE '' END, '' ORDER BY s) AS text
  FROM cut c JOIN src ON src.row = c.row GROUP BY c.row)
SELECT doc_id, coalesce(n, 0) AS n_spans, coalesce(made.text, t) AS redacted_text FROM src LEFT JOIN made ON made.row = src.row"""
)
_ROLE = "CASE WHEN kind IN ('DATETIME', 'LOC', 'DEM', 'QUANTITY') THEN 'QUASI' ELSE 'DIRECT' END"
SQL["role_counts"] = _cases(f" SELECT kind AS entity_type, {_ROLE} AS role, count(*) AS n FROM ann GROUP BY 1, 2")
_LABELS = sorted({*ONTONOTES, *CONLL, *PRESIDIO, "UNKNOWN"})
SQL["label_mapping"] = (
    f"SELECT label, {_map(ONTONOTES, 'label')} AS ontonotes, {_map(CONLL, 'label')} AS conll, {_map(PRESIDIO, 'label')} AS presidio FROM (VALUES "
    + ", ".join(f"('{x}')" for x in _LABELS)
    + ") t(label)"
)


# Ladders
_KEY = r"regexp_replace(lower(trim(txt)), '[.,;:]+$', '')"
_YEAR = r"regexp_extract(txt, '\b(1\d{3}|20\d{2}|21\d{2})\b', 1)"
_NUM = r"CAST(trunc(CAST(nullif(replace(regexp_extract(txt, '-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?', 0), ',', ''), '') AS DOUBLE)) AS BIGINT)"
_AGE = f"({_NUM} BETWEEN 0 AND 120 AND (contains(lower(txt), 'year') OR contains(lower(txt), 'old')))"


def _floor(to: int) -> str:
    return f"CAST(floor({_NUM} / {to}.0) * {to} AS BIGINT)"


def _level(level: int) -> str:
    """The value of (kind, txt) at a level."""
    if level == 0:
        return "txt"
    if level == 3:
        return "'[' || kind || ']'"
    if level == 1:
        date, loc, dem = _YEAR, f"coalesce({_map(CITY_COUNTRY, _KEY)}, '[LOC]')", f"coalesce({_map(DEM_BROADER, _KEY)}, '[DEM]')"
        number = (
            f"CASE WHEN {_NUM} IS NULL THEN '[QUANTITY]' WHEN {_AGE} THEN 'about ' || {_floor(10)} WHEN {_NUM} >= 1000000 THEN 'about ' || format('{{:,}}', {_floor(1000000)}) "
            f"WHEN {_NUM} >= 1000 THEN 'about ' || format('{{:,}}', {_floor(1000)}) WHEN {_NUM} >= 100 THEN 'about ' || {_floor(100)} ELSE 'about ' || {_floor(10)} END"
        )
    else:
        date, dem = f"left({_YEAR}, 3) || '0s'", "'[DEM]'"
        loc = f"coalesce({_map(COUNTRY_CONTINENT, _map(CITY_COUNTRY, _KEY))}, '[LOC]')"
        number = f"CASE WHEN NOT coalesce({_AGE}, FALSE) THEN '[QUANTITY]' WHEN {_floor(10)} >= 20 THEN 'in their ' || {_floor(10)} || 's' ELSE 'under ' || ({_floor(10)} + 10) END"
    return f"CASE kind WHEN 'DATETIME' THEN CASE WHEN {_YEAR} = '' THEN '[DATETIME]' ELSE {date} END WHEN 'QUANTITY' THEN {number} WHEN 'LOC' THEN {loc} WHEN 'DEM' THEN {dem} ELSE '[' || kind || ']' END"


for _name, _kind in (("dates", "DATETIME"), ("quantities", "QUANTITY"), ("locations", "LOC"), ("demographics", "DEM")):
    SQL[f"generalise_{_name}"] = _cases(f" SELECT txt AS text, count(*) AS n, {_level(1)} AS level1, {_level(2)} AS level2, {_level(3)} AS level3 FROM men WHERE kind = '{_kind}' GROUP BY kind, txt")

# Punctuation by class: letters of any script stay, as in the values of these tables.
_PLAIN = r"trim(regexp_replace(regexp_replace({}, '[^\pL\pN_\s{}]+', ' ', 'g'), '\s+', ' ', 'g'))"
_AGED = r"regexp_extract(lower(txt), '\b(\d{1,3})\s*[- ]?\s*years?[- ]?old\b', 1)"
_NORMAL = (
    f"CASE WHEN kind = 'DATETIME' AND regexp_extract(txt, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1) <> '' THEN regexp_extract(txt, '\\b(1[5-9]\\d{{2}}|20\\d{{2}})\\b', 1) "
    f"WHEN kind = 'QUANTITY' AND {_AGED} <> '' THEN 'age:' || CAST({_AGED} AS INTEGER) WHEN kind = 'QUANTITY' THEN {_PLAIN.format('lower(txt)', '.')} ELSE {_PLAIN.format('lower(txt)', '')} END"
)
SQL["normalise_facts"] = _cases(f" SELECT DISTINCT kind AS entity_type, txt AS span_text, {_NORMAL} AS value FROM ann")
SQL["token_letters"] = """WITH n AS (SELECT c_custkey AS k, c_custkey AS i FROM customer)
SELECT k, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER))
  WHEN i < 702 THEN chr(CAST(65 + (i - 26) // 26 AS INTEGER)) || chr(CAST(65 + (i - 26) % 26 AS INTEGER))
  ELSE chr(CAST(65 + (i - 702) // 676 AS INTEGER)) || chr(CAST(65 + (i - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (i - 702) % 26 AS INTEGER)) END AS letters FROM n"""
SQL["bare_names"] = _cases(" SELECT DISTINCT txt AS span_text, regexp_replace(txt, '^Mrs ', '') AS bare FROM men WHERE kind = 'PERSON'")

# Risk
_FACT = ", fact AS (SELECT doc_id, kind, {} AS value, min(s) AS first FROM ann WHERE role = 'QUASI' AND kind IN ({}) GROUP BY ALL)"
_ALL_KINDS, _COARSE = "'DEM', 'DATETIME', 'LOC', 'QUANTITY'", "'DEM', 'LOC'"
_RAW = _FACT.format("lower(trim(txt))", _ALL_KINDS)
_FOLDED = _FACT.format(_NORMAL, _ALL_KINDS)
_SIG = "string_agg(kind || '=' || value, '; ' ORDER BY kind, value)"
_K = _FACT.format("lower(trim(txt))", _COARSE) + f", sig AS (SELECT doc_id, {_SIG} AS signature, count(*) AS n_facts FROM fact GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT *, count(*) OVER (PARTITION BY signature) AS k FROM sig)"
SQL["signatures"] = _cases(_RAW + f" SELECT doc_id, {_SIG} AS signature, count(*) AS n_facts FROM fact GROUP BY 1")
SQL["k_anonymity"] = _cases(_K + " SELECT doc_id, signature, n_facts, k FROM k")
SQL["k_distribution"] = _cases(_K + " SELECT CAST(n AS INTEGER) AS k_at_most, (SELECT count(*) FROM k WHERE k <= n) AS n_docs, 100.0 * (SELECT count(*) FROM k WHERE k <= n) / (SELECT count(*) FROM k) AS percent FROM (VALUES (1), (2), (3), (4), (5), (10)) t(n)")
SQL["haystack_k"] = _cases(
    f""", own AS (SELECT doc_id, string_agg(DISTINCT kind || '=' || lower(txt), '; ' ORDER BY kind || '=' || lower(txt)) AS sig FROM gold WHERE {_ROLE} = 'QUASI' GROUP BY 1),
hay AS (SELECT sig, count(*) AS cnt FROM (
  SELECT doc_id, string_agg(DISTINCT kind || '=' || lower(txt), '; ' ORDER BY kind || '=' || lower(txt)) AS sig FROM ann WHERE annotator = '2' AND role = 'QUASI' GROUP BY 1
  HAVING count(DISTINCT kind || '=' || lower(txt)) >= 2) GROUP BY 1)
SELECT own.doc_id, greatest(coalesce(cnt, 0), 1) AS k, coalesce(cnt, 0) >= 2 AS safe FROM own LEFT JOIN hay USING (sig)"""
)


def _needed(order: str) -> str:
    """Reveals facts one by one: `live` holds for each document the others that match so far."""
    return (
        _FOLDED
        + f""", df AS (SELECT kind, value, count(*) AS df FROM fact GROUP BY 1, 2),
told AS (SELECT f.*, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, kind, value) AS rk FROM fact f JOIN df USING (kind, value)),
live AS (
  SELECT t.doc_id, o.doc_id AS other, 1 AS told FROM told t JOIN fact o USING (kind, value) WHERE rk = 1 AND o.doc_id <> t.doc_id
  UNION ALL
  SELECT l.doc_id, l.other, l.told + 1 FROM live l JOIN told t ON t.doc_id = l.doc_id AND t.rk = l.told + 1
    JOIN fact o ON o.doc_id = l.other AND o.kind = t.kind AND o.value = t.value),
needed AS (
  SELECT n.doc_id, n_facts, CASE WHEN coalesce(p, 0) < n_facts THEN coalesce(p, 0) + 1 END AS needed
  FROM (SELECT doc_id, count(*) AS n_facts FROM fact GROUP BY 1) n LEFT JOIN (SELECT doc_id, max(told) AS p FROM live GROUP BY 1) l ON l.doc_id = n.doc_id)"""
    )


_SMART = _needed("df")
_CDF = ", cdf AS (SELECT n, (SELECT count(*) FROM needed WHERE needed <= n) AS n_docs, 100.0 * (SELECT count(*) FROM needed WHERE needed <= n) / (SELECT count(*) FROM needed) AS percent FROM (SELECT CAST(unnest(generate_series(1, 6)) AS INTEGER) AS n))"
SQL["min_facts_smart"] = _cases(_SMART + " SELECT doc_id, n_facts, needed FROM needed")
SQL["min_facts_doc_order"] = _cases(_needed("first") + " SELECT doc_id, n_facts, needed FROM needed")
SQL["reid_cdf"] = _cases(_SMART + _CDF + " SELECT n, n_docs, percent FROM cdf")
SQL["reid_threshold"] = _cases(_SMART + _CDF + " SELECT min(n) AS n FROM cdf WHERE percent >= 50")
SQL["reid_summary"] = _cases(_SMART + " SELECT count(*) AS n_docs, count(*) FILTER (needed IS NULL) AS never, CAST(trunc(quantile_cont(needed, 0.5)) AS BIGINT) AS median, max(needed) AS most FROM needed")
SQL["reid_histogram"] = _cases(_SMART + " SELECT needed, count(*) AS n_docs FROM needed WHERE needed IS NOT NULL GROUP BY 1")
SQL["rarest_fact"] = _cases(
    _FOLDED + ", df AS (SELECT kind, value, count(*) AS n_docs FROM fact GROUP BY 1, 2) SELECT doc_id, kind AS entity_type, value, n_docs FROM fact JOIN df USING (kind, value) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_docs, kind, value) = 1"
)

# Redaction. A document is its segments, so a redacted one is its segments with some replaced.
_QUASI = "role IN ('DIRECT', 'QUASI') AND kind IN ('DATETIME', 'LOC', 'DEM', 'QUANTITY')"
_DIRECT = "role IN ('DIRECT', 'QUASI') AND kind NOT IN ('DATETIME', 'LOC', 'DEM', 'QUANTITY')"
SQL["lite_redact"] = _cases(f" SELECT concat('case-', k) AS doc_id, string_agg(CASE WHEN {_DIRECT} THEN '[' || kind || ']' ELSE t END, '' ORDER BY i) AS redacted_text, CAST(0 AS INTEGER) AS iterations_used, TRUE AS converged FROM seg GROUP BY k")
_AUDIT = f""", audit AS (
  SELECT doc_id, CAST(idx AS INTEGER) AS seq, txt, CASE WHEN {_ROLE} = 'DIRECT' THEN 'redact' ELSE 'leave' END AS action, kind FROM gold)"""
SQL["lite_audit"] = _cases(
    _AUDIT
    + """ SELECT doc_id, seq, action, CASE WHEN action = 'redact' THEN 'DIRECT identifier (' || kind || '); always suppressed in Lite.'
  ELSE 'QUASI identifier (' || kind || '); Lite does not touch quasi-identifiers. Run Pro for mosaic-aware redaction.' END AS rationale,
  CASE WHEN action = 'redact' THEN '[' || kind || ']' END AS replacement FROM audit"""
)
SQL["audit_first"] = _cases(_AUDIT + " SELECT doc_id, action, CAST(nth AS INTEGER) AS nth, txt AS original_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, action ORDER BY seq) AS nth FROM audit) WHERE nth <= 2")


def _pro(most: int) -> str:
    levels = " UNION ALL ".join(f"SELECT k, i, {n} AS level, kind, {_level(n)} AS shown FROM quasi" for n in range(4))
    exhausted = 3 if most >= 3 else most + 1
    return f""", quasi AS (SELECT k, i, kind, t AS txt FROM seg WHERE {_QUASI}),
shown AS ({levels}),
sig AS (
  SELECT d.k, level, coalesce(string_agg(DISTINCT kind || '=' || lower(trim(shown)), '; ' ORDER BY kind || '=' || lower(trim(shown))) FILTER (NOT (shown LIKE '[%' AND shown LIKE '%]')), '') AS sig
  FROM (SELECT k, unnest([0, 1, 2, 3]) AS level FROM doc) d LEFT JOIN shown USING (k, level) GROUP BY 1, 2),
hay AS (SELECT sig, 3 * count(*) AS cnt FROM sig WHERE level = CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AND sig <> '' GROUP BY 1),
ks AS (SELECT k AS doc, level, CASE WHEN sig = '' THEN greatest((SELECT coalesce(sum(cnt), 0) FROM hay), 1) ELSE greatest(coalesce(cnt, 0), 1) END AS kk FROM sig LEFT JOIN hay USING (sig)),
safe AS (SELECT doc, min(level) FILTER (kk >= 5 AND level <= {min(most, 3)}) AS safe FROM ks GROUP BY 1),
fin AS (
  SELECT doc, safe, coalesce(safe, 3) AS level, CAST(coalesce(safe, {exhausted}) AS INTEGER) AS iterations_used,
    safe IS NOT NULL AND coalesce(safe, 3) < 3 AS converged FROM safe)"""


_PRO = """SELECT doc_id, redacted_text, CAST(a.kk AS BIGINT) AS mosaic_risk_initial, CAST(b.kk AS BIGINT) AS mosaic_risk_final, iterations_used, converged
FROM fin JOIN ks a ON a.doc = fin.doc AND a.level = 0 JOIN ks b ON b.doc = fin.doc AND b.level = fin.level JOIN (
  SELECT s.k, concat('case-', s.k) AS doc_id, string_agg(CASE WHEN """ + _DIRECT.replace("role", "s.role").replace("kind", "s.kind") + """ THEN '[' || s.kind || ']' ELSE coalesce(sh.shown, s.t) END, '' ORDER BY s.i) AS redacted_text
  FROM seg s JOIN fin f ON f.doc = s.k LEFT JOIN shown sh ON sh.k = s.k AND sh.i = s.i AND sh.level = f.level GROUP BY s.k) x ON x.k = fin.doc"""
SQL["pro_redact"] = _cases(_pro(5) + _PRO)
SQL["html_articles"] = _cases(
    _pro(1)
    + f""" SELECT doc_id, '<article><h2>' || doc_id || '</h2><p>k ' || mosaic_risk_initial || ' → ' || mosaic_risk_final || ', ' || iterations_used || ' iterations, ' || CASE WHEN converged THEN 'converged' ELSE 'not converged' END
  || '</p><pre>' || regexp_replace(replace(replace(replace(redacted_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(\\[[A-Z]+\\])', '<mark>\\1</mark>', 'g') || '</pre></article>' AS html FROM ({_PRO})"""
)
SQL["pro_redact_short"] = _cases(_pro(1) + _PRO)
SQL["pro_risk_summary"] = _cases(_pro(5) + " SELECT iterations_used, converged, count(*) AS n_docs, CAST(min(kk) AS BIGINT) AS least_k FROM fin JOIN ks ON ks.doc = fin.doc AND ks.level = fin.level GROUP BY 1, 2")
SQL["pro_audit_counts"] = _cases(
    _pro(1)
    + f""", e AS (
  SELECT 'redact' AS action, 0 AS iteration FROM seg WHERE {_DIRECT}
  UNION ALL SELECT 'leave', 0 FROM quasi JOIN fin ON doc = k WHERE safe = 0
  UNION ALL SELECT 'generalize', 1 FROM quasi JOIN fin ON doc = k WHERE safe IS NULL OR safe > 0
  UNION ALL SELECT 'generalize', 3 FROM quasi JOIN fin ON doc = k WHERE safe IS NULL)
SELECT action, iteration, count(*) AS n FROM e GROUP BY 1, 2"""
)
SQL["pro_audit"] = _cases(
    _pro(1)
    + f""", steps AS (
  SELECT q.k, q.i, q.kind, q.txt, f.safe, f.level, a.kk AS k0, b.kk AS k1, s1.shown AS one, fi.shown AS final
  FROM quasi q JOIN fin f ON f.doc = q.k JOIN ks a ON a.doc = q.k AND a.level = 0 JOIN ks b ON b.doc = q.k AND b.level = 1
    JOIN shown s1 ON s1.k = q.k AND s1.i = q.i AND s1.level = 1 JOIN shown fi ON fi.k = q.k AND fi.i = q.i AND fi.level = f.level),
e AS (
  SELECT k, i, 'redact' AS action, 0 AS iteration, 'DIRECT identifier (' || kind || '); always suppressed.' AS rationale, '[' || kind || ']' AS replacement_step, '[' || kind || ']' AS replacement FROM seg WHERE {_DIRECT}
  UNION ALL SELECT k, i, 'leave', 0, 'QUASI identifier (' || kind || '); residual k=' || k0 || ' ≥ k_target=5, no generalization needed.', NULL, NULL FROM steps WHERE safe = 0
  UNION ALL SELECT k, i, 'generalize', 1, 'Generalized to level 1: ''' || txt || ''' → ''' || one || '''. Post-step k=' || k1 || '.', one, final FROM steps WHERE safe IS NULL OR safe > 0
  UNION ALL SELECT k, i, 'generalize', 3, 'Iterate loop exhausted (k=' || k1 || ' < k_target=5); falling back to full suppression.', '[' || kind || ']', final FROM steps WHERE safe IS NULL)
SELECT concat('case-', k) AS doc_id, s AS start, action, CAST(iteration AS INTEGER) AS iteration, rationale, replacement_step, replacement FROM e JOIN seg USING (k, i)"""
)
SQL["audit_by_iteration"] = _cases(
    _pro(1)
    + f""", e AS (
  SELECT k, i, 0 AS iteration, kind FROM seg WHERE {_DIRECT}
  UNION ALL SELECT k, i, 0, kind FROM quasi JOIN fin ON doc = k WHERE safe = 0
  UNION ALL SELECT k, i, 1, kind FROM quasi JOIN fin ON doc = k WHERE safe IS NULL OR safe > 0
  UNION ALL SELECT k, i, 3, kind FROM quasi JOIN fin ON doc = k WHERE safe IS NULL),
o AS (SELECT e.*, seg.s, CASE WHEN {_ROLE.replace("kind", "e.kind")} = 'DIRECT' THEN 0 ELSE 1 END AS phase FROM e JOIN seg USING (k, i))
SELECT concat('case-', k) AS doc_id, CAST(iteration AS INTEGER) AS iteration, count(*) AS n, string_agg(kind, ',' ORDER BY phase, s) AS kinds FROM o GROUP BY k, iteration"""
)
SQL["context_windows"] = _cases(" SELECT m.doc_id, CAST(idx AS INTEGER) AS idx, substr(text, greatest(0, s - 40) + 1, e + 40 - greatest(0, s - 40)) AS context FROM men m JOIN doc USING (k)")
SQL["distinct_direct"] = _cases(f" SELECT doc_id, kind AS entity_type, txt AS text, min(s) AS first FROM gold WHERE {_ROLE} = 'DIRECT' GROUP BY 1, 2, 3")

# Pseudonyms. In a case file the names are: a person and Mrs with the surname, a firm and its first word, a case number.
_TOKEN = "CASE WHEN kind IN ('PERSON', 'ORG', 'CODE') AND role = 'DIRECT' THEN '[' || kind || '_A]' ELSE t END"
_VAULT = ", vault AS (SELECT k, kind, max_by(t, 1000 * length(t) - i) AS original FROM seg WHERE kind IN ('PERSON', 'ORG', 'CODE') GROUP BY 1, 2)"
SQL["pseudonymise"] = _cases(f" SELECT concat('case-', k) AS doc_id, string_agg({_TOKEN}, '' ORDER BY i) AS redacted_text FROM seg GROUP BY k")
SQL["vault_entries"] = _cases(_VAULT + " SELECT concat('case-', k) AS doc_id, '[' || kind || '_A]' AS token, original FROM vault")
SQL["restore_text"] = _cases(_VAULT + " SELECT concat('case-', s.k) AS doc_id, string_agg(coalesce(original, t), '' ORDER BY i) AS restored FROM seg s LEFT JOIN vault v ON v.k = s.k AND v.kind = s.kind GROUP BY s.k")

SQL["slot_round_trip"] = _cases(
    _VAULT
    + """, two AS (SELECT k, max(original) FILTER (kind = 'PERSON') AS person, max(original) FILTER (kind = 'ORG') AS org FROM vault GROUP BY k)
SELECT concat('case-', k) AS doc_id, '[PERSON_A] sued [ORG_A]; see [ORG_B].' AS answer, person || ' sued ' || org || '; see [ORG_B].' AS restored FROM two"""
)

# Token labels
SQL["token_windows"] = """WITH n AS (SELECT doc_id, len([x FOR x IN string_split(text, ' ') IF x <> '']) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(generate_series(0, greatest(1, CAST(ceil((n - 64) / 448.0) AS BIGINT)) - 1)) AS i FROM n WHERE n > 0)
SELECT doc_id, CAST(i AS INTEGER) AS "window", CAST(i * 448 AS INTEGER) AS first, CAST(least(512, n - i * 448) AS INTEGER) AS n_tokens FROM w"""

# Evaluation
_TYPES = "(VALUES ('PERSON'), ('ORG'), ('LOC'), ('DATETIME'), ('QUANTITY'), ('CODE'), ('DEM'), ('MISC'), ('_ALL')) ty(entity_type)"
_RATIOS = """coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r"""


def _scores(mode: str, taken: str, who: str = "model", names: str = "(VALUES ('a'), ('b'), ('c')) mo(model)") -> str:
    """taken: a table hit(who, doc_id, ord, idx) of matched pairs, after which the results follow."""
    return (
        taken
        + f""", o AS (
  SELECT {who}, kind, 'tp' AS o FROM said p WHERE EXISTS (SELECT 1 FROM hit h WHERE h.{who} = p.{who} AND h.doc_id = p.doc_id AND h.ord = p.ord)
  UNION ALL SELECT {who}, kind, 'fp' FROM said p WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.{who} = p.{who} AND h.doc_id = p.doc_id AND h.ord = p.ord)
  UNION ALL SELECT {who}, kind, 'fn' FROM gold g, {names} WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.{who} = {names.split(' ')[-1].split('(')[0]}.{who} AND h.doc_id = g.doc_id AND h.idx = g.idx)),
c AS (SELECT {who}, entity_type, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn
  FROM (SELECT {who}, kind AS entity_type, o FROM o UNION ALL SELECT {who}, '_ALL', o FROM o) GROUP BY 1, 2),
res AS (SELECT n.{who}, '{mode}' AS mode, ty.entity_type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
  FROM {names.rsplit(' ', 1)[0]} n({who}) CROSS JOIN {_TYPES} LEFT JOIN c ON c.{who} = n.{who} AND c.entity_type = ty.entity_type),
tidy AS (SELECT {who}, mode, entity_type, p AS precision, r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1, tp, fp, fn FROM (SELECT *, {_RATIOS} FROM res))"""
    )


_EXACT = ", said AS (SELECT * FROM pred), hit AS (SELECT model, p.doc_id, ord, idx FROM said p JOIN gold g ON g.doc_id = p.doc_id AND g.kind = p.kind AND g.s = p.s AND g.e = p.e)"
#: Greedy matching, prediction by prediction.
_PARTIAL = """, said AS (SELECT *, row_number() OVER (PARTITION BY model, doc_id ORDER BY ord) AS nth FROM pred),
golds AS (SELECT doc_id, list({'idx': idx, 's': s, 'e': e, 'kind': kind} ORDER BY idx) AS g FROM gold GROUP BY 1),
walk AS (
  SELECT model, doc_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS idx, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT model, doc_id FROM said)
  UNION ALL
  SELECT model, doc_id, nth, ord, idx, CASE WHEN idx IS NULL THEN used ELSE list_append(used, idx) END FROM (
    SELECT w.model, w.doc_id, p.nth, CAST(p.ord AS BIGINT) AS ord, w.used,
      ([CAST(x.idx AS BIGINT) FOR x IN g.g IF x.kind = p.kind AND x.s < p.e AND x.e > p.s AND NOT list_contains(w.used, x.idx)])[1] AS idx
    FROM walk w JOIN said p ON p.model = w.model AND p.doc_id = w.doc_id AND p.nth = w.nth + 1 JOIN golds g ON g.doc_id = w.doc_id)),
hit AS (SELECT model, doc_id, ord, idx FROM walk WHERE idx IS NOT NULL)"""
_TIDY = " SELECT model, mode, entity_type, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, tp, fp, fn FROM tidy"
SQL["eval_exact"] = _cases(_scores("exact", _EXACT) + _TIDY)
SQL["eval_partial"] = _cases(_scores("partial", _PARTIAL) + _TIDY)
SQL["f1_pivot"] = _cases(_scores("exact", _EXACT) + " SELECT entity_type, " + ", ".join(f"round(max(f1) FILTER (model = '{m}'), 9) AS {m}" for m in "abc") + " FROM tidy GROUP BY 1")
SQL["routing_table"] = _cases(_scores("exact", _EXACT) + " SELECT entity_type, model FROM tidy WHERE entity_type <> '_ALL' QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY f1 DESC, model) = 1")
SQL["best_strategy"] = _cases(_scores("exact", _EXACT) + " SELECT model AS strategy, round(f1, 9) AS f1, round(f1 - max(f1) OVER (), 9) AS behind FROM tidy WHERE entity_type = '_ALL'")
_ENTITIES = """, ent AS (
  SELECT mo.model, m.doc_id, m.ent, first_value(m.kind) OVER (PARTITION BY mo.model, m.doc_id, m.ent ORDER BY m.idx) AS kind, m.s, m.e
  FROM men m, (VALUES ('a'), ('b'), ('c')) mo(model) WHERE role IN ('DIRECT', 'QUASI')),
seen AS (SELECT *, EXISTS (SELECT 1 FROM pred p WHERE p.model = ent.model AND p.doc_id = ent.doc_id AND p.kind = ent.kind AND p.s < ent.e AND p.e > ent.s) AS found FROM ent),
per AS (SELECT model, doc_id, ent, kind, count(*) AS n, count(*) FILTER (found) AS f FROM seen GROUP BY 1, 2, 3, 4)"""
_RECALL = "count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_mentions, round(avg(f / n), 9) AS macro_recall, round(sum(f) / greatest(1, sum(n)), 9) AS micro_recall FROM per"
SQL["mention_recall"] = _cases(_ENTITIES + f" SELECT model, {_RECALL} GROUP BY 1")
SQL["mention_recall_by_type"] = _cases(_ENTITIES + f" SELECT model, kind AS entity_type, {_RECALL} GROUP BY 1, 2")
SQL["missed_spans"] = _cases(" SELECT model, kind AS entity_type, count(*) AS n FROM gold g, (VALUES ('a'), ('b'), ('c')) mo(model) WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.model = mo.model AND p.doc_id = g.doc_id AND p.kind = g.kind AND p.s < g.e AND p.e > g.s) GROUP BY 1, 2")
SQL["false_alarms"] = _cases(" SELECT model, kind AS entity_type, count(*) AS n FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE p.doc_id = g.doc_id AND p.kind = g.kind AND p.s < g.e AND p.e > g.s) GROUP BY 1, 2")

# The rule detector on a case file, segment by segment: what is found of each, by whom.
_RULES = f""", firm AS (SELECT k, t AS org, regexp_matches(t, '(Ltd|Inc|Corp|plc|GmbH|Court)$') AS known FROM seg WHERE i = 13),
rule AS (
  SELECT seg.k, i, CASE
    WHEN i = 3 THEN 'QUANTITY' WHEN i = 5 AND lower(t) IN ({", ".join(f"'{x}'" for x in DEM_BROADER)}) THEN 'DEM' WHEN i = 7 AND lower(t) IN ({", ".join(f"'{x}'" for x in CITY_COUNTRY)}) THEN 'LOC'
    WHEN i = 9 THEN 'DATETIME' WHEN i = 11 THEN 'CODE' WHEN i = 13 AND known THEN 'ORG' WHEN i = 15 THEN 'PERSON'
    WHEN i = 17 AND regexp_matches(t, '^€(1[5-9][0-9][0-9]|20[0-9][0-9])$') THEN 'DATETIME' WHEN i = 17 AND length(t) > 2 THEN 'QUANTITY'
    WHEN i = 19 AND lower(t) IN ({", ".join(f"'{x}'" for x in CITY_COUNTRY)}) THEN 'LOC' WHEN i = 19 AND known THEN 'ORG' END AS found,
    CASE WHEN i = 11 THEN 'regex' WHEN i = 19 AND lower(t) NOT IN ({", ".join(f"'{x}'" for x in CITY_COUNTRY)}) THEN 'coref' ELSE 'ner' END AS source
  FROM seg JOIN firm USING (k))"""
SQL["rules_detect_counts"] = _cases(_RULES + f" SELECT found AS entity_type, {_ROLE.replace('kind', 'found')} AS identifier_role, source, count(*) AS n FROM rule WHERE found IS NOT NULL GROUP BY 1, 2, 3")
SQL["mention_recall_coref"] = _cases(
    _RULES
    + """, ent AS (
  SELECT g.k, i, ent, first_value(kind) OVER (PARTITION BY g.k, ent ORDER BY i) AS kind FROM (SELECT k, i, entity AS ent, kind FROM seg WHERE role IN ('DIRECT', 'QUASI')) g),
lab AS (SELECT label, ent.k, ent.ent, count(*) AS n, count(*) FILTER (found = kind AND (label = 'coref' OR source <> 'coref')) AS f FROM ent JOIN rule USING (k, i), (VALUES ('baseline'), ('coref')) l(label) GROUP BY 1, 2, 3)
SELECT label, count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_mentions, round(avg(f / n), 9) AS macro_recall, round(sum(f) / greatest(1, sum(n)), 9) AS micro_recall FROM lab GROUP BY 1"""
)

# Ensembles
_GROUPS = """, ord0 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, model, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pred),
grp AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e, model, ord) AS grp FROM ord0),
voters AS (SELECT doc_id, grp, count(DISTINCT model) AS n_voters FROM grp GROUP BY 1, 2),
kinds AS (SELECT doc_id, grp, kind, count(*) AS n, min({'s': s, 'e': e, 'm': model, 'o': ord}) AS first FROM grp GROUP BY 1, 2, 3),
won AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY doc_id, grp ORDER BY n DESC, first) = 1),
kept AS (
  SELECT g.doc_id, g.grp, n_voters, g.s, g.e, g.kind, g.txt,
    row_number() OVER (PARTITION BY g.doc_id, g.grp ORDER BY length(txt) DESC, txt DESC, s, e) AS longest, row_number() OVER (PARTITION BY g.doc_id, g.grp ORDER BY length(txt), txt, s DESC, e DESC) AS shortest
  FROM grp g JOIN won w ON w.doc_id = g.doc_id AND w.grp = g.grp AND w.kind = g.kind JOIN voters v ON v.doc_id = g.doc_id AND v.grp = g.grp)"""
_SPAN = 'doc_id, s AS start, e AS "end", kind AS entity_type, txt AS text'
SQL["ensemble_union"] = _cases(_GROUPS + f" SELECT {_SPAN} FROM kept WHERE longest = 1")
SQL["ensemble_consensus"] = _cases(_GROUPS + f" SELECT {_SPAN} FROM kept WHERE shortest = 1 AND n_voters >= 2")
SQL["vote_sweep"] = _cases(_GROUPS + " SELECT CAST(v AS INTEGER) AS min_votes, kind AS entity_type, count(*) AS n FROM kept, (VALUES (1), (2), (3)) x(v) WHERE longest = 1 AND n_voters >= v GROUP BY 1, 2")
_ROUTES = ", routes AS (SELECT entity_type, model FROM tidy WHERE entity_type <> '_ALL' QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY f1 DESC, model) = 1)"
_STRATEGIES = "(VALUES ('a_alone'), ('b_alone'), ('c_alone'), ('min1'), ('min2'), ('min3'), ('routed')) mo(strategy)"
_COMBINED = (
    _GROUPS
    + ", routes AS (SELECT entity_type, model FROM (WITH "
    + _scores("exact", _EXACT).lstrip(", ")
    + """ SELECT * FROM tidy) WHERE entity_type <> '_ALL' QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY f1 DESC, model) = 1),
every AS (
  SELECT model || '_alone' AS strategy, doc_id, s, e, kind, txt FROM pred
  UNION ALL SELECT 'min' || v, doc_id, s, e, kind, txt FROM kept, (VALUES (1), (2), (3)) x(v) WHERE longest = 1 AND n_voters >= v
  UNION ALL SELECT 'routed', doc_id, s, e, kind, txt FROM pred p JOIN routes r ON r.entity_type = p.kind AND r.model = p.model)"""
)
_SAID = "(SELECT *, row_number() OVER (PARTITION BY strategy, doc_id ORDER BY s, e, kind, txt) AS ord FROM every)"


def _by_strategy(sql: str) -> str:
    return sql.replace("model", "strategy").replace("FROM pred)", f"FROM {_SAID})")


SQL["combiner_comparison"] = _cases(
    _COMBINED
    + ", in_both AS ("
    + " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_scores(mode, _by_strategy(taken), 'strategy', _STRATEGIES).lstrip(', ')} SELECT * FROM tidy WHERE entity_type = '_ALL')" for mode, taken in (("partial", _PARTIAL), ("exact", _EXACT)))
    + ") SELECT strategy, mode, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, tp, fp, fn FROM in_both"
)
SQL["third_document"] = _cases(" SELECT doc_id, n_mentions FROM (SELECT doc_id, count(*) AS n_mentions FROM ann WHERE annotator = '2' GROUP BY 1 ORDER BY n_mentions DESC, doc_id LIMIT 1 OFFSET 2)")
SQL["routed_spans"] = _cases(_scores("exact", _EXACT) + _ROUTES + f" SELECT {_SPAN} FROM pred p JOIN routes r ON r.entity_type = p.kind AND r.model = p.model")

# Summaries
SQL["dataset_summary"] = _cases(
    """ SELECT 'documents' AS measure, split, CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS VARCHAR) AS role, 2 * count(*) AS n FROM doc GROUP BY split
  UNION ALL SELECT 'type', NULL, kind, NULL, count(*) FROM ann GROUP BY kind
  UNION ALL SELECT 'role', NULL, NULL, role, count(*) FROM ann GROUP BY role
  UNION ALL SELECT 'type_role', NULL, kind, role, count(*) FROM ann GROUP BY kind, role
  UNION ALL SELECT 'mentions', NULL, NULL, NULL, count(*) FROM ann"""
)
SQL["annotator_disagreement"] = _cases(" SELECT count(*) AS n_entities, count(*) FILTER (r > 1) AS n_disagreed, round(count(*) FILTER (r > 1) / count(*), 9) AS rate FROM (SELECT ent, count(DISTINCT role) AS r FROM ann GROUP BY 1)")
SQL["top_documents"] = _cases(" SELECT doc_id, count(*) AS n_mentions FROM ann WHERE annotator = '2' GROUP BY 1 ORDER BY n_mentions DESC, doc_id LIMIT 10")
SQL["examples_by_role"] = _cases(" SELECT entity_type, role, text, CAST(nth AS INTEGER) AS nth FROM (SELECT kind AS entity_type, role, txt AS text, row_number() OVER (PARTITION BY kind, role ORDER BY md5(txt), txt) AS nth FROM (SELECT DISTINCT kind, role, txt FROM ann)) WHERE nth <= 3")
SQL["coref_spans"] = _cases(
    """ SELECT m.doc_id, m.s AS start, m.e AS "end", CASE WHEN kind = 'LOC' THEN 'ORG' ELSE kind END AS entity_type, m.txt AS text, 0.7::DOUBLE AS confidence
  FROM men m JOIN (SELECT k, split_part(txt, ' ', 1) AS word FROM men WHERE kind = 'ORG' AND contains(txt, ' ')) o USING (k)
  WHERE (kind = 'PERSON' AND starts_with(txt, 'Mrs ')) OR (kind IN ('ORG', 'LOC') AND txt = word)"""
)
_WORDS = """, w0 AS (SELECT k, doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS j FROM doc),
w1 AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY k ORDER BY j) - length(w) - 1 AS INTEGER) AS s FROM w0),
w2 AS (SELECT w.k, w.doc_id, j, w.s, CAST(w.s + length(w) AS INTEGER) AS e, g.kind FROM w1 w LEFT JOIN gold g ON g.k = w.k AND w.s >= g.s AND w.s + length(w) <= g.e),
w3 AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY k ORDER BY j) AS begins FROM w2)"""
_POSITION = "list_position(['CODE', 'DATETIME', 'DEM', 'LOC', 'MISC', 'ORG', 'PERSON', 'QUANTITY'], kind)"
SQL["bio_encode"] = _cases(_WORDS + f" SELECT CAST(CASE WHEN kind IS NULL THEN 0 ELSE 2 * {_POSITION} - CASE WHEN begins THEN 1 ELSE 0 END END AS INTEGER) AS id, count(*) AS n FROM w3 GROUP BY 1")
SQL["bio_decode"] = _cases(
    _WORDS
    + """, w4 AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY j) AS isle FROM w3)
SELECT doc_id, start, "end", entity_type, substr(text, start + 1, "end" - start) AS text FROM (
  SELECT k, isle, min(s) AS start, max(e) AS "end", any_value(kind) AS entity_type FROM w4 WHERE kind IS NOT NULL GROUP BY 1, 2) JOIN doc USING (k)"""
)
SQL["analyser_spans"] = _cases(' SELECT doc_id, s AS start, e AS "end", kind AS entity_type, txt AS text FROM men WHERE kind = \'CODE\'')
SQL["simple_redact"] = _cases(" SELECT concat('case-', k) AS doc_id, string_agg(CASE WHEN role IN ('DIRECT', 'QUASI') THEN CASE kind WHEN 'DEM' THEN '[RAW_DEM]' ELSE '[' || kind || ']' END ELSE t END, '' ORDER BY i) AS redacted_text FROM seg GROUP BY k")
SQL["seeded_sample"] = "SELECT doc_id FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 20"
SQL["token_scores"] = _cases(
    _WORDS
    + """, said AS (
  SELECT *, CASE WHEN kind IS NULL OR (k + j) % 9 = 0 THEN NULL ELSE kind END AS p FROM w3),
p3 AS (SELECT *, p IS DISTINCT FROM lag(p) OVER (PARTITION BY k ORDER BY j) AS pb FROM said),
p4 AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY j) AS gi, sum(CASE WHEN pb THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY j) AS pi FROM p3),
g AS (SELECT k, min(j) AS a, max(j) AS z, any_value(kind) AS kind FROM p4 WHERE kind IS NOT NULL GROUP BY k, gi),
q AS (SELECT k, min(j) AS a, max(j) AS z, any_value(p) AS kind FROM p4 WHERE p IS NOT NULL GROUP BY k, pi),
n AS (SELECT (SELECT count(*) FROM g JOIN q USING (k, a, z, kind)) AS tp, (SELECT count(*) FROM q) AS np, (SELECT count(*) FROM g) AS ng)
SELECT round(tp / np, 9) AS precision, round(tp / ng, 9) AS recall, round(2 * tp / (np + ng), 9) AS f1, tp, np - tp AS fp, ng - tp AS fn FROM n"""
)


# Whole texts of `documents`. Repeated ids are told apart by row.
def _words(body: str) -> str:
    return "WITH " + WORDS_SQL + body


_WORD_MODELS = "(VALUES ('x'), ('y')) mo(model)"
_WORD_EXACT = _EXACT.replace("g.doc_id = p.doc_id", "g.row = p.row").replace("p.doc_id, ord", "p.row AS doc_id, ord").replace("SELECT * FROM pred", "SELECT * REPLACE (row AS doc_id) FROM pred")
SQL["words_eval_exact"] = _words(_scores("exact", _WORD_EXACT, names=_WORD_MODELS).replace("FROM gold g,", "FROM (SELECT * REPLACE (row AS doc_id) FROM gold) g,") + _TIDY)
SQL["words_missed"] = _words(f" SELECT model, kind AS entity_type, count(*) AS n FROM gold g, {_WORD_MODELS} WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.model = mo.model AND p.row = g.row AND p.kind = g.kind AND p.s < g.e AND p.e > g.s) GROUP BY 1, 2")
SQL["words_ensemble_union"] = _words(
    _GROUPS.replace("doc_id", "row")
    + " SELECT doc_id, count(*) AS n, CAST(sum(s * 3 + e) AS BIGINT) AS places, CAST(sum(length(txt)) AS BIGINT) AS length FROM kept JOIN src USING (row) WHERE longest = 1 GROUP BY doc_id"
)
SQL["words_redact"] = _words(
    f""", cut AS (SELECT row, s, e, kind, coalesce(lag(e) OVER (PARTITION BY row ORDER BY s), 0) AS before, row_number() OVER (PARTITION BY row ORDER BY s DESC) AS from_end FROM gold),
made AS (
  SELECT c.row, string_agg(substr(t, before + 1, s - before) || CASE WHEN {_ROLE} = 'DIRECT' THEN '[' || kind || ']' ELSE substr(t, s + 1, e - s) END || CASE WHEN from_end = 1 THEN substr(t, e + 1) ELSE '' END, '' ORDER BY s) AS text
  FROM cut c JOIN src ON src.row = c.row GROUP BY c.row)
SELECT doc_id, length(coalesce(text, t)) AS n_chars, md5(coalesce(text, t)) AS md5 FROM src LEFT JOIN made ON made.row = src.row"""
)
SQL["words_bio_decode"] = _words(
    """, piece AS (SELECT row, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS n FROM (
  SELECT row, regexp_replace(t, '([^\\s\\x0b\x85\xa0]+)', chr(1) || '\\1' || chr(1), 'g') AS m FROM src)),
token AS (SELECT row, n, CAST(e - length(p) AS INTEGER) AS s, e FROM (SELECT row, n, p, CAST(sum(length(p)) OVER (PARTITION BY row ORDER BY n) AS INTEGER) AS e FROM piece) WHERE n % 2 = 0),
held AS (SELECT token.row, n, token.s, token.e, kind FROM token LEFT JOIN gold ON gold.row = token.row AND token.s = gold.s AND token.e <= gold.e),
begun AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY row ORDER BY n) AS b FROM held),
isle AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY n) AS isle FROM begun),
span AS (SELECT row, isle, min(s) AS s, max(e) AS e, any_value(kind) AS kind FROM isle WHERE kind IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, kind AS entity_type, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM span JOIN src USING (row) GROUP BY 1, 2"""
)
