"""DuckDB forms of the structural tests, by windows and joins over tokens.

The Spark side folds an automaton over each formula. Here the same definitions
are stated as spans: depths are running sums, a bracket's partner is the next
closing one at its depth, a scope ends at the next sign that may end it.
"""

from __future__ import annotations

from pairwright.sources.fixture import STRUCTURE_TEMPLATES, TEMPLATES

_SP = r"[\s\p{Z}]"
_NAME = r"[^\s\p{Z}∀∃¬∧∨→↔⊕(),=≠<>≤≥+*/\[\]{}]+"
_NAMES = rf"{_NAME}(?:{_SP}+{_NAME})*"
_TOKEN = rf"[∀∃]{_SP}*{_NAME}|{_NAMES}{_SP}*\(|{_NAMES}|[=≠<>≤≥+*/]+|[^\s\p{{Z}}]|{_SP}+"

#: All tokens but spaces: place, kind, depth before (db) and after (da), name.
TOKENS = rf"""runs AS (
  SELECT pair_id, unnest(regexp_extract_all(fol_expression, '{_TOKEN}')) AS t, generate_subscripts(regexp_extract_all(fol_expression, '{_TOKEN}'), 1) AS i
  FROM formulas WHERE fol_expression IS NOT NULL
), placed AS (
  SELECT pair_id, i, t, (1 + coalesce(sum(length(t)) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS place,
         CASE WHEN regexp_matches(t, '^[∀∃].') THEN 'q' WHEN t = '¬' THEN 'u' WHEN contains('∧∨⊕→↔', t) THEN 'b' WHEN contains('([{{', t) THEN 'o'
              WHEN contains(')]}}', t) THEN 'x' WHEN t = ',' THEN ',' WHEN regexp_matches(t, '^[=≠<>≤≥+*/∀∃]') THEN 'r'
              WHEN regexp_full_match(t, '{_SP}+') THEN 's' WHEN ends_with(t, '(') THEN 'c' ELSE 'n' END AS kind
  FROM runs
), summed AS (
  SELECT *, sum(CASE WHEN kind IN ('o', 'c') THEN 1 WHEN kind = 'x' THEN -1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY i) AS raw FROM placed WHERE kind <> 's'
), toks AS (
  SELECT pair_id, i, t, place, (place + length(t) - 1)::INTEGER AS fin, kind, raw,
         (raw - least(0, min(raw) OVER w))::INTEGER AS da,
         (coalesce(lag(raw) OVER w2, 0) - least(0, coalesce(min(raw) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INTEGER AS db,
         regexp_replace(t, '^[∀∃]{_SP}*|{_SP}*\($', '', 'g') AS name
  FROM summed WINDOW w AS (PARTITION BY pair_id ORDER BY i), w2 AS (PARTITION BY pair_id ORDER BY i)
)"""

FREE = """scopes AS (
  SELECT b.pair_id, b.name, b.i, min(e.i) AS until FROM toks b LEFT JOIN toks e
    ON e.pair_id = b.pair_id AND e.i > b.i AND e.kind IN ('b', ',', 'x') AND b.db >= e.db
  WHERE b.kind = 'q' GROUP BY ALL
), free AS (
  SELECT v.pair_id, v.t, min(v.i) AS i FROM toks v WHERE v.kind = 'n' AND regexp_full_match(v.t, '[a-z]')
    AND NOT EXISTS (SELECT 1 FROM scopes s WHERE s.pair_id = v.pair_id AND s.name = v.t AND s.i < v.i AND (s.until IS NULL OR v.i < s.until))
  GROUP BY v.pair_id, v.t
), free_lists AS (SELECT pair_id, list(t ORDER BY i) AS free_variables FROM free GROUP BY pair_id)"""

FAULTS = """partners AS (
  SELECT x.pair_id, x.i, x.place, x.t, x.db, max_by(right(o.t, 1), o.i) AS o FROM toks x LEFT JOIN toks o
    ON o.pair_id = x.pair_id AND o.i < x.i AND o.kind IN ('o', 'c') AND o.da = x.db AND x.db > 0
  WHERE x.kind = 'x' GROUP BY ALL
), closing_faults AS (
  SELECT pair_id, min_by({'fault': CASE WHEN db = 0 THEN 'unopened' ELSE 'mismatched' END, 'at': place, 'open': db}, i) AS f
  FROM partners WHERE db = 0 OR o || t NOT IN ('()', '[]', '{}') GROUP BY pair_id
), unclosed AS (
  SELECT o.pair_id, min(o.fin) AS place FROM toks o WHERE o.kind IN ('o', 'c')
    AND NOT EXISTS (SELECT 1 FROM toks x WHERE x.pair_id = o.pair_id AND x.i > o.i AND x.da < o.da) GROUP BY o.pair_id
), faults AS (
  SELECT pair_id, f.fault AS fault, f['at']::INTEGER AS fault_at, f.open::INTEGER AS open_brackets FROM closing_faults
  UNION ALL
  SELECT pair_id, 'unclosed', place::INTEGER, (SELECT max_by(t.da, t.i) FROM toks t WHERE t.pair_id = u.pair_id)::INTEGER
  FROM unclosed u WHERE pair_id NOT IN (SELECT pair_id FROM closing_faults)
)"""

MIXED = """framed AS (
  SELECT *, max(CASE WHEN kind IN ('o', 'c') THEN i END) OVER (PARTITION BY pair_id, CASE WHEN kind IN ('o', 'c') THEN da ELSE db END ORDER BY i) AS frame,
         CASE WHEN kind IN ('o', 'c') THEN da ELSE db END AS inside FROM toks
), parted AS (
  SELECT *, count(*) FILTER (kind = ',') OVER f AS commas, count(*) FILTER (kind = ',' OR contains('→↔', t)) OVER f AS parts
  FROM framed WHERE kind IN ('b', ',') WINDOW f AS (PARTITION BY pair_id, inside, frame ORDER BY i)
), before AS (
  SELECT pair_id, i, place, t, lag(t) OVER (PARTITION BY pair_id, inside, frame, parts ORDER BY i) AS b FROM parted WHERE kind = 'b' AND NOT contains('→↔', t)
  UNION ALL
  SELECT pair_id, i, place, t, lag(t) OVER (PARTITION BY pair_id, inside, frame, commas ORDER BY i) FROM parted WHERE contains('→↔', t)
), mixed AS (
  SELECT pair_id, list({'at': place, 'before': b, 'sign': t} ORDER BY i) AS mixed_connectives FROM before WHERE b <> t OR (b IS NOT NULL AND contains('→↔', t)) GROUP BY pair_id
)"""

CALLS = """call_spans AS (
  SELECT c.pair_id, c.i, c.name, c.place, min(x.i) AS until FROM toks c LEFT JOIN toks x ON x.pair_id = c.pair_id AND x.i > c.i AND x.kind = 'x' AND x.da = c.db
  WHERE c.kind = 'c' GROUP BY ALL
), within AS (
  SELECT t.*, max_by(c.name, c.i) AS outer_name FROM toks t LEFT JOIN call_spans c ON c.pair_id = t.pair_id AND c.i < t.i AND (c.until IS NULL OR t.i < c.until) GROUP BY ALL
)"""

NESTED = """wrong AS (
  SELECT w.pair_id, w.i, w.place, w.outer_name, CASE WHEN w.kind = 'c' THEN w.name ELSE substr(w.t, 1, 1) END AS inner_name FROM within w
  WHERE w.outer_name IS NOT NULL AND (w.kind IN ('b', 'u', 'q') OR (w.kind = 'c' AND (substr(w.name, 1, 1) <> lower(substr(w.name, 1, 1))
        OR EXISTS (SELECT 1 FROM within p WHERE p.pair_id = w.pair_id AND p.kind = 'c' AND p.outer_name IS NULL AND p.name = w.name))))
), nested AS (SELECT pair_id, list({'at': place, 'outer': outer_name, 'inner': inner_name} ORDER BY i) AS nested FROM wrong GROUP BY pair_id)"""

NEGATION = """plain AS (
  SELECT w.*, CASE WHEN w.kind = 'x' AND EXISTS (SELECT 1 FROM call_spans c WHERE c.pair_id = w.pair_id AND c.until = w.i) THEN 'cx' ELSE w.kind END AS role
  FROM within w WHERE w.outer_name IS NULL
), beside AS (
  SELECT *, coalesce(lag(role) OVER p, '^') AS prev, lead(role) OVER p AS next FROM plain WINDOW p AS (PARTITION BY pair_id ORDER BY i)
), readable AS (
  SELECT pair_id FROM beside WHERE pair_id NOT IN (SELECT pair_id FROM faults) GROUP BY pair_id
  HAVING bool_and(CASE WHEN role IN ('n', 'c', 'o', 'u', 'q') THEN prev IN ('^', 'o', 'u', 'q', 'b', 'r') WHEN role = 'cx' THEN true
                       WHEN role = ',' THEN false ELSE prev IN ('n', 'cx', 'x') END AND (next IS NOT NULL OR role IN ('n', 'cx', 'x')))
), sound AS (SELECT * FROM beside WHERE pair_id IN (SELECT pair_id FROM readable)
), covers AS (
  SELECT u.pair_id, u.i, u.place, min(e.i) AS until FROM sound u LEFT JOIN sound e ON e.pair_id = u.pair_id AND e.i > u.i AND e.db = u.db AND e.role IN ('b', 'x')
  WHERE u.role = 'u' GROUP BY ALL
), spans AS (
  SELECT c.*, (SELECT min(t.place) FROM toks t WHERE t.pair_id = c.pair_id AND t.i > c.i) AS first,
         (SELECT max(t.fin) FROM toks t WHERE t.pair_id = c.pair_id AND t.i > c.i AND (c.until IS NULL OR t.i < c.until)) AS last FROM covers c
), scopes_of AS (
  SELECT s.pair_id, list({'at': s.place, 'covers': substr(f.fol_expression, s.first, s.last - s.first + 1)} ORDER BY s.i) AS scopes
  FROM spans s JOIN formulas f USING (pair_id) GROUP BY s.pair_id
), lead_run AS (
  SELECT pair_id, coalesce(min(i) FILTER (role NOT IN ('u', 'q', 'o')), 1 << 30) AS stop FROM sound GROUP BY pair_id
), denials AS (
  SELECT c.pair_id FROM covers c JOIN lead_run l USING (pair_id) WHERE c.i < l.stop
    AND NOT EXISTS (SELECT 1 FROM sound t WHERE t.pair_id = c.pair_id AND c.until IS NOT NULL AND t.i >= c.until AND t.role <> 'x')
  GROUP BY c.pair_id HAVING count(*) % 2 = 1
), sides AS (
  SELECT a.pair_id, a.i, a.place, coalesce(max(l.i), -1) AS lo, coalesce(min(r.i), 1 << 30) AS hi FROM sound a
  LEFT JOIN sound l ON l.pair_id = a.pair_id AND l.i < a.i AND ((l.db = a.db AND l.t IN ('→', '↔')) OR (l.role = 'o' AND l.da = a.db))
  LEFT JOIN sound r ON r.pair_id = a.pair_id AND r.i > a.i AND r.db = a.db AND (r.t = '↔' OR r.role = 'x')
  WHERE a.t = '→' GROUP BY ALL
), atoms AS (
  SELECT s.pair_id, s.i, s.place, t.i < s.i AS is_left, t.i AS atom,
         (SELECT count(*) FROM covers c WHERE c.pair_id = s.pair_id AND c.i < t.i AND (c.until IS NULL OR t.i < c.until) AND CASE WHEN t.i < s.i THEN c.i > s.lo ELSE c.i > s.i END) AS signs
  FROM sides s JOIN sound t ON t.pair_id = s.pair_id AND t.i > s.lo AND t.i < s.hi AND t.role IN ('n', 'c')
), denied AS (
  SELECT pair_id, place FROM atoms GROUP BY pair_id, i, place HAVING bool_or(signs % 2 = 1 AND is_left) AND bool_or(signs % 2 = 1 AND NOT is_left)
), arrows AS (SELECT pair_id, list(place ORDER BY place) AS denied_arrows FROM denied GROUP BY pair_id)"""


def structure_queries(pairs_cte) -> dict[str, str]:
    """SQL of the structural queries; ``pairs_cte`` writes the pair corpus of given templates."""
    base = pairs_cte("formulas", TEMPLATES + STRUCTURE_TEMPLATES)

    def sql(body: str, *ctes: str) -> str:
        return "WITH " + ",\n".join([base, TOKENS, *ctes]) + "\n" + body

    p = "pair_id, nl_sentence, fol_expression"
    json = lambda c: f"to_json({c})::VARCHAR AS {c}"
    flags = """SELECT pair_id, to_json(list_filter([
      CASE WHEN pair_id IN (SELECT pair_id FROM free) THEN 'free_variable_error' END,
      CASE WHEN pair_id IN (SELECT pair_id FROM mixed UNION SELECT pair_id FROM faults) THEN 'missing_parentheses' END,
      CASE WHEN pair_id IN (SELECT pair_id FROM denials) THEN 'global_negation_error' END,
      CASE WHEN pair_id IN (SELECT pair_id FROM denied) THEN 'wrong_negation_scope' END,
      CASE WHEN pair_id IN (SELECT pair_id FROM wrong) THEN 'predicate_nesting_error' END], lambda x: x IS NOT NULL))::VARCHAR AS structural
      FROM formulas WHERE fol_expression IS NOT NULL"""
    every = (FREE, FAULTS, MIXED, CALLS, NESTED, NEGATION)
    return {
        "free_variables": sql(f"SELECT {p}, {json('free_variables')} FROM formulas JOIN free_lists USING (pair_id)", FREE),
        "bracket_faults": sql(f"SELECT {p}, fault, fault_at, open_brackets FROM formulas JOIN faults USING (pair_id)", FAULTS),
        "cand_missing_parentheses": sql(
            f"SELECT {p}, coalesce(to_json(mixed_connectives)::VARCHAR, '[]') AS mixed_connectives, fault FROM formulas LEFT JOIN mixed USING (pair_id) LEFT JOIN faults USING (pair_id) "
            "WHERE mixed_connectives IS NOT NULL OR fault IS NOT NULL", FAULTS, MIXED),
        "cand_predicate_nesting": sql(f"SELECT {p}, {json('nested')} FROM formulas JOIN nested USING (pair_id)", CALLS, NESTED),
        "negation_scopes": sql(
            f"SELECT {p}, pair_id IN (SELECT pair_id FROM readable) AS well_formed, pair_id IN (SELECT pair_id FROM denials) AS global_negation, "
            "coalesce(to_json(scopes)::VARCHAR, '[]') AS scopes FROM formulas LEFT JOIN scopes_of USING (pair_id) WHERE contains(fol_expression, '¬')", FAULTS, CALLS, NEGATION),
        "both_sides_denied": sql(f"SELECT {p}, {json('denied_arrows')} FROM formulas JOIN arrows USING (pair_id)", FAULTS, CALLS, NEGATION),
        "structural_flags": sql(flags, *every),
        "structural_counts": sql(
            f"SELECT category, count(*)::BIGINT AS n FROM (SELECT unnest(json_extract_string(structural, '$[*]')) AS category FROM ({flags})) GROUP BY category", *every),
    }
