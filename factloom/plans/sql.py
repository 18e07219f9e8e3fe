"""DuckDB SQL of the queries. White space has the vertical tab, which RE2 leaves out of \\s. Doubles are rounded to six places on both sides."""

from __future__ import annotations

P1 = """p1 AS (SELECT run_name, claim_id, pred_label FROM (SELECT *, row_number() OVER (PARTITION BY run_name, claim_id ORDER BY predicted_at DESC, coalesce(pred_label, '') DESC) AS k FROM task1_pred) WHERE k = 1)"""
P2 = """p2 AS (SELECT run_name, sample_id, pred_label FROM (SELECT *, row_number() OVER (PARTITION BY run_name, sample_id ORDER BY coalesce(pred_label, '') DESC) AS k FROM task2_pred) WHERE k = 1)"""
G2 = """g2 AS (SELECT sample_id, label, evi_type FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY label DESC, evi_type DESC) AS k FROM task2_gold) WHERE k = 1)"""
HELD = "held AS (SELECT * FROM task1_gold WHERE split IN ('dev', 'test'))"
A1 = f"{P1}, {HELD}, a1 AS (SELECT run_name, h.claim_id, label, evi_type, lower(use_context) AS ctx, pred_label FROM held h JOIN p1 USING (claim_id))"
A2 = f"{P2}, {G2}, a2 AS (SELECT run_name, sample_id, label, pred_label FROM g2 JOIN p2 USING (sample_id))"

_RATIO = "CASE WHEN {1} = 0 THEN 0.0 ELSE {0} * 1.0 / {1} END"


def _scores(source: str, by: str) -> str:
    r = _RATIO.format
    return f"""SELECT {by}, n, round((ps + pr) / 2, 6) AS precision, round((rs + rr) / 2, 6) AS recall,
      round(({r('2 * ps * rs', '(ps + rs)')} + {r('2 * pr * rr', '(pr + rr)')}) / 2, 6) AS macro_f1, round(hits * 1.0 / n, 6) AS accuracy
      FROM (SELECT {by}, n, hits, {r('ts', 'qs')} AS ps, {r('tr', 'qr')} AS pr, {r('ts', 'gs')} AS rs, {r('tr', 'gr')} AS rr
        FROM (SELECT {by}, count(*) AS n, count(*) FILTER (label IS NOT DISTINCT FROM pred_label) AS hits,
          count(*) FILTER (label = 'Supported' AND pred_label = 'Supported') AS ts, count(*) FILTER (label = 'Refuted' AND pred_label = 'Refuted') AS tr,
          count(*) FILTER (pred_label = 'Supported') AS qs, count(*) FILTER (pred_label = 'Refuted') AS qr,
          count(*) FILTER (label = 'Supported') AS gs, count(*) FILTER (label = 'Refuted') AS gr FROM {source} GROUP BY {by}))"""


def _pairs(condition: str) -> str:
    """run_name, n_pairs, n_right over held-out rows under a condition."""
    return f"""SELECT run_name, (SELECT count(DISTINCT coalesce(claim_id_pair, '')) FROM held WHERE coalesce(claim_id_pair, '') <> 'no pair' AND {condition}) AS n_pairs,
      count(*) FILTER (ok = size) AS n_right
      FROM (SELECT run_name, coalesce(claim_id_pair, '') AS pair, count(*) FILTER (lower(label) = lower(pred_label)) AS ok FROM held JOIN p1 USING (claim_id)
        WHERE coalesce(claim_id_pair, '') <> 'no pair' AND {condition} GROUP BY ALL)
      JOIN (SELECT coalesce(claim_id_pair, '') AS pair, count(*) AS size FROM held WHERE {condition} GROUP BY ALL) USING (pair) GROUP BY run_name"""


_CONTEXTS = {"no": "lower(use_context) = 'no'", "yes": "lower(use_context) <> 'no'", "all": "true"}


def _leaderboard() -> str:
    parts = []
    for name, condition in _CONTEXTS.items():
        label = {"no": "no", "yes": "context", "all": "all"}[name]
        source = f"(SELECT * FROM held JOIN p1 USING (claim_id) WHERE {condition})"
        parts.append(f"SELECT s.*, n_pairs, n_right, round(CASE WHEN n_pairs = 0 THEN 0.0 ELSE n_right * 1.0 / n_pairs END, 6) AS pair_accuracy, '{label}' AS context FROM ({_scores(source, 'run_name')}) s LEFT JOIN ({_pairs(condition)}) USING (run_name)")
    return f"WITH {P1}, {HELD} " + " UNION ALL ".join(parts)


BOTH = f"""{P1}, {HELD}, b AS (SELECT h.evi_type, h.label, coalesce(h.label = x.pred_label, false) AS r1, coalesce(h.label = y.pred_label, false) AS r2
  FROM held h JOIN p1 x ON x.claim_id = h.claim_id AND x.run_name = 'solo_reader' JOIN p1 y ON y.claim_id = h.claim_id AND y.run_name = 'two_step_reader')"""

WORDS = r"(CASE WHEN regexp_replace({0}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({0}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '[\s\x0B]+')) END)"
STRIP = r"regexp_replace({0}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
ANSWERS = """ans AS (SELECT run_name, claim_id, predicted_at, CASE right(claim_id, 1)::INT % 4
    WHEN 0 THEN '<think>maybe refuted</think> Final answer: ' || coalesce(pred_label, '')
    WHEN 1 THEN 'It looks supported at first.' || chr(10) || 'FINAL ANSWER:' || chr(10) || chr(10) || ' ' || upper(coalesce(pred_label, '')) || '.'
    WHEN 2 THEN 'Some say supported, I say ' || coalesce(pred_label, '')
    ELSE '"' || coalesce(pred_label, '') || '"' END AS answer FROM task1_pred)"""
LABEL1 = r"""(CASE WHEN found IS NULL THEN NULL ELSE upper(left(found, 1)) || lower(substr(found, 2)) END)"""
PARSED1 = rf"""{ANSWERS}, parsed AS (SELECT *, coalesce(nullif(regexp_extract(answer, '(?is)final\s*answer.{{0,30}}?\b(supported|refuted)\b', 1), ''),
    regexp_extract_all(answer, '(?i)\b(supported|refuted)\b', 1)[-1]) AS found FROM ans)"""
READINGS = "rd AS (SELECT image_path, max(text) AS text FROM advisor_cache GROUP BY image_path)"
SPAN_T = r"(?i)\bTables?\s+S?\d+(?:\s*(?:,|and|-|–|to)\s*S?\d+)*\b"
SPAN_F = r"(?i)\b(?:Figures?|Figs?\.?)\s+S?\d+(?:\s*(?:,|and|-|–|to)\s*S?\d+)*\b"
OWN_T = r"""(regexp_matches({0}, '(?i)\bTables?\s+\d+\b') AND NOT regexp_matches({0}, '(?i)\bTables?\s+S\d+\b|\bsupplement(?:ary|al)?\s+Tables?\s+\d+\b')
  AND NOT regexp_matches({0}, '\be-?[Tt]ables?\b') AND NOT regexp_matches({0}, '(?i)^Tables?\s*\d+\s*:'))"""
OWN_F = r"""(regexp_matches({0}, '(?i)\b(?:Figures?|Figs?\.?)\s+\d+\b') AND NOT regexp_matches({0}, '(?i)\b(?:Figures?|Figs?\.?)\s+S\d+\b|\bsupplement(?:ary|al)?\s+(?:Figures?|Figs?\.?)\s+\d+\b')
  AND NOT regexp_matches({0}, '\be-?[Ff]igures?\b') AND NOT regexp_matches({0}, '(?i)^(?:Figures?|Figs?\.?)\s*\d+\s*:'))"""
COMPARES = r"""regexp_matches({0}, '(?i)\b(significant(ly)?|associat(ed|ion)|correlat(ed|ion)|compar(ed|ison)|higher|lower|greater|less than|more than|increase(d)?|decrease(d)?|outperform|versus|\bvs\.?\b|differ(ed|ence)?)\b')"""
WORTHY = rf"""({WORDS} >= 8 AND (regexp_matches(regexp_replace({{0}}, '{SPAN_T}', '', 'g'), '\d') OR {COMPARES})
  AND (NOT regexp_matches({{0}}, '(?i)\b(see|refer(s|red)?\s+to)\b') OR {COMPARES}))"""
DIGITS = r"(SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(flatten(list_transform(regexp_extract_all({0}, '{1}', 0), lambda s: regexp_extract_all(s, '(\d+)', 1)))) AS x, generate_subscripts(flatten(list_transform(regexp_extract_all({0}, '{1}', 0), lambda s: regexp_extract_all(s, '(\d+)', 1))), 1) AS i) GROUP BY x))"
NUM = r"-?\d[\d,]*(?:\.\d+)?"
SPECIFIC = "(try_cast(replace(r, ',', '') AS DOUBLE) IS NOT NULL AND (contains(r, '.') OR abs(try_cast(replace(r, ',', '') AS DOUBLE)) >= 10) AND NOT (try_cast(replace(r, ',', '') AS DOUBLE) = floor(try_cast(replace(r, ',', '') AS DOUBLE)) AND try_cast(replace(r, ',', '') AS DOUBLE) BETWEEN 1900 AND 2099))"
LISTING = r"""lst AS (SELECT row_id, claim_id AS pmcid, CASE WHEN row_id % 3 = 0 THEN 2 ELSE 1 END AS version,
  claim_id || '.' || (CASE WHEN row_id % 3 = 0 THEN 2 ELSE 1 END) || '/' || regexp_replace(regexp_replace(evi_path, '^.*/', ''), '\.png$', CASE WHEN row_id % 5 = 0 THEN '.tif' WHEN row_id % 2 = 0 THEN '.gif' ELSE '.png' END) AS key FROM task1_gold WHERE evi_path IS NOT NULL AND claim_id IS NOT NULL)"""
TABLES = """tb AS (SELECT l_orderkey, l_linenumber, row_number() OVER w - 1 AS i, l_returnflag || ' line ' || l_linenumber AS c0, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS c1, printf('%.2f', l_extendedprice) AS c2, CAST(l_quantity AS BIGINT) AS q,
  CAST(max(l_quantity) OVER (PARTITION BY l_orderkey) AS BIGINT) AS most FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || ' line ' || l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), printf('%.2f', l_extendedprice)))"""
REF = r"(?i)\b(?:Tables?|Figs?\.?|Figures?)\s+S?\d+\b"


def _coin(seed: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || l_orderkey), 1, 8) AS BIGINT) / 4294967296::DOUBLE)"


def _pick(options: str, seed: str) -> str:
    return f"{options}[1 + CAST(floor({_coin(seed)} * len({options})) AS BIGINT)]"


_ROWS = f"{TABLES}, t AS (SELECT l_orderkey, any_value(most) AS most, list({{'i': i, 'c0': c0, 'd': c1 || ',' || c2, 'c1': c1, 'c2': c2, 'q': q, 'n': l_linenumber}} ORDER BY i) AS rs FROM tb GROUP BY l_orderkey)"
_LEAD = _pick("rs", "swap row")
_PARTNERS = "list_filter(rs, lambda r: r.d <> lead.d)"
_SWAPPED = "array_to_string(list_transform(rs, lambda r: r.c0 || ',' || CASE WHEN r.i = lead.i THEN partner.d WHEN r.i = partner.i THEN lead.d ELSE r.d END), ';')"
_ROW_SWAP = f"""WITH {_ROWS}, l AS (SELECT *, list_filter(rs, lambda r: l_orderkey % 3 = 0 AND lower(r.c0) = 'r line 2')[1] AS named FROM t WHERE len(list_distinct(list_transform(rs, lambda r: r.d))) > 1),
      p AS (SELECT *, coalesce(named, {_LEAD}) AS lead FROM l), x AS (SELECT *, {_pick(_PARTNERS, "swap partner")} AS partner FROM p)
      SELECT l_orderkey, CAST(lead.i AS INT) AS i, CAST(partner.i AS INT) AS j, named IS NOT NULL AS grounded, {_SWAPPED} AS after FROM x"""
_SCALED = "CAST(CAST(floor(r.q * f + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)"
_DRAWN = "value * greatest(0.01::DOUBLE, CASE WHEN w < 0.5 THEN 1 + (0.3::DOUBLE + k * 0.1::DOUBLE) * (1.0::DOUBLE + v * (1.4::DOUBLE - 1.0::DOUBLE)) ELSE 1 - (0.3::DOUBLE + k * 0.1::DOUBLE) * (1.0::DOUBLE + v * (1.4::DOUBLE - 1.0::DOUBLE)) END)"
_PRINTS = f"list_transform(range(0, 12), lambda k: CASE places WHEN 0 THEN CAST(CAST(floor({_DRAWN} + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) WHEN 1 THEN printf('%.1f', {_DRAWN}) ELSE printf('%.2f', {_DRAWN}) END)"
_PERTURBED = f"""WITH {_ROWS}, u AS (SELECT *, {_coin("operation")} AS u, {_coin("side")} AS w, {_coin("size")} AS v,
        {_pick("[10.0::DOUBLE, 100.0, 0.1, 0.01, 2.0, 0.5, 5.0, 0.2]", "factor")} AS f,
        flatten(list_transform(rs, lambda r: [{{'i': r.i, 'j': 0, 'value': r.n::DOUBLE, 'raw': r.n::VARCHAR}}, {{'i': r.i, 'j': 1, 'value': r.q::DOUBLE, 'raw': r.c1}}, {{'i': r.i, 'j': 2, 'value': r.c2::DOUBLE, 'raw': r.c2}}])) AS cells FROM t),
      o AS (SELECT *, CASE WHEN u < 0.25 AND len(list_distinct(list_transform(rs, lambda r: r.d))) > 1 THEN 'Swap rows or columns'
        WHEN u >= 0.25 AND u < 0.4 AND len(list_filter(rs, lambda r: {_SCALED} <> r.c1)) > 0 THEN 'Value scaling'
        WHEN u >= 0.4 AND u < 0.5 THEN 'Caption adjustments' ELSE 'Change the cell values' END AS operation, {_LEAD} AS lead FROM u),
      c AS (SELECT *, CASE WHEN operation = 'Swap rows or columns' THEN {_pick(_PARTNERS, "swap partner")} END AS partner,
        CASE WHEN operation = 'Change the cell values' THEN coalesce(list_filter(cells, lambda c: c.j = 1 AND c.value = most AND most >= 10)[1], {_pick("cells", "cell")}) END AS cell FROM o),
      d AS (SELECT *, coalesce(cell.raw, most || '.5') AS raw, coalesce(cell.value, most + 0.5::DOUBLE) AS value, CASE WHEN cell IS NULL THEN 1 WHEN cell.j = 2 THEN 2 ELSE 0 END AS places FROM c),
      e AS (SELECT *, list_filter({_PRINTS}, lambda x: x <> raw)[1] AS new FROM d)
      SELECT l_orderkey, operation, CASE operation WHEN 'Value scaling' THEN most >= 10 WHEN 'Change the cell values' THEN most >= 10 ELSE false END AS grounded,
        CASE operation WHEN 'Swap rows or columns' THEN {_SWAPPED}
          WHEN 'Value scaling' THEN array_to_string(list_transform(rs, lambda r: r.c0 || ',' || {_SCALED} || ',' || r.c2), ';')
          WHEN 'Caption adjustments' THEN array_to_string(list_transform(rs, lambda r: r.c0 || ',' || r.d), ';')
          ELSE array_to_string(list_transform(rs, lambda r: CASE WHEN r.i = cell.i AND cell.j = 0 THEN left(r.c0, 1) || ' line ' || new ELSE r.c0 END || ',' || CASE WHEN r.i = cell.i AND cell.j = 1 THEN new ELSE r.c1 END || ',' || CASE WHEN r.i = cell.i AND cell.j = 2 THEN new ELSE r.c2 END), ';') END AS after,
        CASE WHEN operation = 'Caption adjustments' THEN 'Table 3. Quantities of order, total ' || new || ' units' END AS perturbed_caption FROM e"""
_VALUE = "try_cast(replace(raws[k + 1], ',', '') AS DOUBLE)"
_CAPTION_NUMBER = rf"""WITH m AS (SELECT row_id, caption, claim, regexp_replace(caption, '{REF}', '', 'g') AS masked FROM task1_gold WHERE caption IS NOT NULL),
      g AS (SELECT *, regexp_extract_all(masked, '{NUM}', 0) AS raws, string_split_regex(masked, '{NUM}') AS gaps, len(regexp_extract_all(caption, '{NUM}', 0)) AS n,
        list_transform(list_filter(regexp_extract_all(regexp_replace(coalesce(claim, ''), '{REF}', '', 'g'), '{NUM}', 0), lambda r: {SPECIFIC}), lambda r: try_cast(replace(r, ',', '') AS DOUBLE)) AS targets FROM m),
      f AS (SELECT *, list_filter(range(0, len(raws)), lambda k: {SPECIFIC.replace("(r, ", "(raws[k + 1], ")} AND NOT regexp_matches(right(gaps[k + 1], 1), '[A-Za-z]') AND NOT regexp_matches(left(gaps[k + 2], 1), '[A-Za-z]')) AS fit FROM g),
      h AS (SELECT *, list_filter(fit, lambda k: len(list_filter(targets, lambda x: abs({_VALUE} - x) < 1e-6)) > 0)[1] AS hit FROM f WHERE len(fit) > 0)
      SELECT row_id, CAST(coalesce(hit, fit[1]) + CASE WHEN regexp_matches(caption, '(?i)^{REF[4:]}') THEN n - len(raws) ELSE 0 END AS INT) AS k, raws[coalesce(hit, fit[1]) + 1] AS raw, hit IS NOT NULL AS grounded FROM h"""
BOXES = """bx AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, text, conf, x1, h) - 1 AS i, * EXCLUDE (l_orderkey) FROM (SELECT l_orderkey, l_linenumber AS n,
  l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END AS text, l_linenumber * 8.0::DOUBLE AS x0, l_linenumber * 8.0::DOUBLE + l_quantity * 10 AS x1, l_quantity * 10 AS w, round(l_discount * 1000) + 50 AS h, l_linenumber * 40.0::DOUBLE AS cy, 0.3::DOUBLE + l_tax AS conf FROM lineitem))"""


def _near(a: str, b: str, k: str, t: float) -> str:
    return f"abs({a}.{k} - {b}.{k}) <= {t}::DOUBLE * greatest({a}.{k}, {b}.{k})"


def oracle_sql() -> dict[str, str]:
    out = {
        "score_individual": f"WITH {A1} " + _scores("a1", "run_name"),
        "confusion_matrix": f"""WITH {A1} SELECT run_name, count(*) FILTER (label = 'Refuted' AND pred_label = 'Refuted') AS rr, count(*) FILTER (label = 'Refuted' AND pred_label = 'Supported') AS rs,
          count(*) FILTER (label = 'Supported' AND pred_label = 'Refuted') AS sr, count(*) FILTER (label = 'Supported' AND pred_label = 'Supported') AS ss FROM a1 GROUP BY run_name""",
        "unanswered_claims": f"WITH {HELD} SELECT row_id, claim_id FROM held WHERE NOT EXISTS (SELECT 1 FROM task1_pred p WHERE p.claim_id = held.claim_id)",
        "pair_accuracy": f"WITH {P1}, {HELD} SELECT *, round(CASE WHEN n_pairs = 0 THEN 0.0 ELSE n_right * 1.0 / n_pairs END, 6) AS pair_accuracy FROM ({_pairs('true')})",
        "pair_accuracy_by_context": f"WITH {P1}, {HELD} " + " UNION ALL ".join(f"SELECT *, round(CASE WHEN n_pairs = 0 THEN 0.0 ELSE n_right * 1.0 / n_pairs END, 6) AS pair_accuracy, '{k}' AS context FROM ({_pairs(_CONTEXTS[k])})" for k in ("no", "yes")),
        "task2_accuracy": f"WITH {A2} SELECT run_name, count(*) AS n, round(count(*) FILTER (label = pred_label) * 1.0 / count(*), 6) AS accuracy FROM a2 GROUP BY run_name",
        "per_file_accuracy": f"WITH {A2} SELECT run_name, count(*) AS total, count(*) FILTER (lower(label) = lower(pred_label)) AS correct, count(*) FILTER (coalesce(pred_label, '') = '') AS empty, round(count(*) FILTER (lower(label) = lower(pred_label)) * 1.0 / count(*), 6) AS accuracy FROM a2 GROUP BY run_name",
        "run_ranking": f"WITH {A2} SELECT run_name, round(count(*) FILTER (lower(label) = lower(pred_label)) * 1.0 / count(*), 6) AS accuracy FROM a2 GROUP BY run_name ORDER BY accuracy DESC NULLS LAST",
        "leaderboard": _leaderboard(),
        "paired_outcomes": f"""WITH {BOTH} SELECT evi_type, count(*) AS n, count(*) FILTER (r1 AND r2) AS both_right, count(*) FILTER (NOT r1 AND NOT r2) AS both_wrong, count(*) FILTER (r1 AND NOT r2) AS regressed,
          count(*) FILTER (NOT r1 AND r2) AS improved, count(*) FILTER (NOT r1 AND r2) - count(*) FILTER (r1 AND NOT r2) AS net FROM b GROUP BY ROLLUP (evi_type)""",
        "majority_baseline": f"""WITH {BOTH}, k AS (SELECT evi_type, label, count(*) AS c, count(*) FILTER (r1) AS x, count(*) FILTER (r2) AS y FROM b GROUP BY ALL)
          SELECT evi_type, CAST(sum(c) AS BIGINT) AS n, round(sum(x) / sum(c), 6) AS first_accuracy, round(sum(y) / sum(c), 6) AS second_accuracy, round((sum(y) - sum(x)) / sum(c), 6) AS delta, round(max(c) / sum(c), 6) AS majority FROM k GROUP BY evi_type""",
        "label_distribution": "SELECT split, label, count(*) AS n FROM task1_gold GROUP BY ALL",
        "value_counts": " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, 'N/A') AS value, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM task1_gold), 6) AS share FROM task1_gold GROUP BY 2" for f in ("domain", "evi_type", "use_context", "license_name")),
        "most_common_operation": "SELECT operation, count(*) AS n, min(row_id) AS first_seen FROM task1_gold GROUP BY operation ORDER BY n DESC, first_seen",
        "length_stats": " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, min(w) AS least, max(w) AS most, round(avg(w), 6) AS mean, round(median(w), 6) AS median FROM (SELECT {WORDS.format(f)} AS w FROM task1_gold) WHERE w > 0" for f in ("claim", "caption", "context")),
        "group_sizes": "SELECT count(*) AS groups, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT paper_id, count(*) AS n FROM task1_gold GROUP BY paper_id)",
        "missing_duplicates": " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, count(*) FILTER (coalesce({f}, '') = '') AS missing, count(*) - count(DISTINCT coalesce({f}, '')) AS duplicates FROM task1_gold" for f in ("claim_id", "paper_id", "claim_id_pair", "evi_path")),
        "field_inventory": "SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY field",
        "dataset_overlap": """WITH a AS (SELECT DISTINCT claim_id FROM task1_gold WHERE claim_id IS NOT NULL), b AS (SELECT DISTINCT claim_id FROM task1_pred WHERE claim_id IS NOT NULL)
          SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (claim_id)) AS n_both, (SELECT count(*) FROM a ANTI JOIN b USING (claim_id)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (claim_id)) AS only_b""",
        "panel_stats": """WITH f AS (SELECT CASE WHEN coalesce(text, '') <> '' THEN len(string_split(text, ' | ')) - 3 END AS p FROM advisor_cache WHERE evi_type = 'figure'), k AS (SELECT CASE WHEN p IS NULL THEN 'unparsed' WHEN p > 1 THEN 'composite' ELSE 'single' END AS kind, count(*) AS n FROM f GROUP BY 1)
          SELECT kind, n, round(n * 1.0 / (SELECT sum(n) FROM k), 6) AS share FROM k""",
        "chart_types": "SELECT coalesce(evi_type, 'unknown') AS type, CASE WHEN coalesce(text, '') <> '' THEN len(string_split(text, ' | ')) END AS num_panels, count(*) AS n FROM advisor_cache GROUP BY 1, 2",
        "stage_counts": rf"""WITH s AS (SELECT coalesce(regexp_matches(claim, '(?i)\bTables?\s+\d+\b'), false) AS m, coalesce({OWN_T.format('claim')}, false) AS o, coalesce({WORTHY.format('claim')}, false) AS w FROM task1_gold)
          SELECT 'scanned' AS stage, count(*) AS n FROM s UNION ALL SELECT 'mentions', count(*) FILTER (m) FROM s UNION ALL SELECT 'own', count(*) FILTER (m AND o) FROM s UNION ALL SELECT 'worthy', count(*) FILTER (m AND o AND w) FROM s""",
        "id_union_counts": """WITH s AS (SELECT DISTINCT 'gold' AS source, claim_id FROM task1_gold WHERE claim_id <> '' UNION ALL SELECT DISTINCT 'predictions', claim_id FROM task1_pred WHERE claim_id <> '')
          SELECT source, count(DISTINCT claim_id) AS n FROM s GROUP BY ROLLUP (source)""",
        "footprint_rollup": """WITH r AS (SELECT evi_path, CASE WHEN evi_path LIKE 'figures/%' THEN 'figure' ELSE 'table' END AS evi_type, max(length(claim) / 100.0::DOUBLE) AS v FROM task1_gold GROUP BY 1, 2), s AS (SELECT evi_type, v FROM r WHERE v IS NOT NULL UNION ALL SELECT NULL, v FROM r WHERE v IS NOT NULL)
          SELECT evi_type, count(*) AS n, round(avg(v), 6) AS mean, round(max(v), 6) AS most, round(list_sort(list(v))[CAST(floor(count(*) * 9 / 10) AS BIGINT) + 1], 6) AS p90 FROM s GROUP BY evi_type""",
        "parse_task1": f"WITH {PARSED1} SELECT run_name, claim_id, predicted_at, {LABEL1} AS label FROM parsed",
        "default_labels": f"WITH {PARSED1} SELECT run_name, claim_id, predicted_at, coalesce({LABEL1}, 'Refuted') AS label, found IS NULL AS is_fallback FROM parsed",
        "strip_thinking": rf"WITH {ANSWERS}, w AS (SELECT *, {STRIP.format(chr(39).join(['regexp_replace(answer, ', '(?is)<think>.*?</think>', ', ', '', ', ', 'g', ')']))} AS s FROM ans) SELECT run_name, claim_id, predicted_at, CASE WHEN s <> '' THEN s ELSE {STRIP.format('answer')} END AS answer FROM w",
        "parse_task2": r"""WITH t AS (SELECT run_name, sample_id, CASE right(sample_id, 1)::INT % 3 WHEN 0 THEN 'evidence_id_2 is weak. Final answer: ' || coalesce(pred_label, 'none') WHEN 1 THEN 'So the final answer is: Answer: $' || regexp_extract(coalesce(pred_label, ''), '([12])$', 1) ELSE 'I pick answer ' || regexp_extract(coalesce(pred_label, ''), '([12])$', 1) || ' here' END AS a FROM task2_pred)
          SELECT run_name, sample_id, lower(coalesce(nullif(regexp_extract(a, '(?is)final\s*answer.{0,40}?(?:(evidence_id_[12])|\banswer\s*:?\s*\$?\s*([12])\b)', 1), ''), 'evidence_id_' || nullif(regexp_extract(a, '(?is)final\s*answer.{0,40}?(?:(evidence_id_[12])|\banswer\s*:?\s*\$?\s*([12])\b)', 2), ''),
            regexp_extract_all(a, '(?i)\b(evidence_id_[12])\b', 1)[-1], 'evidence_id_' || regexp_extract_all(a, '(?i)\banswer\s*:?\s*\$?\s*([12])\b', 1)[-1])) AS label FROM t""",
        "skip_filter": rf"""WITH t AS (SELECT image_path, CASE WHEN length(text) % 5 = 0 THEN 'skip' WHEN length(text) % 5 = 1 THEN '''' || text || '''' ELSE text END AS a FROM advisor_cache),
          s AS (SELECT image_path, {STRIP.format("regexp_replace(" + STRIP.format("a") + ", '^[\"'']|[\"'']$', '', 'g')")} AS claim FROM t) SELECT image_path, claim FROM s WHERE upper(claim) <> 'SKIP' AND claim <> ''""",
        "merge_baseline_fallback": f"WITH {P2} SELECT b.sample_id, coalesce(a.pred_label, b.pred_label) AS pred_label, CASE WHEN a.pred_label IS NOT NULL THEN 'advisor' ELSE 'baseline' END AS origin FROM p2 b LEFT JOIN p2 a ON a.sample_id = b.sample_id AND a.run_name = 'chart_helper' WHERE b.run_name = 'solo_reader'",
        "merge_routed": f"""WITH {P2}, {G2} SELECT g2.sample_id, evi_type, CASE WHEN evi_type = 'figure' AND c.pred_label IS NOT NULL THEN c.pred_label WHEN evi_type = 'table' AND t.pred_label IS NOT NULL THEN t.pred_label ELSE s.pred_label END AS pred_label,
          CASE WHEN evi_type = 'figure' AND c.pred_label IS NOT NULL THEN 'figure' WHEN evi_type = 'table' AND t.pred_label IS NOT NULL THEN 'table' ELSE 'fallback' END AS route FROM g2
          LEFT JOIN p2 c ON c.sample_id = g2.sample_id AND c.run_name = 'chart_helper' LEFT JOIN p2 t ON t.sample_id = g2.sample_id AND t.run_name = 'grid_helper' LEFT JOIN p2 s ON s.sample_id = g2.sample_id AND s.run_name = 'solo_reader'""",
        "merge_shards": "SELECT run_name, claim_id, pred_label, predicted_at, 0 AS shard FROM task1_pred WHERE run_name = 'two_step_reader' UNION ALL SELECT run_name, claim_id, pred_label, predicted_at, 1 FROM task1_pred WHERE run_name = 'solo_reader' UNION ALL SELECT run_name, claim_id, pred_label, NULL, 2 FROM task1_pred WHERE run_name = 'solo_reader'",
        "advisor_prompt": f"""WITH {READINGS} SELECT row_id, 'Claim: ' || coalesce(claim, '') || chr(10) || 'Caption: ' || coalesce(caption, 'N/A') || chr(10) || 'Context: ' || coalesce(nullif(context, ''), 'N/A') || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || chr(10) || 'Advisor reading:' || chr(10) || text ELSE '' END AS prompt
          FROM task1_gold LEFT JOIN rd ON rd.image_path = evi_path""",
        "advisor_prompt_pair": f"""WITH {READINGS} SELECT sample_id, CASE WHEN evi_type = 'figure' THEN 'Which figure backs the claim?' ELSE 'Which evidence backs the claim?' END || chr(10) || 'Claim: ' || coalesce(claim, '') || CASE WHEN coalesce(x.text, '') <> '' THEN chr(10) || chr(10) || 'Evidence 1:' || chr(10) || x.text ELSE '' END || CASE WHEN coalesce(y.text, '') <> '' THEN chr(10) || chr(10) || 'Evidence 2:' || chr(10) || y.text ELSE '' END AS prompt
          FROM (SELECT DISTINCT sample_id, claim, evi_type, evidence_id_1, evidence_id_2 FROM task2_gold) g LEFT JOIN rd x ON x.image_path = evidence_id_1 LEFT JOIN rd y ON y.image_path = evidence_id_2""",
        "resume_remaining": f"WITH {HELD} SELECT row_id, claim_id FROM held WHERE NOT EXISTS (SELECT 1 FROM task1_pred p WHERE p.claim_id = held.claim_id AND run_name = 'solo_reader')",
        "stride_shard": "SELECT row_id, claim_id FROM (SELECT row_id, claim_id, row_number() OVER (ORDER BY row_id) - 1 AS k FROM task1_gold) WHERE k % 4 = 1",
        "shard_then_resume": f"""WITH {HELD}, s AS (SELECT row_id, claim_id, row_number() OVER (ORDER BY row_id) - 1 AS k FROM held WHERE lower(trim(evi_type)) = 'figure')
          SELECT row_id, claim_id FROM s WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM task1_pred p WHERE p.claim_id = s.claim_id AND run_name = 'solo_reader')""",
        "ids_file": "SELECT row_id, claim_id FROM task1_gold WHERE claim_id IN (SELECT claim_id FROM task1_pred WHERE pred_label IS NULL)",
        "discover_images": """SELECT path, min(source) AS source, CASE WHEN path LIKE 'tables_png/%' THEN 'table' ELSE 'figure' END AS evi_type FROM (SELECT evi_path AS path, 1 AS source FROM task1_gold UNION ALL SELECT evidence_id_1, 2 FROM task2_gold UNION ALL SELECT evidence_id_2, 2 FROM task2_gold) WHERE path IS NOT NULL GROUP BY path""",
        "with_readings_only": "SELECT row_id, evi_path FROM task1_gold WHERE evi_path IN (SELECT image_path FROM advisor_cache WHERE text <> '')",
        "figure_paths": "SELECT DISTINCT path FROM (SELECT evi_path AS path FROM task1_gold UNION ALL SELECT evidence_id_1 FROM task2_gold UNION ALL SELECT evidence_id_2 FROM task2_gold) WHERE path LIKE 'figures/%'",
        "split_sentences": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x0B]+([A-Z0-9])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: regexp_replace(s, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, CAST(unnest(generate_series(1, len(l))) - 1 AS BIGINT) AS pos, unnest(l) AS sentence FROM p""",
        "claim_mentions": rf"""SELECT row_id, {OWN_T.format('claim')} AS own_table, {OWN_F.format('claim')} AS own_figure, coalesce({DIGITS.format('claim', SPAN_T)}, '') AS tables, coalesce({DIGITS.format('claim', SPAN_F)}, '') AS figures
          FROM task1_gold WHERE regexp_matches(claim, '(?i)\bTables?\s+\d+\b') OR regexp_matches(claim, '(?i)\b(?:Figures?|Figs?\.?)\s+\d+\b')""",
        "claim_worthy": f"SELECT row_id, {WORTHY.format('claim')} AS worthy FROM task1_gold",
        "mined_claims": rf"""WITH s AS (SELECT row_id, caption, regexp_extract(claim, '(?i)\bTables?\s+(\d+)', 1) AS first, list_filter(list_transform(string_split(regexp_replace(claim, '([.!?])[\s\x0B]+([A-Z0-9])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: regexp_replace(s, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda s: s <> '') AS l FROM task1_gold WHERE regexp_matches(claim, '(?i)\bTables?\s+\d+\b')),
          e AS (SELECT row_id, caption, first, unnest(l) AS sentence FROM s), n AS (SELECT *, {DIGITS.format('sentence', SPAN_T)} AS number FROM e WHERE {OWN_T.format('sentence')} AND {WORTHY.format('sentence')})
          SELECT CAST(row_id AS VARCHAR) AS pmcid, number, sentence, 't2' AS xref_id, upper(caption) AS caption FROM n WHERE number NOT LIKE '%,%' AND number = first""",
        "doc_summary": "SELECT CAST(row_id AS VARCHAR) AS pmcid, 2 AS n_sections, 1 AS n_paragraphs, 2 AS n_tables, 1 AS n_figures FROM task1_gold",
        "exclusion_list": r"""WITH p AS (SELECT coalesce(nullif(paper_id, ''), nullif(regexp_extract(paper_path, 'peerj_(\d+)\.json$', 1), '')) AS id FROM task1_gold WHERE lower(trim(domain)) = 'peerj' UNION ALL SELECT coalesce(nullif(paper_id, ''), nullif(regexp_extract(paper_path, 'peerj_(\d+)\.json$', 1), '')) FROM task2_gold WHERE lower(trim(domain)) = 'peerj')
          SELECT DISTINCT id FROM p WHERE id IN (SELECT paper_id FROM documents)""",
        "bucket_quota": """WITH d AS (SELECT doc_id, CASE WHEN section = 'results' THEN 'a' ELSE 'b' END AS bucket FROM documents UNION ALL SELECT doc_id, 'b' FROM documents WHERE section IN ('results', 'methods')),
          o AS (SELECT DISTINCT * FROM d WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE section = 'abstract')), a AS (SELECT doc_id, bucket FROM o WHERE bucket = 'a' ORDER BY doc_id LIMIT 30), b AS (SELECT doc_id, bucket FROM o WHERE bucket = 'b' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY doc_id LIMIT 50) SELECT * FROM a UNION ALL SELECT * FROM b""",
        "search_documents": "SELECT doc_id, source AS licence FROM documents WHERE source IN ('openshelf_bulk', 'tovl_mirror') AND contains(lower(text), 'replay buffer') ORDER BY doc_id LIMIT 25",
        "latest_version": f"WITH {LISTING} SELECT row_id, pmcid, version, key FROM (SELECT *, max(version) OVER (PARTITION BY pmcid) AS m FROM lst) WHERE version = m",
        "best_file": rf"""WITH {LISTING}, w AS (SELECT DISTINCT claim_id AS pmcid, regexp_replace(evi_path, '^.*/', '') AS graphic FROM task1_gold WHERE evi_path IS NOT NULL)
          SELECT pmcid, graphic, key FROM (SELECT w.pmcid, graphic, key, row_number() OVER (PARTITION BY w.pmcid, graphic ORDER BY CASE WHEN key LIKE '%.png' THEN 3 WHEN key LIKE '%.tif' THEN 4 WHEN key LIKE '%.gif' THEN 6 ELSE 9 END, row_id) AS k FROM w JOIN lst ON w.pmcid = lst.pmcid AND regexp_replace(graphic, '\.[^.]*$', '') = regexp_replace(regexp_replace(key, '^.*/', ''), '\.[^.]*$', '')) WHERE k = 1""",
        "extract_numbers": f"SELECT row_id, array_to_string(regexp_extract_all(claim, '{NUM}', 0), ' ') AS raws, CAST(len(list_filter(regexp_extract_all(claim, '{NUM}', 0), lambda r: {SPECIFIC})) AS BIGINT) AS n_specific FROM task1_gold",
        "claim_targets": rf"""WITH n AS (SELECT row_id, unnest(list_filter(regexp_extract_all(regexp_replace(claim, '(?i)\b(?:Tables?|Figs?\.?|Figures?)\s+S?\d+\b', '', 'g'), '{NUM}', 0), lambda r: {SPECIFIC})) AS r FROM task1_gold) SELECT DISTINCT row_id, round(try_cast(replace(r, ',', '') AS DOUBLE), 6) AS target FROM n""",
        "cell_kinds": rf"""WITH c AS (SELECT image_path, unnest(string_split(text, ' | ')) AS cell FROM advisor_cache) SELECT image_path, count(*) FILTER (regexp_matches(cell, '(?i:\bet al\b)|[A-Z][a-zA-Z''\-]+(?:\s+(?:and|&)\s+[A-Z][a-zA-Z''\-]+)?\s*[\(\[]\d{{4}}[\)\]]')) AS citations, count(*) FILTER (regexp_matches(cell, '^\s*<?\s*0?\.\d+\s*$')) AS p_values,
          count(*) FILTER (regexp_matches(regexp_replace(replace({STRIP.format('cell')}, '%', ''), '[,.\-]', '', 'g'), '^\d+$')) AS numeric, count(*) AS cells FROM c GROUP BY image_path""",
        "grounded_cell": f"WITH {TABLES} SELECT l_orderkey, CAST(min(i) AS INT) AS i, 1 AS j, CAST(most AS VARCHAR) AS raw FROM tb WHERE q = most AND most >= 10 GROUP BY l_orderkey, most",
        "cell_edit": f"""WITH {TABLES}, hit AS (SELECT l_orderkey, min(i) AS i FROM tb WHERE q = most AND most >= 10 GROUP BY l_orderkey),
          r AS (SELECT tb.*, hit.i AS h FROM tb LEFT JOIN hit USING (l_orderkey))
          SELECT l_orderkey, CAST(CASE WHEN any_value(h) IS NULL THEN CAST(min(l_linenumber) * 3 AS VARCHAR) ELSE CAST(any_value(most) * 3 AS VARCHAR) END AS VARCHAR) AS new, any_value(h) IS NOT NULL AS grounded,
            string_agg((CASE WHEN h IS NULL AND i = 0 THEN left(c0, 1) || ' line ' || CAST(l_linenumber * 3 AS VARCHAR) ELSE c0 END) || ',' || (CASE WHEN i = h THEN CAST(q * 3 AS VARCHAR) ELSE c1 END) || ',' || c2, ';' ORDER BY i) AS after FROM r GROUP BY l_orderkey""",
        "column_scale": f"""WITH {TABLES}, p AS (SELECT l_orderkey, l_orderkey % 2 = 1 AND NOT (c2 LIKE '%.00' AND c2::DOUBLE BETWEEN 1900 AND 2099) AS by_price FROM tb WHERE i = 0)
          SELECT l_orderkey, CASE WHEN any_value(by_price) THEN 2 ELSE 1 END AS column_no, any_value(by_price) AS grounded,
          string_agg(c0 || ',' || CASE WHEN by_price THEN c1 || ',' || printf('%.2f', c2::DOUBLE * 10) ELSE CAST(q * 10 AS VARCHAR) || ',' || c2 END, ';' ORDER BY i) AS after FROM tb JOIN p USING (l_orderkey) GROUP BY l_orderkey""",
        "row_swap": _ROW_SWAP,
        "caption_number": _CAPTION_NUMBER,
        "perturbed_tables": _PERTURBED,
        "training_pairs": """WITH p AS (SELECT claim_id || '_' || row_id AS pair, * FROM task1_gold) SELECT pair || '_s' AS claim_id, 'Supported' AS label, pair AS claim_id_pair, caption, 'Supported_claim_only' AS operation, evi_path FROM p
          UNION ALL SELECT pair || '_r', 'Refuted', pair, coalesce(CASE WHEN operation = 'Caption adjustments' THEN upper(caption) END, caption), operation, 'perturbed/' || evi_path FROM p WHERE operation <> 'Supported_claim_only' AND evi_path IS NOT NULL""",
        "evidence_side": """WITH p AS (SELECT 'fig_' || claim_id || '_' || row_id AS sample_id, evi_path AS t, 'perturbed/' || evi_path AS f FROM task1_gold WHERE operation <> 'Supported_claim_only' AND operation <> 'Caption adjustments' AND evi_path IS NOT NULL), e AS (SELECT *, contains('02468ace', substr(sha256(sample_id), 2, 1)) AS even FROM p)
          SELECT sample_id, CASE WHEN even THEN t ELSE f END AS evidence_id_1, CASE WHEN even THEN f ELSE t END AS evidence_id_2, CASE WHEN even THEN 'evidence_id_1' ELSE 'evidence_id_2' END AS label FROM e""",
        "training_union": "SELECT 'task1' AS kind, 0 AS part, label, count(*) AS n, count(operation) AS n_operation FROM task1_gold GROUP BY label UNION ALL SELECT 'task2', 1, label, count(*), 0 FROM task2_gold GROUP BY label",
        "holdout_split": "SELECT row_id, claim_id_pair FROM task1_gold WHERE claim_id_pair IN (SELECT claim_id_pair FROM (SELECT DISTINCT claim_id_pair FROM task1_gold WHERE claim_id_pair IS NOT NULL) ORDER BY sha256('42:' || claim_id_pair), claim_id_pair LIMIT 100)",
        "swappable_pairs": f"WITH {BOXES}, z AS (SELECT l_orderkey, i, CAST(trunc(x1) - trunc(x0) AS DOUBLE) AS w, CAST(trunc(h) AS DOUBLE) AS h FROM bx) SELECT a.l_orderkey, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j FROM z a JOIN z b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND {_near('a', 'b', 'w', 0.15)} AND {_near('a', 'b', 'h', 0.15)}",
        "category_pairs": rf"""WITH {BOXES}, f AS (SELECT * EXCLUDE (i), row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS i FROM bx WHERE conf >= 0.35::DOUBLE), z AS (SELECT * FROM f WHERE NOT regexp_matches(text, '^\d+$')) SELECT a.l_orderkey, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j FROM z a JOIN z b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND lower(a.text) <> lower(b.text) AND {_near('a', 'b', 'h', 0.2)} AND {_near('a', 'b', 'w', 0.3)} AND (abs(a.cy - b.cy) <= 12 OR abs(a.x0 - b.x0) <= 12)""",
        "size_caps": "WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity * 100 AS h, l_extendedprice / 10 + 1 AS w FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(1.0, 2048.0 / greatest(h, w)), 6) AS by_side, round(least(1.0, sqrt(3e6 / (h * w))), 6) AS by_pixels, round(least(1536 / h, 1240 / w, 1.0), 6) AS by_box FROM s",
        "table_layout": f"WITH {TABLES} SELECT l_orderkey, least(max(length(c0)), 40) || ',' || least(max(length(c1)), 40) || ',' || least(max(length(c2)), 40) AS widths FROM tb GROUP BY l_orderkey",
        "decide_pair": f"""WITH {P1}, r AS (SELECT x.claim_id, x.pred_label IS NOT DISTINCT FROM 'Supported' AS a, y.pred_label IS NOT DISTINCT FROM 'Supported' AS b FROM p1 x JOIN p1 y ON x.claim_id = y.claim_id AND x.run_name = 'solo_reader' AND y.run_name = 'two_step_reader')
          SELECT claim_id, CASE WHEN a AND NOT b THEN 'evidence_id_1' WHEN b AND NOT a THEN 'evidence_id_2' WHEN ascii(right(claim_id, 1)) % 3 = 0 THEN 'evidence_id_2' ELSE 'evidence_id_1' END AS label, CASE WHEN a <> b THEN 'decisive' ELSE 'fallback' END AS mode, a = b AS joint_call FROM r""",
        "decision_modes": f"""WITH {P1}, r AS (SELECT x.claim_id, x.pred_label IS NOT DISTINCT FROM 'Supported' AS a, y.pred_label IS NOT DISTINCT FROM 'Supported' AS b FROM p1 x JOIN p1 y ON x.claim_id = y.claim_id AND x.run_name = 'solo_reader' AND y.run_name = 'two_step_reader'),
          d AS (SELECT claim_id, a <> b AS decisive, CASE WHEN a AND NOT b THEN 1 WHEN b AND NOT a THEN 2 WHEN ascii(right(claim_id, 1)) % 3 = 0 THEN 2 ELSE 1 END AS label, CASE WHEN ascii(right(claim_id, 1)) % 2 = 0 THEN 1 ELSE 2 END AS gold FROM r)
          SELECT CASE WHEN decisive THEN 'decisive' ELSE 'fallback' END AS mode, count(*) AS n, count(*) FILTER (label = gold) AS right FROM d GROUP BY 1""",
        "formatted_scores": f"WITH {A2} SELECT run_name, printf('%.1f', floor(count(*) FILTER (label = pred_label) * 1.0 / count(*) * 1000) / 1000 * 100) AS accuracy FROM a2 GROUP BY run_name",
        "figure_classes": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS INT) END AS num_panels, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE 'parse_error' END AS type, CASE WHEN event_id % 5 <> 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM events",
        "echo_inference": r"SELECT row_id, regexp_replace(regexp_replace(claim, '\s+', ' ', 'g'), '\s+$', '') AS answer, CAST(NULL AS VARCHAR) AS error FROM task1_gold WHERE claim IS NOT NULL",
        "path_parts": r"SELECT row_id, regexp_replace(regexp_replace(evi_path, '^.*/', ''), '\.[^.]*$', '') AS stem, '.' || regexp_extract(evi_path, '\.([^.]*)$', 1) AS extension, evi_path AS path, 'a%20b/' || replace(url_encode(coalesce(operation, '')), '%2F', '/') AS encoded FROM task1_gold WHERE evi_path IS NOT NULL",
        "stream_resume": "SELECT run_name, claim_id, predicted_at, upper(left(pred_label, 1)) || lower(substr(pred_label, 2)) AS label FROM task1_pred",
    }
    return out
