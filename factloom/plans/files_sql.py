"""DuckDB SQL of the queries that go through files, services and images: what comes back is what the tables say."""

from __future__ import annotations

from factloom.plans.sql import DIGITS, HELD, OWN_F, P1, SPAN_F, STRIP, WORDS, COMPARES

_WORTHY_F = rf"""({WORDS} >= 8 AND (regexp_matches(regexp_replace({{0}}, '{SPAN_F}', '', 'g'), '\d') OR {COMPARES})
  AND (NOT regexp_matches({{0}}, '(?i)\b(see|refer(s|red)?\s+to)\b') OR {COMPARES}))"""
_IMAGES = "im AS (SELECT CAST(o_orderkey AS VARCHAR) AS image_id, o_orderkey AS k, 20 + o_orderkey % 7 AS w1, 3 + o_orderkey % 9 AS gap, 20 + o_orderkey % 13 AS w2 FROM orders)"


def oracle_sql() -> dict[str, str]:
    return {
        "json_array_file": "SELECT claim_id, paper_id, claim, label, caption, context, claim_id_pair FROM task1_gold",
        "json_lines_file": "SELECT run_name, claim_id, pred_label FROM task1_pred WHERE run_name IS NOT NULL",
        "advisor_cache_file": "SELECT image_path, max(text) AS text FROM advisor_cache WHERE image_path IS NOT NULL GROUP BY image_path",
        "id_list_file": f"SELECT DISTINCT {STRIP.format('claim_id_pair')} AS pair FROM task1_gold WHERE {STRIP.format('claim_id_pair')} <> ''",
        "documents_folder": r"""WITH g AS (SELECT CAST(row_id AS VARCHAR) AS pmcid, caption, 'Table ' || regexp_extract(claim, '(?i)\bTables?\s+(\d+)', 1) AS label FROM task1_gold WHERE split = 'dev')
          SELECT pmcid, 'Results' AS section_title, 0 AS content_pos, 'p' AS tag, NULL AS label, NULL AS caption FROM g UNION ALL SELECT pmcid, 'Results', 1, 'table', label, caption FROM g
          UNION ALL SELECT pmcid, 'Appendix', 0, 'table', label, upper(caption) FROM g UNION ALL SELECT pmcid, 'Appendix', 1, 'fig', 'Figure 1', NULL FROM g""",
        "prediction_folder": "SELECT run_name AS model, pred_label AS label, count(*) AS n FROM task1_pred GROUP BY ALL",
        "json_map_files": "SELECT image_path, CAST(max(length(text)) AS INT) AS num_panels, max(evi_type) AS type, 0.5::DOUBLE AS confidence FROM advisor_cache WHERE image_path IS NOT NULL GROUP BY image_path",
        "report_file": """WITH c AS (SELECT split, evi_type, count(*) AS n, count(caption) AS captions FROM task1_gold GROUP BY ALL)
          SELECT split, evi_type, 'n' AS metric, n::DOUBLE AS value FROM c UNION ALL SELECT split, evi_type, 'captions', captions::DOUBLE FROM c""",
        "document_cache": "SELECT doc_id, source, n_chars FROM documents",
        "bucket_listing": "SELECT source || '/' || doc_id AS key, n_chars AS size FROM documents WHERE n_chars IS NOT NULL",
        "image_files": "SELECT n_nationkey || '.png' AS image_id, CAST(20 + n_nationkey AS INT) AS height, CAST(10 + 2 * n_nationkey AS INT) AS width, 'C864' || lpad(upper(to_hex(n_nationkey)), 2, '0') AS pixel FROM nation",
        "resolved_ids": "SELECT doc_id, 'PMC' || (doc_id * 7) AS pmcid FROM documents WHERE doc_id % 3 <> 0",
        "fetched_documents": "SELECT doc_id, doc_id % 3 <> 0 AS found, CASE WHEN doc_id % 3 <> 0 THEN 'PMC' || (doc_id * 7) END AS pmcid FROM documents",
        "fetched_objects": "SELECT doc_id, doc_id % 5 <> 0 AS found, CASE WHEN doc_id % 5 <> 0 THEN length(repeat('content of ' || doc_id, doc_id % 4)) END AS size, CASE WHEN doc_id % 5 <> 0 THEN md5(repeat('content of ' || doc_id, doc_id % 4)) END AS digest FROM documents",
        "searched_pages": "SELECT lower(n_name) AS query, CAST(i AS INT) AS rank, lower(n_name) || '-' || i AS pmcid, 'Result ' || i AS title FROM nation, unnest(range(0, 45)) AS r(i) WHERE i < 10 * length(n_name)",
        "first_work": f"""WITH {HELD}, k AS (SELECT row_id, claim_id, row_number() OVER (ORDER BY row_id) - 1 AS n FROM held WHERE claim_id IN (SELECT claim_id FROM task1_pred WHERE run_name = 'two_step_reader')),
          f AS (SELECT * FROM k WHERE n % 2 = 1 ORDER BY row_id LIMIT 150) SELECT row_id, claim_id FROM f WHERE claim_id NOT IN (SELECT claim_id FROM task1_pred WHERE run_name = 'solo_reader' AND claim_id IS NOT NULL)""",
        "shard_resume": f"""WITH {HELD} SELECT row_id, claim_id FROM held WHERE NOT EXISTS (SELECT 1 FROM task1_pred p WHERE p.claim_id = held.claim_id AND (pred_label = 'Supported' OR run_name = 'two_step_reader' AND pred_label = 'Refuted'))""",
        "present_shards": "SELECT sample_id, run_name, pred_label, CASE WHEN run_name = 'solo_reader' THEN 0 ELSE 1 END AS shard FROM task2_pred WHERE run_name IN ('solo_reader', 'chart_helper')",
        "debug_rows": f"""WITH {P1}, r AS (SELECT x.claim_id, x.pred_label AS one, y.pred_label AS two, x.pred_label IS NOT DISTINCT FROM 'Supported' AS a, y.pred_label IS NOT DISTINCT FROM 'Supported' AS b FROM p1 x JOIN p1 y ON x.claim_id = y.claim_id AND x.run_name = 'solo_reader' AND y.run_name = 'two_step_reader')
          SELECT claim_id, CASE WHEN a <> b THEN 'decisive' ELSE 'fallback' END AS mode, one, two, CAST(NULL AS VARCHAR) AS joint, CASE WHEN b AND NOT a THEN 'evidence_id_2' ELSE 'evidence_id_1' END AS label, CASE WHEN a = b THEN 3 ELSE 2 END AS calls FROM r""",
        "detected_panels": f"""WITH {_IMAGES} SELECT image_id, 0 AS n, 0 AS x0, 0 AS y0, CASE WHEN gap >= 6 THEN w1 ELSE w1 + gap + w2 END AS x1, 30 AS y1 FROM im UNION ALL SELECT image_id, 1, w1 + gap, 0, w1 + gap + w2, 30 FROM im WHERE gap >= 6""",
        "swapped_figures": f"""WITH {_IMAGES}, s AS (SELECT *, gap >= 6 AND abs(w1 - w2) <= 0.15::DOUBLE * greatest(w1, w2) AS g FROM im)
          SELECT image_id, CASE WHEN g THEN 'Graph Swap' WHEN k % 2 = 1 THEN 'Category Swap' END AS operation, CASE WHEN g OR k % 2 = 1 THEN 0 END AS a0, CASE WHEN g THEN w1 WHEN k % 2 = 1 THEN 8 END AS a1,
            CASE WHEN g THEN w1 + gap WHEN k % 2 = 1 THEN 12 END AS b0, CASE WHEN g THEN w1 + gap + w2 WHEN k % 2 = 1 THEN 20 END AS b1, CASE WHEN g THEN '5A' WHEN k % 2 = 1 THEN '32' END AS first FROM s""",
        "figure_claims": rf"""WITH s AS (SELECT row_id, regexp_extract(claim, '(?i)\b(?:Figures?|Figs?\.?)\s+(\d+)', 1) AS first, list_filter(list_transform(string_split(regexp_replace(claim, '([.!?])[\s\x0B]+([A-Z0-9])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: regexp_replace(s, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda s: s <> '') AS l
            FROM task1_gold WHERE regexp_matches(claim, '(?i)\b(?:Figures?|Figs?\.?)\s+\d+\b') AND row_id % 2 = 0),
          e AS (SELECT row_id, first, unnest(l) AS sentence FROM s), n AS (SELECT *, {DIGITS.format('sentence', SPAN_F)} AS number FROM e WHERE {OWN_F.format('sentence')} AND {_WORTHY_F.format('sentence')})
          SELECT CAST(row_id AS VARCHAR) AS pmcid, number, sentence, 'f' || first AS xref_id, 'figures/' || row_id AS local_path FROM n WHERE number NOT LIKE '%,%' AND number = first""",
        "joined_training": """WITH p AS (SELECT claim_id, row_id, coalesce(claim, '') AS sentence, evi_path, operation, CASE WHEN operation <> 'Supported_claim_only' THEN 'perturbed/' || evi_path END AS pe FROM task1_gold),
          m AS (SELECT claim_id, sentence, operation, pe FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, sentence ORDER BY pe DESC NULLS LAST, operation DESC NULLS LAST) AS n FROM p WHERE row_id % 3 <> 0) WHERE n = 1),
          j AS (SELECT 't_' || p.claim_id || '_' || p.row_id AS pair, p.evi_path, m.operation, m.pe FROM p LEFT JOIN m ON p.claim_id = m.claim_id AND p.sentence = m.sentence)
          SELECT pair || '_s' AS claim_id, 'Supported' AS label, pair AS claim_id_pair, 'Supported_claim_only' AS operation, evi_path FROM j UNION ALL SELECT pair || '_r', 'Refuted', pair, operation, pe FROM j WHERE pe IS NOT NULL""",
    }
