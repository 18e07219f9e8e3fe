"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_KEY = r"lower(trim(regexp_replace({0}, '[\s\-\xA0]+', ' ', 'g')))"


def _short(attribute: str) -> str:
    return f"""SELECT t.attribute, t.category FROM sample_targets t
      LEFT JOIN (SELECT {_KEY.format(attribute)} AS k, count(*) AS n FROM task1_gold GROUP BY 1) c ON c.k = {_KEY.format("t.category")}
      WHERE t.attribute = '{attribute}' AND coalesce(c.n, 0) < t.target_share * (SELECT count(*) FROM task1_gold) * 0.2"""


_PAPER = r"""CASE WHEN regexp_extract(paper_path, '([^/]*)\.json\s*$', 1) <> ''
  THEN regexp_replace(regexp_extract(paper_path, '([^/]*)\.json\s*$', 1), '^(peerj_sibils|[A-Za-z]+)_', '')
  ELSE nullif(regexp_replace(regexp_replace(lower(trim(paper_id)), '^(arxiv|acl|peerj|doi|pmc|id)\s*[:_/ -]\s*', ''), '^(\d{4}\.\d{4,5})v\d+$', '\1'), '') END"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""WITH RECURSIVE named AS (SELECT DISTINCT {_PAPER} AS paper, trim(claim_id_pair) AS pair FROM task1_gold),
      known AS (SELECT * FROM named WHERE paper IS NOT NULL AND pair IS NOT NULL
        AND lower(pair) NOT IN ('', 'no pair', 'n/a', 'na', 'none', 'null', 'nan', '-', 'no_pair', 'nopair')),
      edge AS (SELECT DISTINCT a.paper AS a, b.paper AS b FROM known a JOIN known b USING (pair) WHERE a.paper <> b.paper),
      reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
      SELECT DISTINCT a AS paper_a, b AS paper_b FROM reach WHERE a < b""",
        "p5_found": " UNION ALL ".join(_short(a) for a in ("domain", "evi_type", "operation")),
    }
