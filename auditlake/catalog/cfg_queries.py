"""Checked queries over the control flow of the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.catalog.base import query
from auditlake.catalog.corpus import FILES_SQL, distinct_files
from auditlake.catalog.relation_queries import CLASS_SQL
from auditlake.functions.statements import NOT_VARIABLES
from auditlake.operators import cfg
from auditlake.sources.corpus import extract_units

KEYS = ["file_path", "unit_no"]
NEWLINES = "(length({0}) - length(replace({0}, chr(10), '')))"
NAMES = "list_filter(regexp_extract_all({0}, '\\.?[A-Za-z_]\\w*(?:\\s*(?:\\(|!|::))?'), lambda x: NOT (starts_with(x, '.') OR ends_with(x, '(') OR ends_with(x, '!') OR ends_with(x, '::')))"
SETS = "^(?:let\\s+(?:mut\\s+)?)?([A-Za-z_]\\w*)\\s*(?::[^=]*)?=[^=]"

BLOCKS_SQL = f"""{FILES_SQL}, un AS (SELECT DISTINCT file_path, 1 AS unit_no, fn_name, main_fn AS t FROM texts
  UNION ALL SELECT DISTINCT file_path, 2, 'deposit', 'fn deposit(amount: u64) -> u64 {{' || chr(10) || '    return amount * 2' || chr(10) || '}}' || chr(10) FROM texts WHERE has_second),
 pieces AS (SELECT file_path, unit_no, fn_name, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT *, regexp_extract_all(t, '[^;{{}}]*[;{{}}]') AS ps FROM un)),
 turns AS (SELECT *, right(p, 1) AS c, CASE right(p, 1) WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS turn, {NEWLINES.format('p')} AS nl FROM pieces),
 deep AS (SELECT *, sum(turn) OVER w AS d1, sum(turn) OVER w - turn AS d0, sum(nl) OVER w - nl AS off, regexp_replace(coalesce(lead(p) OVER w, ''), '^\\s+', '') AS nx FROM turns WINDOW w AS (PARTITION BY file_path, unit_no ORDER BY i)),
 body AS (SELECT *, d1 = 0 OR (c = ';' AND d0 = 1) OR (c = '}}' AND d1 = 1 AND NOT regexp_matches(nx, '^(else\\b|[);.,?])')) AS ends
  FROM (SELECT *, min(i) FILTER (d1 = 0 AND d0 = 1) OVER (PARTITION BY file_path, unit_no) AS stop FROM deep) WHERE d0 >= 1 AND i <= stop),
 parted AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY file_path, unit_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM body),
 whole AS (SELECT file_path, unit_no, fn_name, s, min(off) AS off, string_agg(CASE WHEN d1 = 0 THEN left(p, length(p) - 1) ELSE p END, '' ORDER BY i) AS body FROM parted GROUP BY ALL),
 cut AS (SELECT *, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS code, off + {NEWLINES.format("regexp_extract(body, '^\\s*')")} AS line FROM whole),
 b AS (SELECT file_path, unit_no, fn_name, (row_number() OVER u - 1)::INT AS node, line::INT AS line, code, {CLASS_SQL} AS kind, (count(*) OVER (PARTITION BY file_path, unit_no))::INT AS n_blocks
  FROM cut WHERE code NOT IN ('', ';') WINDOW u AS (PARTITION BY file_path, unit_no ORDER BY s)),
 e AS (SELECT file_path, unit_no, node AS src, unnest(CASE kind WHEN 'error' THEN [n_blocks] WHEN 'branch' THEN [CASE WHEN node + 1 < n_blocks THEN node + 1 END, CASE WHEN node + 2 < n_blocks THEN node + 2 END]
  WHEN 'loop' THEN [CASE WHEN node + 1 < n_blocks THEN node + 1 END, node] ELSE [node + 1] END) AS dst FROM b)"""

FOUND_SQL = f"""{BLOCKS_SQL}, free AS (SELECT file_path, unit_no, node FROM b WHERE node = 0
  UNION SELECT e.file_path, e.unit_no, e.dst FROM free f JOIN b ON b.file_path = f.file_path AND b.unit_no = f.unit_no AND b.node = f.node AND b.kind <> 'auth' JOIN e ON e.file_path = b.file_path AND e.unit_no = b.unit_no AND e.src = b.node),
 k AS (SELECT *, bool_or(kind = 'auth') OVER (PARTITION BY file_path, unit_no) AS checked, count(*) FILTER (kind = 'cpi') OVER (PARTITION BY file_path, unit_no ORDER BY node) AS calls FROM b),
 found AS (SELECT k.*, CASE WHEN kind IN ('cpi', 'transfer') AND checked AND f.node IS NOT NULL THEN 'SOL-CFG-01'
  WHEN kind IN ('cpi', 'transfer') AND NOT checked AND regexp_matches(fn_name, '^(process_|handle_|execute_)') AND NOT regexp_matches(fn_name, 'init|create') THEN 'SOL-CFG-02'
  WHEN kind = 'mutation' AND calls > 0 THEN 'SOL-CFG-03' WHEN kind = 'loop' AND NOT regexp_matches(code, '\\.\\.|take\\(|chunks\\(|windows\\(|break|return|MAX_|limit') THEN 'SOL-CFG-04' END AS id
  FROM k LEFT JOIN free f ON f.file_path = k.file_path AND f.unit_no = k.unit_no AND f.node = k.node)"""

DATA_SQL = f"""{BLOCKS_SQL}, sets AS (SELECT b.*, nullif(regexp_extract(code, '{SETS}', 1), '') AS v FROM b),
 heads AS (SELECT file_path, unit_no, {NAMES.format("split_part(t, '{', 1)")} AS names FROM un),
 own AS (SELECT DISTINCT s.file_path, s.unit_no, v FROM sets s JOIN heads h USING (file_path, unit_no) WHERE v IS NOT NULL AND NOT list_contains(names, v) AND v NOT IN ({', '.join(f"'{w}'" for w in NOT_VARIABLES)})),
 defs AS (SELECT DISTINCT s.file_path, s.unit_no, node, v FROM sets s JOIN own USING (file_path, unit_no, v)),
 named AS (SELECT file_path, unit_no, node, unnest({NAMES.format(f"CASE WHEN v IS NULL THEN code ELSE regexp_replace(code, '{SETS}', '=') END")}) AS v FROM sets),
 uses AS (SELECT DISTINCT n.* FROM named n JOIN own USING (file_path, unit_no, v)),
 rd AS (SELECT d.file_path, d.unit_no, e.dst AS node, d.v FROM defs d JOIN e ON e.file_path = d.file_path AND e.unit_no = d.unit_no AND e.src = d.node
  UNION SELECT r.file_path, r.unit_no, e.dst, r.v FROM rd r JOIN e ON e.file_path = r.file_path AND e.unit_no = r.unit_no AND e.src = r.node),
 lv AS (SELECT u.file_path, u.unit_no, e.src AS node, u.v FROM uses u JOIN e ON e.file_path = u.file_path AND e.unit_no = u.unit_no AND e.dst = u.node
  UNION SELECT l.file_path, l.unit_no, e.src, l.v FROM lv l JOIN e ON e.file_path = l.file_path AND e.unit_no = l.unit_no AND e.dst = l.node
   WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.file_path = l.file_path AND d.unit_no = l.unit_no AND d.node = l.node AND d.v = l.v)),
 flows AS (SELECT *, 'DF-SOL-090' AS id FROM (SELECT * FROM uses EXCEPT SELECT * FROM rd) UNION ALL SELECT *, 'DF-SOL-091' FROM (SELECT * FROM defs EXCEPT SELECT * FROM lv))"""


def units(spark, sf):
    return extract_units(distinct_files(spark, sf).select("file_path", "content"))


@query("cfg_blocks", f"WITH {BLOCKS_SQL} SELECT file_path, unit_no, node, line, code, kind, n_blocks FROM b")
def cfg_blocks(spark, sf):
    return cfg.cfg_blocks(units(spark, sf).drop("line"), KEYS)


@query("cfg_edges", f"WITH {BLOCKS_SQL} SELECT file_path, unit_no, src, dst FROM e WHERE dst IS NOT NULL")
def cfg_edges(spark, sf):
    return cfg.cfg_edges(cfg.cfg_blocks(units(spark, sf).drop("line"), KEYS), KEYS)


@query("cfg_findings", f"WITH RECURSIVE {FOUND_SQL} SELECT file_path, unit_no, node, line, kind, id, (CASE WHEN kind = 'mutation' THEN calls ELSE 1 END)::INT AS n FROM found WHERE id IS NOT NULL")
def cfg_findings(spark, sf):
    return cfg.cfg_findings(units(spark, sf).drop("line"), KEYS).drop("code")


@query("dataflow_findings_code", f"WITH RECURSIVE {DATA_SQL} SELECT f.file_path, f.unit_no, f.node, line, f.v AS var, starts_with(code, 'let ') AS declared, id FROM flows f JOIN b USING (file_path, unit_no, node)")
def dataflow_findings_code(spark, sf):
    return cfg.cfg_dataflow(units(spark, sf).drop("line"), KEYS)
