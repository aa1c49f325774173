"""SQL that states the same results over the given tables.

What a statement template uses is labelled by hand in `_LABELS`, so the log
queries are checked against an independent truth, not against another scan.
"""

from __future__ import annotations

from . import workload as WL

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- drift
_EDGES = """
cnt AS (SELECT {k}, count(*) FILTER (side = 'b') AS tb, count(*) FILTER (side = 'c') AS tc
        FROM vals GROUP BY {k}),
srt AS (SELECT {k}, v, row_number() OVER (PARTITION BY {k} ORDER BY v) - 1 AS r
        FROM vals WHERE side = 'b'),
pos AS (SELECT {k}, tb, tc, i, (i / 10.0::DOUBLE) * (tb - 1) AS p
        FROM cnt, range(0, 11) t(i) WHERE tb > 0 AND tc > 0),
raw AS (SELECT {pk}, pos.tb, pos.tc, i, CASE WHEN i = 0 THEN lo.v WHEN i = 10 THEN hi.v ELSE
          lo.v * (1 - (p - floor(p))) + hi.v * (p - floor(p)) END AS e
        FROM pos
        JOIN srt lo ON {lo} AND lo.r = floor(p)
        JOIN srt hi ON {hi} AND hi.r = least(floor(p) + 1, pos.tb - 1)),
lag AS (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM raw),
edges AS (SELECT {k}, any_value(tb) AS tb, any_value(tc) AS tc,
          list(e ORDER BY i) FILTER (m IS NULL OR e > m) AS es FROM lag GROUP BY {k}),
fixed AS (SELECT * REPLACE (CASE WHEN len(es) < 2 THEN [es[1], es[1] + 1e-9] ELSE es END AS es)
          FROM edges),
binned AS (SELECT {fk}, greatest(0, least(len(list_filter(es, lambda x: x <= v)) - 1,
             len(es) - 2)) AS bin, count(*) FILTER (side = 'b') AS nb,
             count(*) FILTER (side = 'c') AS nc
           FROM vals JOIN fixed USING ({k}) GROUP BY ALL),
shares AS (SELECT {k}, g.bin, es[g.bin + 1] AS low, es[g.bin + 2] AS high, tb, tc,
             coalesce(nb, 0) / tb AS e, coalesce(nc, 0) / tc AS a
           FROM (SELECT *, unnest(range(0, len(es) - 1)) AS bin FROM fixed) g
           LEFT JOIN binned USING ({k}, bin)),
psi AS (SELECT {k}, any_value(tb) AS tb, any_value(tc) AS tc,
          sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6)))
          AS psi FROM shares GROUP BY {k}),
dist AS (SELECT {k}, v, count(*) FILTER (side = 'b') AS nb, count(*) FILTER (side = 'c') AS nc
         FROM vals GROUP BY {k}, v),
cdf AS (SELECT {k}, sum(nb) OVER w AS cb, sum(nc) OVER w AS cc, sum(nb) OVER (PARTITION BY {k})
          AS tb, sum(nc) OVER (PARTITION BY {k}) AS tc FROM dist
        WINDOW w AS (PARTITION BY {k} ORDER BY v)),
ks AS (SELECT {k}, max(abs(cb / tb - cc / tc)) AS ks FROM cdf WHERE tb > 0 AND tc > 0
       GROUP BY {k}),
drift AS (SELECT {k}, cnt.tb AS n_baseline, cnt.tc AS n_current, psi, ks,
            CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate'
                 WHEN psi IS NOT NULL THEN 'significant' END AS verdict
          FROM cnt LEFT JOIN psi USING ({k}) LEFT JOIN ks USING ({k}))
"""


def _drift(vals: str, keys: tuple[str, ...]) -> str:
    k = ", ".join(keys)
    return "vals AS (" + vals + "),\n" + _EDGES.format(
        k=k, pk=", ".join("pos." + x for x in keys), fk=", ".join("vals." + x for x in keys),
        lo=" AND ".join(f"lo.{x} = pos.{x}" for x in keys),
        hi=" AND ".join(f"hi.{x} = pos.{x}" for x in keys))


_LINE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'b' ELSE 'c' END"
    f" AS side, {c} AS v FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
_SEGMENT = """
SELECT o_orderpriority AS segment, 'o_totalprice' AS feature, CASE WHEN o_orderdate <
  TIMESTAMP '1998-01-01' THEN 'b' ELSE 'c' END AS side, o_totalprice AS v FROM orders
UNION ALL SELECT event_type, 'value', CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'b' ELSE 'c' END,
  value FROM events"""
_USER = """SELECT user_id::VARCHAR AS entity, 'value' AS feature, CASE WHEN ts <
  TIMESTAMP '2024-01-15' THEN 'b' ELSE 'c' END AS side, value AS v FROM events"""
_OUT = ("n_baseline, n_current, round(psi, 6) AS psi, round(ks, 6) AS ks, verdict,"
        " coalesce(verdict <> 'stable', false) AS has_drift FROM drift")
SQL["drift_psi_ks"] = f"WITH {_drift(_LINE, ('feature',))} SELECT feature, {_OUT}"
SQL["drift_by_segment"] = (f"WITH {_drift(_SEGMENT, ('segment', 'feature'))}"
                           f" SELECT segment, feature, {_OUT}")
SQL["drift_by_psi"] = f"""WITH {_drift(_SEGMENT, ('segment', 'feature'))}
SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY round(psi, 6) DESC NULLS LAST, segment)
  AS position, segment, round(psi, 6) AS psi FROM drift"""
SQL["drift_against_snapshot"] = f"WITH {_drift(_LINE, ('feature',))} SELECT feature, {_OUT} WHERE feature <> 'l_tax'"
SQL["baseline_tables"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS total FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + """
UNION ALL SELECT 'click', count(*), round(sum(value), 4) FROM (SELECT value, row_number() OVER (
  ORDER BY md5('42:' || event_id), event_id) AS r FROM events WHERE event_type = 'click') WHERE r <= 300"""
SQL["events_in_order"] = """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS position, event_type,
  min(event_id) AS first, count(*) AS times FROM events GROUP BY user_id, event_type"""
SQL["drift_bin_shares"] = f"""WITH {_drift(_LINE, ('feature',))}
SELECT feature, bin, round(low, 6) AS low, round(high, 6) AS high, round(e, 6) AS expected,
  round(a, 6) AS actual FROM shares"""
SQL["feature_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean,"
    f" round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max FROM {t}"
    for t, c in (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"),
                 ("lineitem", "l_discount"), ("lineitem", "l_tax"), ("customer", "c_acctbal"),
                 ("supplier", "s_acctbal")))
SQL["baseline_sample"] = """
SELECT feature, event_id, v FROM (SELECT event_type AS feature, event_id, value AS v,
  row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS r
  FROM events) WHERE r <= 300"""
_SCHEMAS = """
sch AS (SELECT user_id::VARCHAR AS entity, event_type || '_' || (event_id % 8) AS col,
          CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'b' ELSE 'c' END AS side, count(*) AS n
        FROM events GROUP BY ALL),
sb AS (SELECT entity, col, CASE WHEN n % 2 = 1 THEN 'BIGINT' ELSE 'Double' END AS t
       FROM sch WHERE side = 'b'),
sc AS (SELECT entity, col, CASE WHEN n % 2 = 1 THEN ' bigint ' ELSE 'double' END AS t
       FROM sch WHERE side = 'c'),
chg AS (SELECT coalesce(sb.entity, sc.entity) AS entity, coalesce(sb.col, sc.col) AS "column",
          CASE WHEN sb.entity IS NULL THEN 'added' WHEN sc.entity IS NULL THEN 'removed'
               WHEN lower(trim(sb.t)) <> lower(trim(sc.t)) THEN 'type_changed' END AS change,
          sb.t AS old_type, sc.t AS new_type
        FROM sb FULL JOIN sc ON sb.entity = sc.entity AND sb.col = sc.col),
schema AS (SELECT e.entity, count(*) FILTER (change = 'added') AS added,
             count(*) FILTER (change = 'removed') AS removed,
             count(*) FILTER (change = 'type_changed') AS changed
           FROM (SELECT DISTINCT entity FROM sch) e LEFT JOIN chg USING (entity) GROUP BY 1),
schema_sev AS (SELECT *, CASE WHEN removed + changed > 0 THEN 'high' WHEN added > 0 THEN 'low'
                 ELSE 'none' END AS severity FROM schema)"""
SQL["schema_changes"] = f"WITH {_SCHEMAS} SELECT * FROM chg WHERE change IS NOT NULL"
SQL["schema_drift"] = f"""WITH {_SCHEMAS}
SELECT *, severity <> 'none' AS has_drift FROM schema_sev"""
SQL["column_types"] = r"""
WITH t AS (SELECT *, event_id AS i, event_id % 997 = 500 AS late FROM events),
u AS (SELECT event_type, 'id' AS "column", i::VARCHAR AS x FROM t
  UNION ALL SELECT event_type, 'scaled', CASE WHEN late THEN '1e300' ELSE i::VARCHAR END FROM t
  UNION ALL SELECT event_type, 'coded', CASE WHEN late THEN 'n/a' ELSE (i * 3000000)::VARCHAR END FROM t
  UNION ALL SELECT event_type, 'wide', CASE WHEN i % 9 <> 0 THEN (i * 3000000)::VARCHAR END FROM t
  UNION ALL SELECT event_type, 'day', CASE WHEN late THEN 'no day' ELSE '2024-02-28' END FROM t
  UNION ALL SELECT event_type, 'moment', CASE WHEN i % 2 = 0 THEN '2024-02-29' END FROM t
  UNION ALL SELECT event_type, 'empty', NULL FROM t
  UNION ALL SELECT event_type, 'props', props FROM t),
k AS (SELECT *, CASE WHEN x IS NULL OR trim(x) = '' THEN NULL WHEN try_cast(x AS DATE) IS NOT NULL
        THEN 'time' WHEN x = '1e300' THEN 'decimal' WHEN try_cast(x AS INT) IS NOT NULL THEN 'int'
        WHEN try_cast(x AS BIGINT) IS NOT NULL THEN 'whole' ELSE 'text' END AS kind FROM u),
c AS (SELECT event_type, "column", count(*) AS rows, count(*) - count(kind) AS missing,
        count(*) FILTER (kind = 'int') AS n_int, count(*) FILTER (kind = 'whole') AS n_whole,
        count(*) FILTER (kind = 'decimal') AS n_decimal, count(*) FILTER (kind = 'time') AS n_time,
        count(*) FILTER (kind = 'text') AS n_text FROM k GROUP BY ALL)
SELECT *, CASE WHEN rows = missing THEN 'void' WHEN n_text > 0 THEN 'string'
    WHEN n_time > 0 THEN 'timestamp_ntz' WHEN n_decimal > 0 THEN 'double' WHEN n_whole > 0 THEN 'bigint'
    ELSE 'int' END AS type,
  rows - missing - greatest(n_text, n_time, n_int + n_whole + n_decimal) AS misfits FROM c"""
_FRESH = """
lastu AS (SELECT user_id, max(epoch_us(ts)) AS us FROM events GROUP BY 1),
age AS (SELECT user_id::VARCHAR AS entity,
          ((SELECT max(epoch_us(ts)) FROM events) - CASE WHEN user_id % 2 = 0
             THEN (us // 1000000) * 1000000 ELSE (us // 1000) * 1000 END) / 3600000000.0::DOUBLE
            AS age_hours,
          CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 6.0 ELSE 24.0 END::DOUBLE AS max_age_hours
        FROM lastu),
fresh AS (SELECT *, age_hours > max_age_hours AS is_stale, CASE
            WHEN NOT age_hours > max_age_hours THEN 'none'
            WHEN age_hours > 2 * max_age_hours THEN 'high' ELSE 'moderate' END AS severity FROM age)"""
SQL["freshness"] = f"""WITH {_FRESH}
SELECT entity, round(age_hours, 4) AS age_hours, max_age_hours, is_stale, severity FROM fresh"""
_DIAG = f"""{_drift(_USER, ('entity', 'feature'))}, {_SCHEMAS}, {_FRESH},
dx AS (SELECT u.entity, coalesce(d.psi, 0) AS psi, d.verdict IN ('moderate', 'significant') AS bad,
         coalesce(s.severity, 'none') AS ss, coalesce(f.severity, 'none') AS fs,
         CASE WHEN u.entity::INT % 4 <> 0 THEN 'up' || u.entity END AS up
       FROM (SELECT DISTINCT user_id::VARCHAR AS entity FROM events) u
       LEFT JOIN drift d ON d.entity = u.entity LEFT JOIN schema_sev s ON s.entity = u.entity
       LEFT JOIN fresh f ON f.entity = u.entity),
diag AS (SELECT entity, round(psi + CASE ss WHEN 'high' THEN 0.3 WHEN 'low' THEN 0.05 ELSE 0 END::DOUBLE
           + CASE fs WHEN 'high' THEN 0.3 WHEN 'moderate' THEN 0.15 ELSE 0 END::DOUBLE, 3)
           AS drift_score,
         coalesce(bad, false) OR ss <> 'none' OR fs <> 'none' AS has_drift,
         CASE WHEN bad THEN coalesce(up, 'upstream') || '#value'
              WHEN fs <> 'none' THEN coalesce(up, 'upstream (freshness)')
              WHEN ss <> 'none' THEN coalesce(up, 'upstream (schema)') ELSE '' END
           AS offending_upstream FROM dx)"""
SQL["model_diagnosis"] = f"""WITH {_DIAG} SELECT *, CASE WHEN drift_score >= 0.25 OR has_drift
  THEN 'AT RISK' ELSE 'healthy' END AS verdict FROM diag"""
SQL["drift_flags"] = f"""WITH {_DIAG}, d AS (SELECT * FROM diag WHERE has_drift)
SELECT entity, 'tag' AS aspect, unnest(['at-risk', 'skew-detected']) AS "key", '' AS value FROM d
UNION ALL SELECT entity, 'property', 'skew_status', 'at-risk' FROM d
UNION ALL SELECT entity, 'property', 'skew_drift_score', printf('%.3f', drift_score) FROM d
UNION ALL SELECT entity, 'property', 'skew_offending_upstream', offending_upstream FROM d
UNION ALL SELECT entity, 'property', 'skew_checked_at', '2024-02-01T00:00:00' FROM d"""

# ---------------------------------------------------------------- health
_EVIDENCE = """
used AS (SELECT l_partkey AS k, count(*) AS qc, count(DISTINCT l_orderkey) AS dc,
           list(DISTINCT lower(n_name) ORDER BY lower(n_name)) AS src
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
         JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
ev AS (SELECT 'urn:part:' || p_partkey AS urn, p_name AS name,
         CASE WHEN p_partkey % 5 <> 0 THEN 'The ' || p_name || ' table, loaded from ' ||
           (['france', 'oracle', 'germany', 'peru and kafka'])[p_partkey % 4 + 1] ||
           CASE WHEN p_partkey % 7 = 0 THEN ' keyed by `' || p_type || '`' ELSE '' END ||
           CASE WHEN p_partkey % 11 = 0 THEN ' (deprecated test)' ELSE '' END END AS d,
         CASE WHEN p_partkey % 6 = 0 THEN [] ELSE [lower(p_brand), 'economy'] END AS fields,
         CASE WHEN p_partkey % 8 = 0 THEN [] ELSE coalesce(src, []) END AS src,
         CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE coalesce(dc, 0) END AS dc,
         CASE WHEN p_partkey % 3 = 0 THEN p_size % 30 ELSE coalesce(qc, 0) END AS qc,
         CASE WHEN p_partkey % 9 = 0 THEN [p_brand] ELSE [] END AS terms
       FROM part LEFT JOIN used ON p_partkey = k),
con AS (
  SELECT urn, 'source_mismatch' AS kind, w AS word, 'description cites "' || w ||
    '" but current lineage is [' || array_to_string(src, ', ') || ']' AS detail
  FROM ev, (VALUES ('france'), ('germany'), ('kafka'), ('oracle'), ('peru')) k(w)
  WHERE len(src) > 0 AND regexp_matches(lower(d), '\\b' || w || '\\b')
    AND NOT contains(array_to_string(src, ' '), w)
  UNION ALL
  SELECT urn, 'false_deprecation', w, 'marked "' || w || '" but has ' || qc || ' queries and ' ||
    dc || ' downstream dependencies'
  FROM (SELECT *, (SELECT min(w) FROM (VALUES ('deprecated'), ('do not use'), ('legacy'),
    ('obsolete'), ('sandbox'), ('scratch'), ('temp'), ('temporary'), ('test'), ('throwaway'),
    ('unused')) k(w) WHERE contains(lower(d), w)) AS w FROM ev)
  WHERE w IS NOT NULL AND (qc >= 25 OR dc > 0)
  UNION ALL
  SELECT urn, 'stale_column', m, 'description references removed column `' || m || '`'
  FROM (SELECT *, unnest(regexp_extract_all(d, '`([a-zA-Z_]\\w*)`', 1)) AS m FROM ev)
  WHERE len(fields) > 0 AND NOT list_contains(list_transform(fields, lambda x: lower(x)), lower(m))),
inv0 AS (SELECT ev.*, (len(fields) > 0)::INT + (len(src) > 0)::INT + (qc > 0)::INT + (dc > 0)::INT
           + (len(terms) > 0)::INT AS strength, coalesce(nc, 0) > 0 AS zombie, d IS NOT NULL AS doc,
           dc > 0 OR qc >= 25 AS heavy, listed
         FROM ev LEFT JOIN (SELECT urn, count(*) AS nc, string_agg('[' || kind || '] ' || detail,
           '; ' ORDER BY CASE kind WHEN 'source_mismatch' THEN 0 WHEN 'false_deprecation' THEN 1
           ELSE 2 END, word) AS listed FROM con GROUP BY 1) USING (urn)),
inv AS (SELECT *, CASE WHEN strength < 2 AND NOT doc THEN 'abstain' WHEN zombie THEN 'review'
          WHEN doc THEN 'none' WHEN strength >= 3 THEN 'write' ELSE 'review' END AS action
        FROM inv0),
hl AS (SELECT *, CASE WHEN heavy AND (NOT doc OR zombie) THEN 'CRITICAL' WHEN zombie THEN
         'NEEDS_REVIEW' WHEN NOT doc THEN 'FORGOTTEN' ELSE 'HEALTHY' END AS status FROM inv)"""
SQL["asset_contradictions"] = f"WITH {_EVIDENCE} SELECT * FROM con"
SQL["asset_investigation"] = f"""WITH {_EVIDENCE}
SELECT urn, strength AS evidence_strength, CASE strength WHEN 0 THEN 'none' WHEN 1 THEN 'weak'
  WHEN 2 THEN 'moderate' ELSE 'strong' END AS confidence, action, zombie AS is_zombie,
  CASE WHEN len(src) > 0 OR qc <> 0 OR dc <> 0 OR len(terms) > 0 THEN name || ': ' ||
    concat_ws('; ', CASE WHEN len(src) > 0 THEN 'derived from ' || array_to_string(src, ', ') END,
      CASE WHEN qc <> 0 THEN 'actively queried (' || qc || ' queries observed)' END,
      CASE WHEN dc <> 0 THEN 'feeds ' || dc || ' downstream asset(s)' END,
      CASE WHEN len(terms) > 0 THEN 'related to ' || array_to_string(terms, ', ') END) || '.'
    ELSE 'insufficient evidence to reconstruct' END AS proposed_description,
  concat_ws('|', CASE WHEN len(src) > 0 THEN 'lineage: ' || len(src) || ' upstream source(s)' END,
    CASE WHEN qc <> 0 THEN 'queries: ' || qc || ' real queries reference it' END,
    CASE WHEN dc <> 0 THEN 'downstream: ' || dc || ' dependent asset(s)' END,
    CASE WHEN len(terms) > 0 THEN 'glossary: sibling terms ' || array_to_string(terms, ', ') END,
    CASE WHEN len(fields) > 0 THEN 'schema: ' || len(fields) || ' columns' END,
    CASE WHEN action = 'abstain' THEN 'ABSTAIN: fewer than 2 independent evidence types'
      WHEN action = 'review' AND zombie THEN
        'REVIEW: existing description contradicts current evidence'
      WHEN action = 'write' THEN
        'WRITE: >=3 corroborating evidence types, no prior description' END) AS rationale
FROM inv"""
SQL["asset_health"] = f"""WITH {_EVIDENCE}
SELECT urn, status, CASE status
  WHEN 'CRITICAL' THEN 'load-bearing (' || qc || ' queries, ' || dc || ' downstream)|' ||
    CASE WHEN NOT doc THEN 'undocumented' ELSE 'documentation contradicts evidence' END
  WHEN 'NEEDS_REVIEW' THEN 'zombie: ' || listed
  WHEN 'FORGOTTEN' THEN 'undocumented; ' || CASE WHEN action <> 'abstain' THEN 'reconstructable'
    ELSE 'evidence too thin to reconstruct' END
  ELSE 'documented and consistent with evidence' END AS reasons FROM hl"""
SQL["asset_leaderboard"] = f"""WITH {_EVIDENCE}
SELECT row_number() OVER (ORDER BY CASE status WHEN 'CRITICAL' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1
  WHEN 'FORGOTTEN' THEN 2 ELSE 3 END, substr(urn, 10)::BIGINT) AS position, urn, status FROM hl"""
SQL["health_coverage"] = f"""WITH {_EVIDENCE}
SELECT count(*) AS assets, round(100.0 * count(*) FILTER (status = 'HEALTHY')
  / greatest(count(*), 1), 1) AS healthy_pct, count(*) FILTER (status = 'CRITICAL') AS critical,
  count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review,
  count(*) FILTER (status = 'FORGOTTEN') AS forgotten,
  count(*) FILTER (status = 'HEALTHY') AS healthy FROM hl"""
SQL["health_write_gate"] = f"""WITH {_EVIDENCE}
SELECT status AS knowledge_health, action, CASE action WHEN 'write' THEN 'written' WHEN 'review'
  THEN 'queued' ELSE 'skipped' END AS outcome, count(*) AS n,
  count(*) FILTER (action = 'write') AS described FROM hl GROUP BY ALL"""

# ---------------------------------------------------------------- the log
# What each template uses, labelled by reading it: template, table, column, usage, confidence,
# clauses, whether a star also carries the column.
_LABELS = (
    (0, "orders", "orderstatus", "select", "high", "group|select"),
    (0, "orders", "totalprice", "select", "high", "select"),
    (0, "orders", "orderkey", "filter", "high", "where"),
    (1, "orders", "orderkey", "select", "high", "select"),
    (1, "customer", "name", "select", "high", "select"),
    (1, "orders", "custkey", "filter", "high", "join"),
    (1, "customer", "custkey", "filter", "high", "join"),
    (1, "customer", "acctbal", "filter", "high", "where"),
    (2, "orders", "custkey", "select", "low", "join|select"),
    (2, "customer", "custkey", "select", "low", "join|select"),
    (2, "orders", "orderdate", "filter", "high", "where"),
    (2, "orders", "orderkey", "filter", "high", "where"),
    (3, "lineitem", "quantity", "filter", "high", "select(*)|where"),
    (4, "orders", "orderpriority", "select", "high", "select"),
    (4, "orders", "orderkey", "filter", "high", "where"),
    (4, "lineitem", "orderkey", "filter", "high", "select(*)|where"),
    (4, "lineitem", "linenumber", "filter", "high", "select(*)|where"),
    (5, "lineitem", "shipdate", "select", "high", "group|select"),
    (5, "lineitem", "tax", "filter", "high", "having"),
    (5, "lineitem", "discount", "filter", "high", "order"),
    (7, "customer", "name", "select", "high", "select"),
    (7, "customer", "custkey", "select", "low", "select|where"),
    (7, "orders", "custkey", "select", "low", "select|where"),
    (7, "orders", "totalprice", "filter", "high", "where"),
    (8, "orders", "custkey", "select", "medium", "group|select"),
    (8, "orders", "totalprice", "select", "medium", "select"),
    (9, "customer", "mktsegment", "select", "high", "select"),
    (9, "customer", "nationkey", "select", "high", "select"),
    (9, "customer", "acctbal", "filter", "high", "order"),
    (9, "customer", "name", "filter", "high", "order"),
    (11, "lineitem", "partkey", "select", "medium", "select"),
    (13, "lineitem", "returnflag", "select", "high", "order|select"),
    (13, "lineitem", "linestatus", "select", "high", "select"),
    (13, "lineitem", "suppkey", "select", "high", "select"),
    (13, "lineitem", "extendedprice", "filter", "high", "where"),
    (100, "supplier", "suppkey", "select", "high", "select"),
    (100, "supplier", "name", "select", "high", "select"),
    (101, "supplier", "nationkey", "select", "high", "select|where"),
    (101, "supplier", "suppkey", "select", "high", "select"),
    (102, "orders", "orderkey", "select", "high", "select"),
    (102, "orders", "custkey", "select", "high", "select"),
)
_STARS = ((3, "lineitem", "medium"), (4, "lineitem", "high"))
_COLUMNS = {
    "orders": "orderkey custkey orderstatus totalprice orderdate orderpriority",
    "customer": "custkey name nationkey acctbal mktsegment",
    "lineitem": "orderkey partkey suppkey linenumber quantity extendedprice discount tax"
                " returnflag linestatus shipdate",
    "supplier": "suppkey name nationkey acctbal",
}
_OUTPUTS = {0: "orderstatus total", 1: "orderkey name", 2: "custkey", 4: "orderpriority",
            5: "shipdate n", 7: "name", 8: "spend", 9: "mktsegment rn", 10: "x", 11: "partkey",
            13: "returnflag linestatus", 100: "suppkey name", 101: "nationkey id",
            102: "orderkey custkey"}


def _q(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rows)


_TEXTS = [(i, t) for i, t in enumerate(WL.TEMPLATES)] + [
    (100 + i, t) for i, t in enumerate(WL.MODELS)]
_LOG = f"""
e0 AS (SELECT *, user_id % 7 + CASE WHEN event_type IN ('purchase', 'error') THEN 7 ELSE 0 END
         AS t0 FROM events),
log AS (SELECT CASE WHEN event_id % 2 = 1 THEN 'west' ELSE 'east' END AS catalog,
          'q' || event_id AS query_id, CASE WHEN event_id % 2 = 1 AND t0 IN (6, 12) THEN 10
          ELSE t0 END AS tmpl, CASE WHEN user_id % 5 < 4 THEN 'team' || (user_id % 5) END AS team,
          1 + event_id % 3 AS runs, event_id AS id FROM e0
        UNION ALL SELECT 'west', 'mq' || s_suppkey, 100 + s_suppkey % 3, 'models', 2, s_suppkey
        FROM supplier),
labels(tmpl, ds, col, usage, conf, clauses) AS ({_values(_LABELS)}),
stars(tmpl, ds, conf) AS ({_values(_STARS)}),
cols(ds, ds_pos, col_pos, col) AS ({_values(
    (t, i, j, c) for i, t in enumerate(WL.TABLES) for j, c in enumerate(_COLUMNS[t].split()))}),
uses AS (SELECT tmpl, ds, col, usage, conf, clauses FROM labels UNION ALL
         SELECT s.tmpl, s.ds, c.col, 'star', s.conf, 'select(*)' FROM stars s JOIN cols c USING (ds)
         WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.tmpl = s.tmpl AND l.ds = s.ds
           AND l.col = c.col)),
assets AS (SELECT 'east' AS catalog, s_suppkey AS k, 'urn:asset:' || s_suppkey AS urn,
             'a' || s_suppkey AS name, (['looker_dashboard', 'warehouse_view', 'dbt_model'])[
               s_suppkey % 3 + 1] AS type, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN
               'missing' || s_suppkey ELSE 'q' || (s_suppkey * 2) END AS def FROM supplier
           UNION ALL SELECT 'west', s_suppkey, 'urn:model:' || s_suppkey, 'm' || s_suppkey,
             'dbt_model', 'mq' || s_suppkey FROM supplier),
blind AS (SELECT * FROM assets a WHERE NOT EXISTS (SELECT 1 FROM log l
            WHERE l.catalog = a.catalog AND l.query_id = a.def)),
tot AS (SELECT catalog, nq + coalesce(nb, 0) AS total, bad + coalesce(nb, 0) AS unknown FROM
          (SELECT catalog, count(*) AS nq, count(*) FILTER (tmpl IN (6, 12)) AS bad FROM log
           GROUP BY 1) LEFT JOIN (SELECT catalog, count(*) AS nb FROM blind GROUP BY 1)
          USING (catalog)),
cnt AS (SELECT c.catalog, ds, ds_pos, col_pos, col,
          count(l.query_id) FILTER (usage <> 'star' AND conf <> 'low') AS breaks,
          count(l.query_id) FILTER (usage = 'star') AS degrades,
          count(l.query_id) FILTER (conf = 'low') AS ambiguous,
          coalesce(sum(runs) FILTER (conf <> 'low'), 0)::BIGINT AS runs_impacted,
          count(DISTINCT team) FILTER (conf <> 'low') AS teams,
          coalesce(string_agg(DISTINCT team, '|' ORDER BY team) FILTER (conf <> 'low'), '')
            AS teams_impacted
        FROM (SELECT 'east' AS catalog UNION ALL SELECT 'west') c CROSS JOIN cols
        LEFT JOIN uses USING (ds, col)
        LEFT JOIN log l ON l.catalog = c.catalog AND l.tmpl = uses.tmpl
        GROUP BY ALL),
risk AS (SELECT cnt.*, total, unknown, total - unknown - breaks - degrades - ambiguous AS safe,
           least(100, round_even(breaks * 20 + degrades * 8 + least(runs_impacted, 60) * 0.5
             + teams * 5, 0))::INT AS score FROM cnt JOIN tot USING (catalog)),
lvl AS (SELECT *, CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 30 THEN 'HIGH'
          WHEN score >= 10 THEN 'MODERATE' ELSE 'LOW' END AS level FROM risk),
ranked AS (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY score DESC, breaks DESC,
             runs_impacted DESC, degrades DESC, ds_pos, col_pos) AS position FROM lvl),
changes(change_id, catalog, dataset, col, op, new_name, ds) AS ({_values(
    [(*c, {"c1": "orders", "c2": "customer", "c3": "lineitem", "c4": "supplier", "c5": "orders",
           "c6": None, "c7": "supplier", "c8": "supplier", "c9": "supplier"}[c[0]])
     for c in WL.CHANGES])}),
described AS (SELECT *, CASE WHEN op = 'rename' THEN 'rename ' || dataset || '.' || col || ' -> '
                || new_name ELSE 'drop ' || dataset || '.' || col END AS change FROM changes)"""
SQL["log_assessability"] = f"""WITH {_LOG}
SELECT catalog, tmpl NOT IN (6, 12) AS assessable, count(DISTINCT tmpl) AS shapes,
  count(*) AS statements, sum(runs)::BIGINT AS runs FROM log GROUP BY 1, 2"""
SQL["column_usage"] = f"""WITH {_LOG}
SELECT catalog, 'urn:sales:' || ds AS ds_urn, col AS "column", usage, conf AS confidence,
  replace(clauses, 'select(*)|', '') AS clauses, contains(clauses, 'select(*)') AS star,
  count(*) AS statements, sum(runs)::BIGINT AS runs
FROM log JOIN labels USING (tmpl) GROUP BY ALL"""
SQL["impact_summary"] = f"""WITH {_LOG}
SELECT change_id, change, 'urn:sales:' || h.ds AS target_urn, h.ds IS NOT NULL AS has_column,
  coalesce(breaks, 0) AS breaks, coalesce(degrades, 0) AS degrades, coalesce(safe, 0) AS safe,
  coalesce(unknown, 0) AS unknown, coalesce(ambiguous, 0) AS ambiguous,
  coalesce(total, 0) AS queries_total, coalesce(total - unknown, 0) AS analysed,
  coalesce(runs_impacted, 0) AS runs_impacted, coalesce(teams, 0) AS teams,
  coalesce(teams_impacted, '') AS teams_impacted, coalesce(score, 0) AS score,
  coalesce(level, 'LOW') AS level, coalesce(level, 'LOW') || CASE WHEN unknown > 0 THEN
    ' among assessed' WHEN ambiguous > 0 THEN ' with ' || ambiguous || ' unresolved reference(s)'
    ELSE '' END AS level_qualifier,
  coalesce(total - unknown, 0) || ' of ' || coalesce(total, 0) || ' analysed' AS coverage,
  coalesce(unknown > 0 OR ambiguous > 0, false) AS review_required
FROM described h LEFT JOIN lvl USING (catalog, ds, col)"""
_VERDICTS = f"""{_LOG},
read AS (SELECT h.change_id, h.catalog, l.query_id, usage, conf, clauses, team, runs, h.col, op,
           new_name FROM changes h JOIN uses USING (ds, col)
         JOIN log l ON l.catalog = h.catalog AND l.tmpl = uses.tmpl),
bad AS (SELECT h.change_id, h.catalog, l.query_id, 'parse_error' AS usage, 'low' AS conf,
          '' AS clauses, team, runs, h.col, op, new_name FROM changes h JOIN log l USING (catalog)
        WHERE ds IS NOT NULL AND tmpl IN (6, 12)),
vq AS (SELECT v.*, a.urn, a.name, a.type FROM (SELECT * FROM read UNION ALL SELECT * FROM bad) v
       LEFT JOIN assets a ON a.catalog = v.catalog AND a.def = v.query_id),
vall AS (SELECT * FROM vq UNION ALL
         SELECT change_id, h.catalog, coalesce(def, 'no_definition:' || urn), 'no_definition',
           'low', '', NULL, 0, col, op, new_name, urn, name, type
         FROM changes h JOIN blind USING (catalog) WHERE ds IS NOT NULL),
v AS (SELECT *, CASE WHEN usage IN ('parse_error', 'no_definition') THEN 'UNKNOWN'
        WHEN usage = 'star' THEN 'DEGRADES' ELSE 'BREAKS' END AS verdict,
        replace(clauses, '|', ', ') AS w FROM vall)"""
SQL["impact_verdicts"] = f"""WITH {_VERDICTS}
SELECT change_id, query_id, verdict, usage, clauses, conf AS confidence, team, runs,
  urn AS asset_urn, CASE usage
   WHEN 'parse_error' THEN 'SQL could not be parsed — impact on `' || col ||
     '` is UNKNOWN, not safe; needs manual review'
   WHEN 'no_definition' THEN 'consumer exposes no SQL definition — impact on `' || col ||
     '` is UNKNOWN, not safe; needs manual review'
   WHEN 'star' THEN 'selects `*` over a scope that provides `' || col || '` (in ' || w || ')' ||
     CASE WHEN op = 'rename' THEN ' → still runs, output field becomes `' || new_name || '`'
     ELSE ' → still runs, output silently loses `' || col || '`' END
   ELSE CASE usage WHEN 'select' THEN 'projects/derives `' || col || '` (in ' || w || ')'
     ELSE 'references `' || col || '` in ' || w END || CASE WHEN op = 'rename' THEN
     ' → must be rewritten to `' || new_name || '`' ELSE ' → column removed' END END AS reason
FROM v"""
SQL["impact_all_consumers"] = f"""WITH {_VERDICTS}
SELECT change_id, query_id, verdict, conf AS confidence, runs FROM v
UNION ALL SELECT change_id, query_id, 'SAFE', 'high', runs FROM changes h JOIN log l USING (catalog)
WHERE h.ds IS NOT NULL AND tmpl NOT IN (6, 12)
  AND NOT EXISTS (SELECT 1 FROM uses u WHERE u.tmpl = l.tmpl AND u.ds = h.ds AND u.col = h.col)"""
SQL["impacted_in_order"] = f"""WITH {_VERDICTS}
SELECT change_id, row_number() OVER (PARTITION BY change_id ORDER BY verdict, runs DESC,
    CASE WHEN query_id LIKE 'mq%' THEN 1099511627776 + substr(query_id, 3)::BIGINT
    ELSE substr(query_id, 2)::BIGINT END) AS position, query_id, verdict, runs,
  CASE verdict WHEN 'BREAKS' THEN 'red' ELSE 'amber' END AS color
FROM v WHERE verdict IN ('BREAKS', 'DEGRADES') AND conf <> 'low'"""
# What each statement of `workload.WRITES` reads and fills, labelled by reading it.
_WRITE_EDGES = ((0, "lineitem", "urn:sales:orders"), (1, "supplier", "urn:sales:customer"),
                (2, "orders", "mart.daily"), (2, "lineitem", "mart.daily"), (3, "orders", "mart.big"),
                (3, "customer", "mart.big"))
_WRITE_LABELS = (
    (0, "lineitem", "orderkey", "select", "select", False), (0, "orders", "orderkey", "filter", "insert", False),
    (0, "orders", "custkey", "filter", "insert", False), (1, "supplier", "suppkey", "filter", "where", True),
    (2, "orders", "orderdate", "select", "group|select", False), (2, "lineitem", "tax", "select", "select", False),
    (2, "orders", "orderkey", "filter", "join", False), (2, "lineitem", "orderkey", "filter", "join", False),
    (2, "orders", "custkey", "filter", "where", False), (3, "orders", "custkey", "select", "select", False),
    (3, "orders", "totalprice", "filter", "where", False), (3, "customer", "name", "select", "select", False),
    (3, "customer", "custkey", "filter", "join", False))
_WROTE = """wlog AS (SELECT CASE WHEN event_id % 2 = 1 THEN 'west' ELSE 'east' END AS catalog,
  event_id % 5 AS tmpl, 1 + event_id % 3 AS runs FROM events)"""
SQL["write_lineage"] = f"""WITH {_WROTE}, we(tmpl, up, down) AS ({_values(_WRITE_EDGES)})
SELECT catalog, 'urn:sales:' || up AS up, down, count(*) AS statements, sum(runs)::BIGINT AS runs
FROM wlog JOIN we USING (tmpl) GROUP BY ALL"""
SQL["write_usage"] = f"""WITH {_WROTE}, wl(tmpl, ds, col, usage, clauses, star) AS ({_values(_WRITE_LABELS)})
SELECT catalog, 'urn:sales:' || ds AS ds_urn, col AS "column", usage, 'high' AS confidence, clauses, star,
  count(*) AS statements, sum(runs)::BIGINT AS runs FROM wlog JOIN wl USING (tmpl) GROUP BY ALL"""
SQL["impact_report"] = f"""WITH {_LOG}
SELECT h.catalog, change_id, change, 'urn:sales:' || h.ds AS target_urn, breaks, safe, unknown, score, level,
  (total - unknown) || ' of ' || total || ' analysed' AS coverage, teams_impacted
FROM described h JOIN lvl USING (catalog, ds, col) WHERE h.catalog = 'west'"""
SQL["no_definition_assets"] = f"""WITH {_LOG}
SELECT catalog, urn, type, coalesce(def, 'no_definition:' || urn) AS query_id,
  CASE type WHEN 'looker_dashboard' THEN 2 WHEN 'warehouse_view' THEN 1 ELSE 0 END AS tier
FROM blind"""
SQL["fragility"] = f"""WITH {_LOG}
SELECT catalog, position, ds AS dataset_name, col AS "column", breaks, degrades, safe,
  runs_impacted, teams, score, level FROM ranked"""
SQL["fragility_top"] = f"""WITH {_LOG}
SELECT catalog, position, ds AS dataset_name, col AS "column", score FROM ranked
WHERE position <= 5"""
SQL["most_referenced_columns"] = f"""WITH {_LOG}, texts(tmpl, txt) AS ({_values(_TEXTS)}),
words AS (SELECT catalog, unnest(regexp_extract_all(lower(replace(txt, '{{id}}', id::VARCHAR)),
            '\\w+')) AS w FROM log JOIN texts USING (tmpl)),
n AS (SELECT catalog, w, count(*) AS mentions FROM words GROUP BY 1, 2)
SELECT catalog, 'urn:sales:' || ds AS urn, col AS "column", mentions FROM cols JOIN n ON w = col"""
SQL["projected_columns"] = f"""WITH {_LOG}, outs(tmpl, pos, output) AS ({_values(
    (t, i, o) for t, s in _OUTPUTS.items() for i, o in enumerate(s.split()))})
SELECT catalog, pos, output, count(*) AS statements FROM log JOIN outs USING (tmpl) GROUP BY ALL"""
SQL["parsed_changes"] = """
SELECT event_id, CASE event_type WHEN 'view' THEN 'rename' WHEN 'error' THEN 'rename'
  WHEN 'signup' THEN 'add' ELSE 'drop' END AS op,
  CASE WHEN event_type = 'purchase' THEN '' ELSE 'sales.t' || (user_id % 9) END AS dataset,
  'c' || event_id AS "column", CASE WHEN event_type = 'view' THEN 'n' || event_id END AS new_name,
  CASE event_type WHEN 'signup' THEN 'unknown operation' WHEN 'purchase' THEN
    'no dataset.column given' WHEN 'error' THEN 'rename requires a new name' END AS error,
  CASE event_type WHEN 'click' THEN 'drop sales.t' || (user_id % 9) || '.c' || event_id
    WHEN 'view' THEN 'rename sales.t' || (user_id % 9) || '.c' || event_id || ' -> n' || event_id
    END AS described FROM events"""

# ---------------------------------------------------------------- fixes and sweep
# New model texts by (change, model template), written by hand.
_NEW = (
    ("c1", 2, "SELECT\n    custkey\nFROM sales.orders\n", 0, "minimal"),
    ("c4", 1, "-- nation of each supplier\nSELECT suppkey AS id FROM sales.supplier\n"
              "WHERE nationkey >= 0\n", 1, "regenerated"),
    ("c7", 0, "SELECT\n    s.supplier_key,\n    s.name\nFROM sales.supplier s\n", 0, "minimal"),
    ("c7", 1, "-- nation of each supplier\nSELECT nationkey, supplier_key AS id FROM"
              " sales.supplier\nWHERE nationkey >= 0\n", 0, "minimal"),
    ("c9", 0, "SELECT\n    s.suppkey\nFROM sales.supplier s\n", 0, "minimal"),
)
_FIXES = (f"newtexts(change_id, m, new_sql, reviews, method) AS ({_values(_NEW)}),\n"
        "fix AS (SELECT change_id, s_suppkey AS k, 'models/m' || s_suppkey || '.sql' AS path,"
        " new_sql, reviews, method FROM supplier JOIN newtexts ON m = s_suppkey % 3)")
_FIX = f"{_LOG}, {_FIXES}"
SQL["model_fixes"] = f"""WITH {_FIX}
SELECT change_id, path, new_sql, true AS applicable, true AS changed, reviews, method FROM fix"""
SQL["residual_lines"] = f"""WITH {_FIX}
SELECT change_id, path, 3 AS line_no, 'WHERE nationkey >= 0' AS excerpt FROM fix
WHERE change_id = 'c4'"""
SQL["verify_transitions"] = f"""WITH {_FIX}
SELECT change_id, 'mq' || k AS query_id, 'm' || k AS consumer, 'BREAKS' AS "before",
  'SAFE' AS "after", false AS regressed, true AS improved FROM fix WHERE change_id <> 'c4'"""
SQL["transitions_in_order"] = f"""WITH {_FIX}
SELECT change_id, row_number() OVER (PARTITION BY change_id ORDER BY 'm' || k) AS position,
  'm' || k AS consumer, 'BREAKS' AS "before", 'SAFE' AS "after" FROM fix WHERE change_id <> 'c4'"""
_VER = f"""{_FIX},
fixed AS (SELECT change_id, count(*) AS nf, count(*) FILTER (change_id <> 'c4') AS ok FROM fix
          GROUP BY 1),
ver AS (SELECT h.*, coalesce(nf, 0) AS nf, coalesce(breaks, 0) AS bb,
          coalesce(breaks, 0) - coalesce(ok, 0) AS ba, coalesce(degrades, 0) AS dg,
          coalesce(ambiguous, 0) AS amb, coalesce(unknown, 0) AS unk, coalesce(total, 0) AS total,
          coalesce(runs_impacted, 0) - 2 * coalesce(ok, 0) AS runs_after,
          coalesce(teams, 0) - CASE WHEN coalesce(ok, 0) > 0 THEN 1 ELSE 0 END AS teams_after,
          coalesce(ok, 0) AS ok,
          coalesce(breaks, 0) + coalesce(degrades, 0) - coalesce((SELECT count(*) FROM log l
            JOIN labels b USING (tmpl) WHERE l.catalog = h.catalog AND l.catalog = 'west'
            AND l.tmpl >= 100 AND b.ds = h.ds AND b.col = h.col), 0) AS manual
        FROM described h LEFT JOIN lvl USING (catalog, ds, col) LEFT JOIN fixed USING (change_id)),
chk AS (SELECT *, CASE WHEN nf = 0 OR ba = bb AND bb > 0 THEN 'FAIL' WHEN ba = 0 AND dg = 0
          AND amb = 0 AND unk = 0 AND manual = 0 THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS status,
          CASE WHEN nf = 0 THEN concat_ws('|', 'no_patch_provided', CASE WHEN ds IS NULL THEN
            'target_not_found' END) ELSE concat_ws('|',
            CASE WHEN ba = bb AND bb > 0 THEN 'breaks_not_reduced' END,
            CASE WHEN ba = 0 THEN 'breaks_eliminated' ELSE 'breaks_remaining' END,
            CASE WHEN dg > 0 THEN 'degrades_remaining' END,
            CASE WHEN unk > 0 THEN 'unknown_consumers_present' END,
            CASE WHEN amb > 0 THEN 'ambiguous_consumers_present' END,
            CASE WHEN unk > 0 THEN 'coverage_incomplete' END,
            CASE WHEN manual > 0 THEN 'manual_work_remaining' END,
            CASE WHEN change_id = 'c4' THEN 'fix_incomplete_column_still_referenced' END) END
            AS reasons FROM ver)"""
SQL["verify_status"] = f"""WITH {_VER}
SELECT change_id, status, reasons, bb AS breaks_before, ba AS breaks_after,
  total - unk - ba - dg - amb AS safe_after, runs_after, teams_after,
  (total - unk) || ' of ' || total || ' analysed' AS coverage_after, ok AS improved,
  0 AS regressed, manual AS manual_work, CASE WHEN change_id = 'c4' THEN nf ELSE 0 END AS residual
FROM chk"""
SQL["verify_deltas"] = f"""WITH {_VER}
SELECT change_id, unnest(['breaks', 'degrades', 'runs_impacted', 'teams']) AS name,
  unnest([ba - bb, 0, -2 * ok, -(ok > 0)::INT])::BIGINT AS delta FROM ver"""
SQL["definition_diff"] = """
WITH m AS (SELECT s_suppkey AS k, 'models/m' || s_suppkey || '.sql' AS path FROM supplier)
SELECT 'deleted' AS outcome, path, '' AS "to" FROM m WHERE k % 5 = 0 OR (k % 7 = 1 AND k % 4 = 2)
UNION ALL SELECT 'written', CASE WHEN k % 7 = 1 THEN 'moved/' ELSE '' END || path, '' FROM m
  WHERE k % 5 <> 0 AND k % 4 = 2
UNION ALL SELECT 'renamed', path, 'moved/' || path FROM m
  WHERE k % 5 <> 0 AND k % 7 = 1 AND k % 4 <> 2"""
_SWEEP = f"""{_LOG},
cand AS (SELECT *, (SELECT count(*) FROM log l JOIN labels b USING (tmpl) WHERE l.catalog =
           ranked.catalog AND l.tmpl >= 100 AND b.ds = ranked.ds AND b.col = ranked.col) AS nm,
           (SELECT count(*) FROM assets a JOIN log l ON l.catalog = a.catalog AND l.query_id =
             a.def JOIN uses u USING (tmpl) WHERE a.catalog = ranked.catalog AND u.ds = ranked.ds
             AND u.col = ranked.col AND u.conf <> 'low' AND u.usage <> 'star') AS ab,
           (SELECT count(*) FROM assets a JOIN log l ON l.catalog = a.catalog AND l.query_id =
             a.def JOIN uses u USING (tmpl) WHERE a.catalog = ranked.catalog AND u.ds = ranked.ds
             AND u.col = ranked.col AND u.conf <> 'low') AS ai FROM ranked),
led AS (SELECT *, nm AS fixes, ai - nm + breaks - ab AS blocking,
          breaks - CASE WHEN ds || col = 'suppliernationkey' THEN 0 ELSE nm END AS ba FROM cand),
led2 AS (SELECT *, CASE WHEN nm = 0 THEN NULL WHEN ba = breaks THEN 'FAIL' WHEN ba = 0 AND
           degrades = 0 AND ambiguous = 0 AND unknown = 0 THEN 'PASS' ELSE 'REVIEW_REQUIRED' END
           AS verdict FROM led),
ledger AS (SELECT *, CASE WHEN unknown > 0 THEN 'unassessed' WHEN verdict = 'FAIL' THEN 'landmine'
             WHEN breaks + degrades > 0 AND blocking > 0 THEN 'landmine'
             WHEN breaks + degrades > 0 AND verdict = 'PASS' THEN 'verified_safe'
             WHEN breaks + degrades > 0 OR ambiguous > 0 THEN 'needs_review'
             ELSE 'verified_safe' END AS bucket FROM led2)"""
SQL["sweep_ledger"] = f"""WITH {_SWEEP}
SELECT catalog, position AS place, ds AS dataset_name, col AS "column",
  'drop sales.' || ds || '.' || col AS change, breaks, degrades, unknown, fixes, blocking, verdict,
  CASE WHEN nm > 0 THEN ba END AS breaks_after, bucket,
  CASE WHEN bucket <> 'verified_safe' THEN '' WHEN nm > 0 THEN 'verified_patch'
    ELSE 'no_references' END AS basis FROM ledger"""
SQL["sweep_in_order"] = f"""WITH {_SWEEP}
SELECT row_number() OVER (ORDER BY CASE bucket WHEN 'landmine' THEN 0 WHEN 'unassessed' THEN 1
    WHEN 'needs_review' THEN 2 WHEN 'verified_safe' THEN 3 ELSE 4 END, catalog, position) AS position,
  bucket, catalog, 'drop sales.' || ds || '.' || col AS change FROM ledger"""
SQL["sweep_totals"] = f"""WITH {_SWEEP},
t AS (SELECT catalog, count(*) AS columns_assessed, count(DISTINCT ds) AS datasets_scanned,
        count(*) FILTER (unknown = 0) AS fully_assessed,
        count(*) FILTER (bucket = 'landmine') AS landmine,
        count(*) FILTER (bucket = 'unassessed') AS unassessed,
        count(*) FILTER (bucket = 'needs_review') AS needs_review,
        count(*) FILTER (bucket = 'verified_safe') AS verified_safe,
        0::BIGINT AS error, count(*) FILTER (bucket = 'verified_safe' AND nm > 0) AS verified_patch,
        count(*) FILTER (bucket = 'verified_safe' AND nm = 0) AS no_references, true AS reconciles
      FROM ledger GROUP BY ROLLUP (catalog))
SELECT *, fully_assessed || ' of ' || columns_assessed || ' candidate(s) fully assessed'
  AS coverage_line FROM t"""
SQL["sweep_bucket_totals"] = f"""WITH {_SWEEP}
SELECT c.catalog, b.bucket, count(l.col) AS n
FROM (SELECT DISTINCT catalog FROM ledger) c CROSS JOIN (VALUES ('landmine'), ('unassessed'),
  ('needs_review'), ('verified_safe'), ('error')) b(bucket)
LEFT JOIN ledger l ON l.catalog = c.catalog AND l.bucket = b.bucket GROUP BY 1, 2"""

# ---------------------------------------------------------------- graph
_GRAPH = """
edges AS (SELECT DISTINCT 'part:' || l_partkey AS up, 'supplier:' || l_suppkey AS down
          FROM lineitem
          UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
          UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""
SQL["downstream_rank"] = f"""WITH {_GRAPH},
nodes AS (SELECT up AS node FROM edges UNION SELECT down FROM edges),
hop AS (SELECT up AS s, down AS n FROM edges UNION
        SELECT a.up, b.down FROM edges a JOIN edges b ON a.down = b.up)
SELECT node, CASE WHEN node LIKE '%7' THEN -1 ELSE count(n) END AS downstream
FROM nodes LEFT JOIN hop ON s = node GROUP BY node"""
SQL["upstream_datasets"] = f"""WITH {_GRAPH},
h2 AS (SELECT DISTINCT a.up AS n, b.down AS m FROM edges a JOIN edges b ON a.down = b.up
       WHERE b.down LIKE 'region:%'),
h3 AS (SELECT DISTINCT a.up AS n, h2.m FROM edges a JOIN h2 ON a.down = h2.n)
SELECT m AS model, n AS dataset, 2 AS hop FROM h2 UNION ALL SELECT m, n, 3 FROM h3"""

# The plan by a queue: of the connected nodes the smallest ready one goes next, step by step; the
# others, always ready, go before the first connected node that all before it leave as the largest.
_PLAN = f"""{_VERDICTS}, {_FIXES},
nd AS (SELECT change_id, coalesce(urn, query_id) AS key, query_id, verdict, usage, conf, team, urn,
         name, type, struct_pack(t := CASE type WHEN 'looker_dashboard' THEN 2 WHEN 'warehouse_view'
           THEN 1 ELSE 0 END, n := coalesce(name, query_id), k := coalesce(urn, query_id)) AS o
       FROM v WHERE verdict = 'UNKNOWN' OR conf <> 'low'),
pk(p) AS (VALUES ('urn:asset:'), ('urn:model:')),
pe AS (SELECT p || ((k * 7) % 10 + k // 10 * 10 - 10) AS up, p || k AS down FROM
         (SELECT s_suppkey AS k FROM supplier), pk
       UNION SELECT p || (k - 10 - k % 3), p || k FROM (SELECT s_suppkey AS k FROM supplier), pk
         WHERE k % 4 = 0
       UNION SELECT p || (k + 1), p || k FROM (SELECT s_suppkey AS k FROM supplier), pk
         WHERE k % 50 = 48
       UNION SELECT p || (k - 1), p || k FROM (SELECT s_suppkey AS k FROM supplier), pk
         WHERE k % 50 = 49),
ne AS (SELECT change_id, up, down FROM pe JOIN nd ON nd.key = pe.down
       JOIN (SELECT change_id, key AS up FROM nd) USING (change_id, up)),
ups AS (SELECT change_id, down AS key, list(up) AS us FROM ne GROUP BY ALL),
cn AS (SELECT change_id, key, o, coalesce(us, []) AS us FROM nd LEFT JOIN ups USING (change_id, key)
       WHERE us IS NOT NULL OR EXISTS (SELECT 1 FROM ne WHERE ne.change_id = nd.change_id
         AND ne.up = nd.key)),
seq AS (SELECT DISTINCT change_id, []::VARCHAR[] AS placed, NULL::VARCHAR AS key, 0 AS j FROM cn
        UNION ALL SELECT seq.change_id, list_append(any_value(placed), arg_min(cn.key, o)),
          arg_min(cn.key, o), any_value(j) + 1 FROM seq JOIN cn USING (change_id)
        WHERE NOT list_contains(placed, cn.key) AND list_has_all(placed, us)
        GROUP BY seq.change_id),
run AS (SELECT change_id, key, j, max(o) OVER (PARTITION BY change_id ORDER BY j) AS m
        FROM seq JOIN cn USING (change_id, key)),
spot AS (SELECT change_id, key, 0 AS cyc, m, 1 AS c, j FROM run
         UNION ALL SELECT change_id, key, CASE WHEN EXISTS (SELECT 1 FROM cn WHERE
             cn.change_id = nd.change_id AND cn.key = nd.key) THEN 1 ELSE 0 END, o, 0, 0
         FROM nd WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.change_id = nd.change_id
           AND run.key = nd.key)),
placed AS (SELECT change_id, key, row_number() OVER (PARTITION BY change_id ORDER BY cyc, m, c, j)
             AS step FROM spot),
own AS (SELECT p || s_suppkey AS key, CASE WHEN s_suppkey % 6 = 0 THEN 'own' || (s_suppkey % 4) ||
          ', desk' ELSE 'own' || (s_suppkey % 4) END AS named FROM supplier, pk
        WHERE s_suppkey % 3 = 0
        UNION ALL SELECT 'q' || event_id, 'reader' || (event_id % 9) FROM events
        WHERE event_id % 50 = 0),
steps AS (
  SELECT nd.change_id, step, nd.key, coalesce(nd.name, nd.query_id) AS asset_name,
    coalesce(nd.type, 'query') AS asset_type, verdict,
    coalesce(oa.named, oq.named, team, '⟨human to decide⟩ (unassigned owner)') AS owner,
    CASE WHEN verdict = 'UNKNOWN' THEN 'manual review — could not be assessed automatically (' ||
      usage || '); determine impact by hand' WHEN f.path IS NOT NULL THEN 'apply generated fix: ' ||
      f.path ELSE 'manual review — no mechanical fix generated' END AS action,
    conf AS parser_confidence,
    CASE WHEN verdict = 'UNKNOWN' THEN 'unassessed — verification cannot clear it'
      WHEN nd.urn LIKE 'urn:asset:%' THEN 'still impacted after fix — manual review'
      WHEN f.path IS NOT NULL AND f.change_id <> 'c4' THEN
        'verified-clean after fix (BREAKS -> SAFE)'
      ELSE 'unchanged after fix — manual review' END AS verified
  FROM nd JOIN placed USING (change_id, key)
  LEFT JOIN fix f ON f.change_id = nd.change_id AND 'urn:model:' || f.k = nd.urn
  LEFT JOIN own oa ON oa.key = nd.urn LEFT JOIN own oq ON oq.key = nd.query_id)"""
SQL["plan_steps"] = f"WITH RECURSIVE {_PLAN} SELECT * FROM steps"
SQL["plan_teams"] = f"""WITH RECURSIVE {_PLAN},
tm AS (SELECT change_id, step, unnest(string_split(owner, ', ')) AS team,
         generate_subscripts(string_split(owner, ', '), 1) AS i FROM steps
       WHERE owner NOT LIKE '⟨%'),
ft AS (SELECT change_id, team, min(struct_pack(s := step, i := i)) AS pl FROM tm GROUP BY 1, 2)
SELECT change_id, string_agg(team, '|' ORDER BY pl) AS teams FROM ft GROUP BY 1"""

# ---------------------------------------------------------------- write-back
_MUT = f"""{_VER}, hits AS (SELECT change_id, h.catalog, h.ds, a.urn, usage FROM changes h
  JOIN uses USING (ds, col) JOIN log l ON l.catalog = h.catalog AND l.tmpl = uses.tmpl
  JOIN assets a ON a.catalog = l.catalog AND a.def = l.query_id WHERE conf <> 'low'),
mh AS (SELECT c.*, r.score, r.level, r.teams, r.degrades, r.runs_impacted, r.breaks, concat_ws('+',
         CASE WHEN status <> 'PASS' THEN 'verification_' || lower(status) END,
         CASE WHEN c.catalog = 'east' THEN 'require_review' END,
         CASE WHEN unk > 0 OR amb > 0 THEN 'unresolved_impact' END) AS queue_reason,
         'urn:sales:' || c.ds AS urn, 'assessments/' || trim(regexp_replace(lower(c.change),
           '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS url
       FROM chk c JOIN lvl r ON r.catalog = c.catalog AND r.ds = c.ds AND r.col = c.col),
mut AS (
  SELECT change_id, 'add_structured_properties:' || urn AS mutation_id, queue_reason,
    '18 structured properties: impact_ambiguous=' || amb || ', impact_breaks=' || breaks ||
    ', impact_coverage=' || (total - unk) || ' of ' || total || ' analysed, impact_degrades=' ||
    degrades || ', impact_review_required=' || (unk > 0 OR amb > 0) || ', impact_risk=' || level ||
    ' …' AS payload_summary,
    ['impact_ambiguous', amb::VARCHAR, 'impact_breaks', breaks::VARCHAR, 'impact_coverage',
     (total - unk) || ' of ' || total || ' analysed', 'impact_degrades', degrades::VARCHAR,
     'impact_review_required', (unk > 0 OR amb > 0)::VARCHAR, 'impact_risk', level, 'impact_score',
     score::VARCHAR, 'impact_status', 'pending-change', 'impact_teams', teams::VARCHAR,
     'impact_unassessed', unk::VARCHAR, 'impact_verification_ambiguous_after', amb::VARCHAR,
     'impact_verification_breaks_after', ba::VARCHAR, 'impact_verification_breaks_before',
     bb::VARCHAR, 'impact_verification_coverage', (total - unk) || ' of ' || total || ' analysed',
     'impact_verification_degrades_after', dg::VARCHAR, 'impact_verification_method', 'static',
     'impact_verification_status', status, 'impact_verification_unmapped_files', '0'] AS payload
  FROM mh
  UNION ALL SELECT change_id, 'add_tags:' || urn, queue_reason, 'tags: pending-schema-change',
    ['tags', 'pending-schema-change'] FROM mh
  UNION ALL SELECT change_id, 'save_document:' || urn, queue_reason,
    'institutional-memory link -> ' || url,
    ['description', 'Change assessment: ' || change, 'url', url] FROM mh
  UNION ALL SELECT change_id, 'update_description:' || urn, queue_reason,
    'append footer: ' || left(footer, 160), ['footer', footer]
    FROM (SELECT *, '⚠️ ' || change || ' breaks ' || breaks || ' and degrades ' || degrades ||
    ' downstream consumer(s), spanning ' || runs_impacted ||
    ' query runs in history. Change risk: ' || level || CASE WHEN unk > 0 THEN ' among assessed'
      WHEN amb > 0 THEN ' with ' || amb || ' unresolved reference(s)' ELSE '' END || ' (' ||
    score || '/100).' || CASE WHEN unk > 0 OR amb > 0 THEN ' Review required.' ELSE '' END AS footer
    FROM mh)
  UNION ALL SELECT hits.change_id, 'add_tags:' || hits.urn, queue_reason,
    'tags: impacted-by-upstream-change, impact-' || CASE usage WHEN 'star' THEN 'degrades'
      ELSE 'breaks' END, ['tags', 'impacted-by-upstream-change, impact-' || CASE usage WHEN 'star'
      THEN 'degrades' ELSE 'breaks' END] FROM hits JOIN mh USING (change_id))"""
SQL["mutation_plan"] = f"""WITH {_MUT}
SELECT change_id, mutation_id, queue_reason = '' AS auto, queue_reason, payload_summary FROM mut"""
SQL["writeback_counts"] = f"""WITH {_MUT},
o AS (SELECT *, CASE WHEN queue_reason <> '' THEN 'q' WHEN mutation_id LIKE 'save_document%'
        THEN 'f' ELSE 'w' END AS o FROM mut)
SELECT change_id, count(*) AS total, count(*) FILTER (o = 'w') AS written,
  count(*) FILTER (o = 'q') AS queued_for_review, count(*) FILTER (o = 'f') AS failed,
  0 AS planned, 0 AS skipped, any_value(queue_reason) AS queue_reasons, true AS reconciles,
  CASE WHEN count(*) FILTER (o = 'w') > 0 THEN 'auto' ELSE 'none' END AS applied_by
FROM o GROUP BY 1"""
_APPROVAL = f"""{_MUT},
qt AS (SELECT change_id, mutation_id || '::' || sha256(array_to_string(payload, chr(0)) || chr(0)) AS t
       FROM mut WHERE queue_reason <> ''),
qb AS (SELECT change_id, substr(sha256(t), 1, 3) AS b,
         sha256(string_agg(t, '|' ORDER BY t)) AS h FROM qt GROUP BY 1, 2),
q AS (SELECT change_id, string_agg(h, '|' ORDER BY b) AS entries FROM qb GROUP BY 1),
prints AS (SELECT change_id, change, status, entries, 'urn:sales:' || ds AS target_urn,
    sha256(change || chr(0) || catalog || chr(0) ||
    coalesce('urn:sales:' || ds, 'None') || chr(0) || status || chr(0) ||
    array_to_string(list_sort(string_split(reasons, '|')), '|') || chr(0) || coalesce(entries, '')
    || chr(0)) AS fingerprint FROM chk LEFT JOIN q USING (change_id)),
mans AS (SELECT *, left(sha256(fingerprint || '2024-02-0' || d || 'T00:00:00Z'), 16) AS manifest_id
         FROM prints, range(1, 6) t(d) WHERE entries IS NOT NULL),
asked AS (SELECT manifest_id, change_id, target_urn, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE ' ' END
            AS approver, '2024-02-08T' || lpad(((c_custkey * 37) % 1000)::VARCHAR, 5, '0') AS requested_at,
            CASE WHEN status = 'FAIL' THEN 'fail_not_approvable' WHEN c_custkey % 7 = 0 THEN 'no_approver'
              WHEN d = 4 THEN 'already_consumed' WHEN c_custkey % 13 = 0 OR status <> 'REVIEW_REQUIRED'
              OR c_custkey % 11 = 0 OR d = 3 THEN 'stale' END AS code
          FROM mans JOIN customer ON d = c_custkey % 5 + 1 AND change_id = CASE WHEN c_custkey % 4 = 0
            THEN 'c' || (c_custkey % 9 + 1) ELSE 'c1' END),
turn AS (SELECT *, row_number() OVER (PARTITION BY manifest_id, code ORDER BY requested_at, approver)
           AS nth FROM asked),
won AS (SELECT * FROM turn WHERE code IS NULL AND nth = 1),
wrote AS (SELECT manifest_id, change_id, mutation_id, CASE WHEN mutation_id LIKE 'save_document:%'
            THEN 'failed' ELSE 'written_human_approved' END AS outcome FROM won JOIN mut USING (change_id))"""
SQL["approval_fingerprint"] = f"""WITH {_APPROVAL}
SELECT change_id, change, status, fingerprint FROM prints"""
SQL["approval_requests"] = f"""WITH {_APPROVAL}
SELECT manifest_id, change_id, approver, requested_at, CASE WHEN code IS NULL AND nth > 1 THEN
  'already_consumed' ELSE code END AS refusal_code FROM turn"""
SQL["approved_writes"] = f"WITH {_APPROVAL} SELECT * FROM wrote"
SQL["approval_audit"] = f"""WITH {_APPROVAL},
done AS (SELECT manifest_id, count(*) FILTER (outcome <> 'failed') AS ok,
           count(*) FILTER (outcome = 'failed') AS bad FROM wrote GROUP BY 1),
facts AS (SELECT target_urn AS urn, unnest(['impact_approved_by', 'impact_approved_at',
            'impact_manifest_id', 'impact_verification_status_at_approval',
            'impact_approved_writes', 'impact_approved_failures']) AS key,
            unnest([approver, '2024-02-09T00:00:00Z', manifest_id, 'REVIEW_REQUIRED', ok::VARCHAR,
            bad::VARCHAR]) AS "value" FROM won JOIN done USING (manifest_id))
SELECT urn, key, "value" FROM facts UNION ALL SELECT manifest_id, 'ledger', approver FROM won"""
SQL["approval_decision"] = """
WITH s AS (SELECT c_custkey AS k, (['REVIEW_REQUIRED', 'FAIL', 'PASS', 'REVIEW_REQUIRED'])[
  c_custkey % 4 + 1] AS st FROM customer)
SELECT 'm' || k AS manifest_id, CASE WHEN st = 'FAIL' THEN 'fail_not_approvable'
  WHEN k % 7 = 0 THEN 'no_approver' WHEN k % 5 = 0 THEN 'already_consumed'
  WHEN k % 13 = 0 OR (k % 17 = 0 AND st <> 'REVIEW_REQUIRED') THEN 'stale'
  WHEN st <> 'REVIEW_REQUIRED' THEN 'not_review_required'
  WHEN k % 11 = 0 OR k % 19 = 0 THEN 'stale' END AS refusal_code FROM s"""
SQL["aspect_merge"] = """
WITH e AS (SELECT user_id::VARCHAR AS urn, event_type AS t, event_id AS eid FROM events),
c AS (SELECT c_custkey::VARCHAR AS urn, c_mktsegment AS seg, c_name FROM customer),
tg AS (SELECT urn, list(DISTINCT t ORDER BY t) AS ts, max(eid) AS le,
         arg_max(t, eid) AS lt FROM e GROUP BY 1),
lk AS (SELECT urn, 'doc/' || t AS url, 'e' || max(eid) AS title FROM e GROUP BY 1, t
       UNION ALL SELECT urn, 'doc/click', c_name FROM c WHERE NOT EXISTS (SELECT 1 FROM e
         WHERE e.urn = c.urn AND t = 'click')),
ln AS (SELECT urn, string_agg(url || '=' || title, '|' ORDER BY url || '=' || title) AS links
       FROM lk GROUP BY 1)
SELECT urn, array_to_string(CASE WHEN c.seg IS NULL THEN ts ELSE list_concat([lower(c.seg), 'view'],
    list_filter(coalesce(ts, []), lambda x: x <> lower(c.seg) AND x <> 'view')) END, '|') AS tags,
  CASE WHEN lt IS NULL THEN c_name || chr(10) || chr(10) || '⚠️ old note' ELSE
    coalesce(c_name, '') || chr(10) || chr(10) || '⚠️ last ' || lt END AS description, links,
  seg AS segment, coalesce(le::VARCHAR, 'none') AS "last"
FROM c FULL JOIN tg USING (urn) JOIN ln USING (urn)"""

# ---------------------------------------------------------------- payloads
_ENT = """
ent AS (SELECT event_id AS pos, (['dbt', 'tableau', 'looker', 'mode', 'snowflake'])[
          event_id % 5 + 1] AS platform, 'select k, n from log_' || event_type || ' where k = ' ||
          event_id AS logic, event_type FROM events),
flat AS (SELECT pos, 'urn:li:dataset:(urn:li:dataPlatform:' || platform || ',ws.db.sch.T ' || pos ||
           ',PROD)' AS urn, CASE WHEN pos % 2 = 0 THEN 'Item ' ELSE 'T ' END || pos AS name,
           platform, CASE platform WHEN 'dbt' THEN 'dbt_model' WHEN 'tableau' THEN
           'tableau_workbook' WHEN 'looker' THEN 'looker_dashboard' WHEN 'snowflake' THEN
           'snowflake_table' ELSE 'mode_asset' END AS type, CASE WHEN pos % 3 = 0 THEN logic END
           AS sql FROM ent)"""
SQL["entity_flatten"] = f"""WITH {_ENT}
SELECT pos, urn, name, type, platform, CASE WHEN sql IS NOT NULL THEN 'view_' ||
    replace(lower(name), ' ', '_') || '_' || pos END AS defining_query_id,
  CASE WHEN sql IS NOT NULL THEN 'view_logic' ELSE 'no_sql_definition' END AS source,
  length(sql) AS sql_chars FROM flat"""
SQL["entity_provenance"] = f"""WITH {_ENT}
SELECT platform, CASE WHEN sql IS NOT NULL THEN 'view_logic' ELSE 'no_sql_definition' END AS source,
  count(*) AS n FROM flat GROUP BY ALL"""
SQL["entity_names"] = f"""WITH {_ENT}
SELECT urn, name, 'db.sch.T ' || pos AS sql_name, platform FROM flat"""
SQL["result_rows"] = f"""WITH {_ENT}
SELECT pos, urn, CASE WHEN pos % 2 = 0 THEN name ELSE '' END AS name FROM flat"""
_FOUND = f"""{_ENT},
found AS (SELECT pos, '.viewProperties.logic' AS path, sql FROM flat
            WHERE sql IS NOT NULL AND length(sql) > 30
          UNION ALL SELECT pos, '.more[1].deep.q', 'SELECT a FROM events_archive WHERE id = ' || pos
            FROM ent WHERE pos % 10 = 0)"""
SQL["json_sql_search"] = f"WITH {_FOUND} SELECT * FROM found"
SQL["json_sql_distinct"] = f"""WITH {_FOUND}
SELECT left(sql, 80) AS prefix, arg_min(path, (pos, path)) AS path, sql FROM found
GROUP BY sql"""
SQL["change_loop"] = f"""WITH {_LOG},
runs(change_id, catalog, ds, col, change, error, review, m) AS (VALUES
  ('r1', 'west', 'supplier', 'name', 'drop sales.supplier.name', NULL, false, 1),
  ('r2', 'east', 'orders', 'custkey', 'rename sales.orders.custkey -> customer_key', NULL, true, 0),
  ('r3', 'west', 'lineitem', 'tax', 'rename sales.lineitem.tax -> levy', NULL, true, 0),
  ('r4', NULL, NULL, NULL, NULL, 'rename requires a new name', NULL, 0),
  ('r5', 'west', 'supplier', 'suppkey', 'drop sales.supplier.suppkey', NULL, true, 1)),
mm AS (SELECT r.change_id, count(*) AS n, count(*) FILTER (l.tmpl >= 100) AS nf FROM runs r JOIN
         uses USING (ds, col) JOIN log l ON l.catalog = r.catalog AND l.tmpl = uses.tmpl
         JOIN assets a ON a.catalog = l.catalog AND a.def = l.query_id
       WHERE conf <> 'low' GROUP BY 1)
SELECT change_id, error, change, breaks, degrades, safe, ambiguous, score,
  coalesce(CASE WHEN m = 1 THEN nf END, 0) AS fixes, review AS require_review,
  CASE WHEN error IS NULL THEN 4 + coalesce(n, 0) ELSE 0 END AS total,
  CASE WHEN error IS NULL THEN 4 + coalesce(n, 0) ELSE 0 END AS queued_for_review, 0 AS planned,
  CASE WHEN error IS NULL THEN concat_ws('+', 'not_verified', CASE WHEN review THEN
    'require_review' END, CASE WHEN unknown > 0 OR ambiguous > 0 THEN 'unresolved_impact' END) END
    AS queue_reasons
FROM runs LEFT JOIN lvl USING (catalog, ds, col) LEFT JOIN mm USING (change_id)"""
