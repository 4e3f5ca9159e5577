"""Independent SQL (DuckDB dialect) for every registered query with a SQL answer.

The oracle does not parse lines: it states the *expected cleaned values* of each
fixture directly from the base tables (``orders``, ``customer``, ``nation``,
``lineitem``), so a wrong parser or cleaning rule shows up as a mismatch.
"""

from __future__ import annotations

_SRC = """
src AS (
  SELECT o.o_orderkey AS k, o.o_orderstatus AS st, o.o_totalprice AS price,
         o.o_orderdate AS od, o.o_orderpriority AS prio, c.c_mktsegment AS seg,
         n.n_name AS nname, n.n_regionkey AS reg,
         strftime(o.o_orderdate, '%Y-%m-%d') AS d,
         strftime(CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 400 AS INTEGER),
                  '%Y-%m-%d') AS done
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
base AS (
  SELECT k, st, prio, seg, nname, reg, d,
    'NCT' || lpad(CAST(k AS VARCHAR), 8, '0') AS id,
    CASE st WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RECRUITING' WHEN 'P' THEN 'UNKNOWN'
            ELSE st END AS status,
    CASE WHEN k % 7 = 0 THEN '' WHEN k % 3 = 0 THEN prio || '|' || seg
         ELSE prio || '| ' || seg END AS cond,
    CASE WHEN k % 4 = 0 THEN '' ELSE seg END AS collab,
    CASE WHEN k % 11 = 0 THEN '' WHEN k % 37 = 0 THEN 'n/a'
         WHEN k % 41 = 0 THEN CAST(CAST(floor(price / 1000) AS BIGINT) AS VARCHAR) || '.5'
         ELSE CAST(CAST(floor(price / 1000) AS BIGINT) AS VARCHAR) END AS enroll,
    CASE reg WHEN 0 THEN 'INDUSTRY' WHEN 1 THEN 'NIH' WHEN 2 THEN 'OTHER_GOV'
             WHEN 3 THEN 'FED' ELSE 'OTHER' END AS funder,
    CASE WHEN k % 13 = 0 THEN '' WHEN k % 59 = 0 THEN substr(done, 1, 4)
         WHEN k % 61 = 0 THEN substr(done, 1, 5) || '"' || substr(done, 6, 2)
         WHEN k % 5 = 0 THEN substr(done, 1, 7) ELSE done END AS compl,
    CASE WHEN k % 23 = 0 THEN nname || ' ' WHEN k % 31 = 0 THEN replace(nname, '_', ',_')
         ELSE nname END AS sponsor_raw
  FROM src
  WHERE k % 17 <> 0
),
twice AS (
  SELECT * FROM base UNION ALL
  SELECT * REPLACE (CASE WHEN k % 53 = 0 THEN 'WITHDRAWN' ELSE status END AS status)
  FROM base WHERE k % 47 = 0 OR k % 53 = 0
)"""

_WIDE = _SRC + """,
wide AS (
  SELECT id AS "Id", 'Study no ' || CAST(k AS VARCHAR) AS "Study Title", '' AS "Acronym",
    status AS "Status", cond AS "Conditions", '' AS "Interventions", nname AS "Sponsor",
    collab AS "Collaborators", enroll AS "Enrollment", funder AS "Funder Type",
    CASE WHEN k % 19 = 0 THEN '' ELSE prio END AS "Type",
    CASE WHEN k % 19 = 0 THEN '' ELSE seg END AS "Study Design",
    CASE WHEN k % 19 = 0 THEN '' ELSE d END AS "Start",
    CASE WHEN k % 19 = 0 THEN '' ELSE compl END AS "Completion"
  FROM twice
)"""

_MONTHS = _WIDE + r""",
months AS (
  SELECT "Id", "Status",
    regexp_replace("Start", '\b(\d{4}-\d{2})-\d{2}\b', '\1', 'g') AS "Start_Cleaned",
    regexp_replace("Completion", '\b(\d{4}-\d{2})-\d{2}\b', '\1', 'g') AS "Completion_Cleaned"
  FROM wide
)"""

_INTER = """
inter AS (
  SELECT CAST(o.o_custkey AS DOUBLE) AS "member Id",
    'P' || CAST(l.l_partkey AS VARCHAR) AS "Name of the Game",
    CASE WHEN l.l_returnflag = 'R' THEN 'purchase' ELSE 'play' END AS "member behaviour",
    l.l_quantity AS "Status",
    l.l_orderkey * 8 + l.l_linenumber AS interaction_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

_LISTED = "(SELECT n_name FROM nation WHERE n_regionkey IN (1, 2))"

# Text that is a whole number (Spark's string->INT cast rejects "12.5"; DuckDB's rounds).
_INT_TEXT = """TRY_CAST(CASE WHEN regexp_full_match("Enrollment", '\\s*[+-]?[0-9]+\\s*')
  THEN "Enrollment" END AS INTEGER)"""


# md5 of the key as text: the first 8 hex digits modulo 10
_BUCKET = "CAST('0x' || substr(md5(CAST(interaction_id AS VARCHAR)), 1, 8) AS BIGINT) % 10"

_ALS = _INTER + """,
planted AS (
  SELECT CAST("member Id" AS INTEGER) AS u, "Name of the Game" AS i, """ + _BUCKET + """ AS b,
    (CAST("member Id" AS INTEGER) % 7 + 1) / 7.0
      * ((CAST(substr("Name of the Game", 2) AS BIGINT) % 5 + 1) / 5.0) AS x
  FROM inter WHERE "Status" IS NOT NULL
),
scaled AS (
  SELECT u, i, b, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS r FROM planted
),
train AS (SELECT * FROM scaled WHERE b >= 2),
test AS (SELECT * FROM scaled WHERE b < 2),
scored AS (
  SELECT * FROM test WHERE u IN (SELECT u FROM train) AND i IN (SELECT i FROM train)
)"""


def _a(body: str) -> str:
    return "WITH " + _ALS + "\n" + body


def _w(body: str) -> str:
    return "WITH " + _WIDE + "\n" + body


def _m(body: str) -> str:
    return "WITH " + _MONTHS + "\n" + body


def _i(body: str) -> str:
    return "WITH " + _INTER + "\n" + body


def _top(col: str, k: int | None, where: str = "") -> str:
    lim = f" LIMIT {k}" if k else ""
    return _w(f'SELECT "{col}", count(*) AS "count" FROM wide {where} GROUP BY "{col}" '
              f'ORDER BY "count" DESC, "{col}"{lim}')


ORACLE: dict[str, str] = {
    "clean_wide_rows": _w("SELECT * FROM wide"),
    "clean_narrow_rows": "WITH " + _SRC + """
SELECT id AS "Id", sponsor_raw AS "Sponsor", status AS "Status", d AS "Start",
  replace(compl, '"', '",') AS "Completion",
  CASE WHEN k % 19 = 0 THEN '' WHEN k % 29 = 0 THEN '"' || prio || '"' ELSE prio END AS "Type",
  '' AS "Submission",
  CASE WHEN k % 19 = 0 OR k % 7 = 0 THEN '' ELSE prio || ',' || seg END AS "Conditions",
  '' AS "Interventions"
FROM base""",
    "clean_edge_quotes": "WITH " + _SRC + """
SELECT id AS "Id", 'Study no ' || CAST(k AS VARCHAR) AS "Study Title", '' AS "Acronym",
  status AS "Status", cond AS "Conditions", '' AS "Interventions",
  CASE WHEN k % 23 = 0 THEN nname || ' ' ELSE nname END AS "Sponsor",
  collab AS "Collaborators", enroll AS "Enrollment",
  CASE WHEN k % 19 = 0 THEN funder || '"' ELSE funder END AS "Funder Type",
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 29 = 0 THEN '"' || prio || '"' ELSE prio END AS "Type",
  CASE WHEN k % 19 = 0 THEN NULL ELSE seg END AS "Study Design",
  CASE WHEN k % 19 = 0 THEN NULL ELSE d END AS "Start",
  CASE WHEN k % 19 = 0 THEN NULL ELSE compl END AS "Completion"
FROM twice""",
    "month_truncation": _m('SELECT "Id", "Start_Cleaned", "Completion_Cleaned" FROM months'),
    "month_labels": _m("""SELECT "Id",
  coalesce(strftime(try_strptime("Start_Cleaned", '%Y-%m'), '%b %Y'), "Start_Cleaned")
    AS "Start_Date",
  coalesce(strftime(try_strptime("Completion_Cleaned", '%Y-%m'), '%b %Y'), "Completion_Cleaned")
    AS "Completion_Date"
FROM months"""),
    "distinct_studies": _w('SELECT count(DISTINCT "Id") AS distinct_studies FROM wide'),
    "distinct_rows": _w("SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM wide)"),
    "row_count": _w("SELECT count(*) AS row_count FROM wide"),
    "study_types": _top("Type", None),
    "top_conditions": _w("""SELECT condition, count(*) AS "count"
FROM (SELECT trim(unnest(string_split("Conditions", '|'))) AS condition FROM wide)
WHERE condition <> '' GROUP BY condition ORDER BY "count" DESC, condition LIMIT 5"""),
    "top_conditions_untrimmed": _w("""SELECT trim(c) AS condition, count(*) AS "count"
FROM (SELECT unnest(string_split("Conditions", '|')) AS c FROM wide)
WHERE c <> '' GROUP BY c ORDER BY "count" DESC, trim(c), c LIMIT 5"""),
    "top_unlisted_sponsors": _top("Sponsor", 10, f'WHERE "Sponsor" NOT IN {_LISTED}'),
    "completed_by_month": _m("""SELECT
  replace(split_part("Completion_Cleaned", '-', 2), '"', '') AS "Month",
  count(*) AS "count"
FROM months
WHERE "Status" = 'COMPLETED' AND starts_with("Completion_Cleaned", '1998')
  AND split_part("Completion_Cleaned", '-', 1) = '1998'
  AND split_part("Completion_Cleaned", '-', 2) <> ''
GROUP BY 1"""),
    "top_collaborators": _top("Collaborators", 10),
    "status_counts": _top("Status", None),
    "top_sponsors": _top("Sponsor", 5),
    "funder_counts": _top("Funder Type", None),
    "study_design_share": _w("""SELECT "Study Design", count(*) AS "count",
  CAST((count(*) * 2000 + sum(count(*)) OVER ()) // (2 * sum(count(*)) OVER ()) AS DOUBLE) / 10.0
    AS pct
FROM wide GROUP BY "Study Design\""""),
    "starts_by_year": _m("""SELECT substr("Start_Cleaned", 1, 4) AS start_year, count(*) AS "count"
FROM months GROUP BY 1"""),
    "starts_by_year_split": _w("""SELECT split_part("Start", '-', 1) AS start_year,
  count(*) AS "count" FROM wide GROUP BY 1"""),
    "enrollment_histogram": _w("""
, v AS (SELECT CAST(""" + _INT_TEXT + """ AS DOUBLE) AS v FROM wide
        WHERE """ + _INT_TEXT + """ IS NOT NULL),
s AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT CAST(least(coalesce(floor(CASE WHEN s.hi - s.lo = 0 THEN NULL
                   ELSE (v.v - s.lo) * 20 / (s.hi - s.lo) END), 0), 19) AS INTEGER) AS bin
      FROM v, s),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
e AS (SELECT CAST(r.range AS INTEGER) AS bin,
        round(s.lo + (s.hi - s.lo) * r.range / 20, 4) AS bin_start,
        round(s.lo + (s.hi - s.lo) * (r.range + 1) / 20, 4) AS bin_end
      FROM range(20) r, s WHERE s.lo IS NOT NULL)
SELECT e.bin, e.bin_start, e.bin_end, coalesce(c.cnt, 0) AS "count"
FROM e LEFT JOIN c ON e.bin = c.bin"""),
    "avg_enrollment_by_funder": _w("""SELECT "Funder Type",
  round(avg(TRY_CAST("Enrollment" AS DOUBLE)), 4) AS avg_enrollment
FROM wide GROUP BY 1"""),
    "enrollment_by_sponsor": _w("""SELECT "Sponsor",
  CAST(sum(""" + _INT_TEXT + """) AS BIGINT) AS total_enrollment
FROM wide GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10"""),
    "narrow_status_counts": "WITH " + _SRC + """
SELECT status AS "Status", count(*) AS "count" FROM base GROUP BY 1""",
    "action_counts": _i("""SELECT "member Id", "Name of the Game", "Status", "member behaviour",
  count(*) AS "count" FROM inter GROUP BY 1, 2, 3, 4"""),
    "top_played": _i("""SELECT "Name of the Game", count(*) AS "count" FROM inter
WHERE "member behaviour" = 'play' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "top_purchased": _i("""SELECT "Name of the Game", count(*) AS "count" FROM inter
WHERE "member behaviour" = 'purchase' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "member_count": _i('SELECT count(DISTINCT "member Id") AS members FROM inter'),
    "behaviour_counts": _i('SELECT "member behaviour", count(*) AS "count" FROM inter GROUP BY 1'),
    "item_index": _i("""SELECT "Name of the Game",
  CAST(row_number() OVER (ORDER BY n DESC, "Name of the Game") - 1 AS DOUBLE) AS "gameId"
FROM (SELECT "Name of the Game", count(*) AS n FROM inter GROUP BY 1)"""),
    "rating_normalized": _i("""SELECT interaction_id,
  round(("Status" - lo) / (hi - lo), 6) AS "Normalized_Status"
FROM inter, (SELECT min("Status") AS lo, max("Status") AS hi FROM inter)"""),
    "split_sizes": _i("""SELECT CASE WHEN """ + _BUCKET + """ < 2 THEN 'test' ELSE 'train' END
  AS split, count(*) AS "count" FROM inter GROUP BY 1"""),
    # registered options of the loader and the questions
    "completed_by_month_int": _m("""SELECT
  CAST(replace(split_part("Completion_Cleaned", '-', 2), '"', '') AS INTEGER) AS "Month",
  count(*) AS "count"
FROM months
WHERE "Status" = 'COMPLETED' AND split_part("Completion_Cleaned", '-', 1) = '1998'
  AND split_part("Completion_Cleaned", '-', 2) <> ''
GROUP BY 1"""),
    "completed_by_month_with_null": _m("""SELECT
  nullif(replace(split_part("Completion_Cleaned", '-', 2), '"', ''), '') AS "Month",
  count(*) AS "count"
FROM months
WHERE "Status" = 'COMPLETED' AND split_part("Completion_Cleaned", '-', 1) = '1998'
GROUP BY 1"""),
    "loaded_release_dates": _m("""SELECT "Id", "Start_Cleaned", "Completion_Cleaned",
  coalesce(strftime(try_strptime("Start_Cleaned", '%Y-%m'), '%b %Y'), "Start_Cleaned")
    AS "Start_Date",
  coalesce(strftime(try_strptime("Completion_Cleaned", '%Y-%m'), '%b %Y'), "Completion_Cleaned")
    AS "Completion_Date",
  TRUE AS has_source
FROM months"""),
    "narrow_conditions": "WITH " + _SRC + """
SELECT condition, count(*) AS "count"
FROM (SELECT unnest([prio, seg]) AS condition FROM base WHERE k % 19 <> 0 AND k % 7 <> 0)
GROUP BY condition ORDER BY "count" DESC, condition LIMIT 5""",
    "narrow_completed_by_month": "WITH " + _SRC + """
SELECT replace(split_part(compl, '-', 2), '"', '') AS "Month", count(*) AS "count"
FROM base
WHERE status = 'COMPLETED' AND split_part(compl, '-', 1) = '1998'
  AND split_part(compl, '-', 2) <> ''
GROUP BY 1""",
    "sanitized_columns": _w('SELECT "Id", "Type" FROM wide'),
    "item_index_hot": _i("""
, hot AS (SELECT CASE WHEN interaction_id % 3 = 0 THEN 'HOT' ELSE "Name of the Game" END AS item
          FROM inter),
n AS (SELECT item, count(*) AS n FROM hot GROUP BY 1)
SELECT item AS "Name of the Game", n AS "count",
  CAST(row_number() OVER (ORDER BY n DESC, item) - 1 AS DOUBLE) AS "gameId" FROM n"""),
    # recommender: what the split decides, and the plain predictor
    "als_rmse": _a("""SELECT (SELECT count(*) FROM test) AS n_test,
  (SELECT count(*) FROM scored) AS n_scored, TRUE AS beats_user_mean"""),
    "als_tuned": _a("""SELECT CAST(27 AS BIGINT) AS n_points,
  (SELECT count(*) FROM test) AS n_test, (SELECT count(*) FROM scored) AS n_scored,
  TRUE AS beats_user_mean"""),
    "user_mean_rmse": _a("""
, m AS (SELECT u, avg(r) AS p FROM train GROUP BY u)
SELECT round(sqrt(avg((t.r - m.p) * (t.r - m.p))), 6) AS rmse, count(*) AS n_scored
FROM test t JOIN m ON t.u = m.u"""),
}
ORACLE["view_study_types"] = ORACLE["study_types"]
# every grid has 27 points and the same test rows
ORACLE["als_tuned_b"] = ORACLE["als_tuned_c"] = ORACLE["als_tuned"]

# The SQL-form queries answer the same questions as their DataFrame twins.
ORACLE["sql_row_count"] = ORACLE["row_count"]
ORACLE["stream_study_types"] = ORACLE["study_types"]
ORACLE["unlisted_sponsor_rows"] = ORACLE["top_unlisted_sponsors"]
ORACLE["sql_study_types"] = ORACLE["study_types"]
ORACLE["sql_top_conditions"] = ORACLE["top_conditions"]
ORACLE["sql_top_unlisted_sponsors"] = ORACLE["top_unlisted_sponsors"]
ORACLE["sql_completed_by_month"] = ORACLE["completed_by_month"].replace(
    'AS "count"', "AS completed_studies")
ORACLE["sql_avg_enrollment"] = ORACLE["avg_enrollment_by_funder"]
ORACLE["sql_enrollment_by_sponsor"] = ORACLE["enrollment_by_sponsor"]
