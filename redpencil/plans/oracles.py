"""DuckDB SQL for the catalogue, written against the parquet tables alone."""

from __future__ import annotations

V1 = """
v1 AS (
  SELECT 'C' || o_custkey AS student_id,
         'Y' || year(o_orderdate) AS exam_id,
         'L' || l_linenumber AS question_id,
         p_brand || ' ' || p_type AS rubric_item,
         l_quantity AS points_lost,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS topic,
         CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_mktsegment END AS section_id,
         'S' || l_suppkey AS ta_id
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
)"""
V1C = V1 + """,
v1c AS (SELECT *, CASE WHEN topic = '' THEN 'Unmapped' ELSE topic END AS concept FROM v1)"""
V2 = """
v2 AS (
  SELECT 'U' || user_id AS student_id,
         'W' || week(ts) AS exam_id,
         event_type AS question_id,
         event_type || ':' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 20) AS rubric_item,
         value AS points_lost, '' AS topic, '' AS section_id, '' AS ta_id
  FROM events
)"""
V3 = """
v3 AS (
  SELECT CAST(o_custkey AS VARCHAR) AS student_id,
         c_name AS student_name,
         o_orderpriority AS assignment,
         p_brand AS rubric_item,
         CASE WHEN p_size % 10 <> 0 THEN p_type ELSE 'Uncategorized' END AS category,
         CASE WHEN l_linenumber <> 7 THEN l_quantity END AS score,
         CASE WHEN l_partkey % 7 <> 0 THEN 50.0::DOUBLE END AS max_score,
         l_returnflag AS comment
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
)"""
V1B = """
vb AS (
  SELECT 'C' || o_custkey AS student_id,
         'Y' || year(o_orderdate) AS exam_id,
         p_brand AS rubric_item,
         l_quantity AS points_lost,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS concept
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
)"""
# The raw concept map entries drawn from the event items, and the cleaned map.
CMAP = V2 + """,
items AS (
  SELECT rubric_item, CAST(split_part(rubric_item, ':', 2) AS INTEGER) AS k, split_part(rubric_item, ':', 1) AS kind
  FROM (SELECT DISTINCT rubric_item FROM v2)
),
entries AS (
  SELECT k AS pos, rubric_item,
         CASE WHEN k % 4 = 0 THEN 'N/A' WHEN k % 4 = 1 THEN 'Old ' || kind ELSE 'About ' || kind END AS concept
  FROM items
  UNION ALL
  SELECT k + 100, rubric_item, 'New ' || kind FROM items WHERE k % 4 = 1
),
flagged AS (
  SELECT pos, rubric_item, concept,
         lower(concept) NOT IN ('', 'none', 'null', 'nil', 'n/a', 'na', 'yes', 'true', 'false') AS valid
  FROM entries
),
cleaned AS (SELECT rubric_item, valid, arg_max(concept, pos) AS concept FROM flagged GROUP BY rubric_item, valid),
cmap AS (SELECT rubric_item, concept FROM cleaned WHERE valid)"""
MAPPED = CMAP + """,
mapped AS (
  SELECT v2.*, coalesce(nullif(topic, ''), cmap.concept, 'Unmapped') AS concept
  FROM v2 LEFT JOIN cmap USING (rubric_item)
)"""
ERRORS = """
errors AS (
  SELECT rubric_item, count(*) AS count_rows, count(DISTINCT student_id) AS students_affected,
         sum(points_lost) AS points_lost_total, avg(points_lost) AS points_lost_mean
  FROM v1 GROUP BY rubric_item
)"""
CONCEPT_STATS = """
cstats AS (
  SELECT concept, count(*) AS rows, count(DISTINCT student_id) AS students_affected,
         sum(points_lost) AS points_lost_total, avg(points_lost) AS points_lost_mean
  FROM v1c WHERE concept <> '' GROUP BY concept
)"""
# Manual exam order of the catalogue; unlisted exams have no place.
PLACES = """
places(exam_id, place) AS (VALUES ('Y1997', 0), ('Y1996', 1), ('Y1999', 2), ('Y1998', 3), ('Y1995', 4))"""


def persist(source: str, key: str, name: str = "pers") -> str:
    """Persistence by a key over the lexicographic exam order."""
    return f"""
firsts AS (SELECT min(exam_id) AS first_exam FROM {source}),
flags AS (
  SELECT {key}, student_id, bool_or(exam_id = first_exam) AS f, bool_or(exam_id > first_exam) AS l
  FROM {source}, firsts GROUP BY {key}, student_id
),
{name} AS (
  SELECT {key}, count(*) AS cohort_size, CAST(count(*) FILTER (WHERE l) AS BIGINT) AS repeated,
         CAST(count(*) FILTER (WHERE l) AS DOUBLE) / count(*) AS persistence_rate
  FROM flags WHERE f GROUP BY {key}
)"""


def recs(source: str, top_n: int) -> str:
    """Recommendations over a source with a concept column."""
    return f"""
rec_rows AS (SELECT * FROM {source} WHERE concept <> 'Unmapped' AND concept <> ''),
rec_stats AS (
  SELECT concept, count(DISTINCT student_id) AS students, sum(points_lost) AS points_lost_total,
         sum(points_lost) * greatest(count(DISTINCT student_id), 1) AS impact_score
  FROM rec_rows GROUP BY concept
),
rec_top AS (SELECT * FROM rec_stats ORDER BY impact_score DESC, concept LIMIT {top_n}),
{persist("rec_rows", "concept", "rec_pers")},
recs AS (
  SELECT concept, CASE WHEN coalesce(persistence_rate, 0) >= 0.2 THEN 'Re-teach' ELSE 'Add practice for' END AS action,
         impact_score, students, points_lost_total, coalesce(persistence_rate, 0.0::DOUBLE) AS persistence_rate
  FROM rec_top LEFT JOIN rec_pers USING (concept)
)"""


def histogram(source: str, value: str, bins: int, label: str) -> str:
    return f"""
vals AS (SELECT {value} AS v FROM {source} WHERE {value} IS NOT NULL),
span AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS step FROM vals),
grid AS (
  SELECT CAST(i AS INTEGER) AS bin_index, lo + i * step AS bin_lo,
         CASE WHEN i = {bins - 1} THEN hi + (hi - lo) * 0.001::DOUBLE ELSE lo + (i + 1) * step END AS bin_hi
  FROM span, range({bins}) r(i)
)
SELECT bin_index, {label} AS bin, bin_lo, bin_hi, count(v) AS count
FROM grid LEFT JOIN vals ON v >= bin_lo AND v < bin_hi
GROUP BY bin_index, bin_lo, bin_hi"""


def group_stats(column: str, label: str) -> str:
    return f"""
grp AS (
  SELECT CASE WHEN {column} = '' THEN '{label}' ELSE {column} END AS {column}, count(*) AS rows,
         count(DISTINCT student_id) AS students, sum(points_lost) AS total_points_lost,
         sum(points_lost) / count(DISTINCT student_id) AS avg_points_per_student,
         avg(points_lost) AS avg_points_per_row
  FROM v1 GROUP BY 1
)"""


BY_EXAM = """
by_exam AS (
  SELECT exam_id, count(DISTINCT student_id) AS students, count(DISTINCT question_id) AS questions,
         sum(points_lost) AS total_points_lost, avg(points_lost) AS avg_points_lost
  FROM v1 GROUP BY exam_id
)"""

PAIRS = """
inc AS (SELECT DISTINCT rubric_item, student_id FROM v1),
support AS (SELECT rubric_item, count(*) AS students FROM inc GROUP BY rubric_item HAVING count(*) >= 2),
common AS (
  SELECT a.rubric_item AS x, b.rubric_item AS y, count(*) AS n
  FROM inc a JOIN inc b ON a.student_id = b.student_id AND a.rubric_item < b.rubric_item
  GROUP BY 1, 2
),
pairs AS (
  SELECT a.rubric_item AS rubric_item_a, b.rubric_item AS rubric_item_b,
         CAST(coalesce(n, 0) AS DOUBLE) / (a.students + b.students - coalesce(n, 0)) AS jaccard,
         CAST(coalesce(n, 0) AS DOUBLE) / sqrt(CAST(a.students AS DOUBLE) * CAST(b.students AS DOUBLE)) AS corr,
         coalesce(n, 0) AS cooccurrence
  FROM support a JOIN support b ON a.rubric_item < b.rubric_item
  LEFT JOIN common ON x = a.rubric_item AND y = b.rubric_item
)"""

# The full risk frames, built the long way: students x exams x items.
RISK = V1B + """,
sit AS (
  SELECT student_id, exam_id, row_number() OVER (PARTITION BY student_id ORDER BY exam_id) - 1 AS seq,
         count(*) OVER (PARTITION BY student_id) - 1 AS last
  FROM (SELECT DISTINCT student_id, exam_id FROM vb)
),
cat AS (
  SELECT rubric_item, concept FROM (
    SELECT rubric_item, concept, row_number() OVER (PARTITION BY rubric_item ORDER BY count(*) DESC, concept) AS r
    FROM vb GROUP BY rubric_item, concept
  ) WHERE r = 1
),
shown AS (SELECT DISTINCT student_id, seq, rubric_item FROM vb JOIN sit USING (student_id, exam_id)),
pts AS (
  SELECT student_id, seq, concept, sum(points_lost) AS p FROM vb JOIN sit USING (student_id, exam_id)
  WHERE concept <> '' GROUP BY 1, 2, 3
),
grid AS (SELECT sit.*, cat.* FROM sit CROSS JOIN cat),
seen AS (
  SELECT g.student_id, g.seq, g.rubric_item, bool_or(s.seq < g.seq) AS before, bool_or(s.seq = g.seq) AS now
  FROM grid g JOIN shown s ON s.student_id = g.student_id AND s.rubric_item = g.rubric_item AND s.seq <= g.seq
  GROUP BY 1, 2, 3
),
prior AS (
  SELECT t.student_id, t.seq, p.concept, sum(p.p) AS p
  FROM sit t JOIN pts p ON p.student_id = t.student_id AND p.seq < t.seq GROUP BY 1, 2, 3
),
frame AS (
  SELECT g.student_id, g.exam_id, g.seq, g.last, g.rubric_item, g.concept,
         seen.student_id IS NOT NULL AS listed, prior.p IS NOT NULL AS known,
         CASE WHEN coalesce(before, false) THEN 1 ELSE 0 END AS prior_seen,
         coalesce(prior.p, 0.0::DOUBLE) AS prior_concept_points,
         CASE WHEN coalesce(now, false) THEN 1 ELSE 0 END AS label
  FROM grid g
  LEFT JOIN seen ON seen.student_id = g.student_id AND seen.seq = g.seq AND seen.rubric_item = g.rubric_item
  LEFT JOIN prior ON prior.student_id = g.student_id AND prior.seq = g.seq AND prior.concept = g.concept
)"""

# Rows of items not shown so far are counted, by concept where the student has points in it.
COMPACT = """
compact AS (
  SELECT student_id, exam_id, seq, last, CASE WHEN listed THEN rubric_item END AS rubric_item,
         CASE WHEN listed OR known THEN concept END AS concept, prior_seen, prior_concept_points, label, count(*) AS n_items
  FROM frame GROUP BY ALL
)"""

# Newton's method on the counted training rows, with a unit penalty on both slopes; the steps are solved by Cramer's rule.
NEWTON = """
w AS (
  SELECT prior_seen::DOUBLE AS s, prior_concept_points AS p, label::DOUBLE AS y, count(*)::DOUBLE AS n
  FROM frame WHERE seq > 0 GROUP BY ALL
),
newton(i, b0, b1, b2) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1,
         b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
         b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
         b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (
    SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
    FROM (
      SELECT i, b0, b1, b2, sum(n * (q - y)) AS g0, sum(n * (q - y) * s) + b1 AS g1, sum(n * (q - y) * p) + b2 AS g2,
             sum(n * q * (1 - q)) AS h00, sum(n * q * (1 - q) * s) AS h01, sum(n * q * (1 - q) * p) AS h02,
             sum(n * q * (1 - q) * s * s) + 1 AS h11, sum(n * q * (1 - q) * s * p) AS h12,
             sum(n * q * (1 - q) * p * p) + 1 AS h22
      FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * s + b2 * p))) AS q FROM newton, w WHERE i < 20)
      GROUP BY i, b0, b1, b2
    )
  )
),
fitted AS (SELECT b0, b1, b2 FROM newton ORDER BY i DESC LIMIT 1)"""
LEVEL = "CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS confidence"
CHANCE = "1 / (1 + exp(-(b0 + b1 * prior_seen + b2 * prior_concept_points))) AS c"

STEPS = V1 + """,
sit AS (
  SELECT student_id, exam_id, row_number() OVER (PARTITION BY student_id ORDER BY exam_id) - 1 AS seq,
         count(*) OVER (PARTITION BY student_id) - 1 AS last
  FROM (SELECT DISTINCT student_id, exam_id FROM v1)
),
has AS (SELECT DISTINCT student_id, seq, last, rubric_item FROM v1 JOIN sit USING (student_id, exam_id))"""


def oracle_sql() -> dict[str, str]:
    top_errors = f"WITH {V1}, {ERRORS} SELECT * FROM errors ORDER BY points_lost_total DESC, rubric_item LIMIT "
    v1_persist = f"WITH {V1}, {persist('v1', 'rubric_item')} SELECT * FROM pers"
    v1c_persist = f"WITH {V1C}, {persist('v1c', 'rubric_item')}"
    event_rows = """WITH """ + V2 + """
        SELECT student_id, exam_id, question_id, replace(rubric_item, ':', ': ') AS rubric_item, points_lost,
               topic, section_id, ta_id FROM v2"""
    parts = " UNION ALL ".join(
        f"""SELECT '{part}' AS part, {key} AS item, count(*) AS rows, count(DISTINCT student_id) AS students,
            sum(points_lost) AS total, avg(points_lost) AS mean FROM v1c{group}"""
        for part, key, group in [
            ("all", "''", ""),
            *((k, k, f" GROUP BY {k}") for k in ("exam_id", "rubric_item", "section_id", "concept")),
        ]
    )
    bb1 = "printf('%.1f', bin_lo) || '-' || printf('%.1f', bin_hi)"
    kpi = """
        SELECT (SELECT count(*) FROM v1) AS rows, (SELECT count(DISTINCT student_id) FROM v1) AS students,
               (SELECT avg(t) FROM per) AS avg_points_per_student,
               (SELECT round(stddev_pop(t), 6) FROM per) AS std_points_per_student,
               (SELECT count(DISTINCT exam_id) FROM v1) AS exams,
               (SELECT count(DISTINCT rubric_item) FROM scoped) AS rubric_items,
               (SELECT avg(points_lost) FROM v1) AS avg_points_lost,
               (SELECT sum(t) FROM per) AS total_points_lost"""
    return {
        "csv_round_trip": f"WITH {V1} SELECT * FROM v1",
        "csv_line_breaks": f"""WITH {V1}
            SELECT * REPLACE (replace('"' || topic || '",', ' ', chr(10)) AS topic,
                              'a,' || section_id || chr(13) || chr(10) || '""b' AS section_id) FROM v1""",
        "normalize_csv": event_rows,
        "concept_map_load": f"WITH {CMAP} SELECT * FROM cmap",
        "concept_map_save": f"WITH {CMAP} SELECT * FROM cmap",
        "concept_map_save_object": f"WITH {CMAP} SELECT * FROM cmap",
        "packet_manifest": f"""WITH {V1C}
            SELECT 'top_concepts' AS artifact, 'top_concepts.csv' AS file,
                   least(5, count(DISTINCT concept)) AS rows FROM v1c
            UNION ALL SELECT 'persistent_concepts', 'persistent_concepts.csv',
                   least(5, count(DISTINCT rubric_item)) FROM v1 WHERE exam_id = (SELECT min(exam_id) FROM v1)
            UNION ALL SELECT 'exam_changes', 'exam_changes.csv', count(DISTINCT exam_id) FROM v1
            UNION ALL SELECT 'rubric/errors', 'rubric_errors.csv', count(DISTINCT rubric_item) FROM v1""",
        "safe_name": """WITH raw AS (
              SELECT page_id, page_id % 10 = 0 AS rejected,
                     CASE WHEN page_id % 10 = 1 THEN '...' || url || '..zip' ELSE url END AS u
              FROM pages),
            joined AS (
              SELECT page_id, rejected,
                     array_to_string(list_filter(string_split(u, '/'), lambda p: p <> '' AND p <> '.'), '_') AS j
              FROM raw)
            SELECT page_id,
                   CASE WHEN NOT rejected THEN coalesce(nullif(regexp_replace(regexp_replace(
                     regexp_replace(j, '[^A-Za-z0-9._-]+', '_', 'g'), '\\.{2,}', '.', 'g'), '^\\.+', ''), ''), 'export')
                   END AS name, rejected
            FROM joined""",
        "apply_mapping": event_rows,
        "canonicalize": f"WITH {V1} SELECT * REPLACE ('' AS ta_id) FROM v1",
        "score_apply_mapping": f"WITH {V3} SELECT * FROM v3",
        "score_sanitize": f"WITH {V3} SELECT * FROM v3 WHERE comment <> 'A'",
        "student_scope": f"""WITH {V1} SELECT * FROM v1
            WHERE student_id IN (SELECT student_id FROM v1 WHERE section_id = 'BUILDING')""",
        "rubric_drilldown": f"WITH {V1} SELECT * FROM v1 WHERE rubric_item = 'Brand#16 LARGE'",
        "small_cohort_gate": f"""WITH {V1}, {ERRORS} SELECT * FROM errors
            WHERE (SELECT count(DISTINCT student_id) FROM v1) >= 5""",
        "rubric_search": f"WITH {V1} SELECT DISTINCT rubric_item FROM v1 WHERE lower(rubric_item) LIKE '%#1 lar%'",
        "preview": f"WITH {V1} SELECT * FROM v1 ORDER BY ALL LIMIT 200",
        "anonymize": f"""WITH {V1},
            ids AS (SELECT student_id, row_number() OVER (ORDER BY student_id) AS n
                    FROM (SELECT DISTINCT student_id FROM v1))
            SELECT v1.* REPLACE (printf('Student %03d', n) AS student_id) FROM v1 JOIN ids USING (student_id)""",
        "anonymize_nulls": f"""WITH {V1},
            vn AS (SELECT * REPLACE (CASE WHEN question_id <> 'L3' THEN student_id ELSE '' END AS student_id) FROM v1),
            ids AS (SELECT student_id, row_number() OVER (ORDER BY student_id) AS n
                    FROM (SELECT DISTINCT student_id FROM vn))
            SELECT vn.* REPLACE (printf('Student %03d', n) AS student_id) FROM vn JOIN ids USING (student_id)""",
        "invariants": f"""WITH {V1},
            c AS (SELECT count(*) FILTER (WHERE ta_id LIKE '%7') AS m, count(*) FILTER (WHERE question_id = 'L3') AS x,
                         count(*) FILTER (WHERE question_id = 'L4') AS g FROM v1)
            SELECT 'required_columns' AS name, true AS ok, 'all present' AS detail
            UNION ALL SELECT 'missing_identifiers', m = 0, CAST(m AS VARCHAR) FROM c
            UNION ALL SELECT 'non_numeric_points_lost', x = 0, CAST(x AS VARCHAR) FROM c
            UNION ALL SELECT 'negative_points_lost', g = 0, CAST(g AS VARCHAR) FROM c""",
        "score_validate": f"""WITH {V3}
            SELECT 1 AS check_no, 'Missing required column: student_name' AS message
            UNION ALL SELECT 2, 'No numeric scores detected after mapping' FROM v3 HAVING count(*) > 0""",
        "overall_summary": f"""WITH {V1}
            SELECT count(*) AS rows, count(DISTINCT student_id) AS students, count(DISTINCT exam_id) AS exams,
                   count(DISTINCT question_id) AS questions, avg(points_lost) AS avg_points_lost FROM v1""",
        "rubric_item_stats": f"""WITH {V1}
            SELECT rubric_item, topic, count(*) AS count, avg(points_lost) AS avg_points_lost,
                   median(points_lost) AS median_points_lost, round(stddev_pop(points_lost), 6) AS std_points_lost,
                   sum(points_lost) AS total_points_lost
            FROM v1 GROUP BY rubric_item, topic""",
        "rubric_item_stats_nulls": f"""WITH {V1}
            SELECT rubric_item, CASE WHEN question_id <> 'L3' THEN topic ELSE '' END AS topic, count(*) AS count,
                   avg(points_lost) AS avg_points_lost, median(points_lost) AS median_points_lost,
                   round(stddev_pop(points_lost), 6) AS std_points_lost, sum(points_lost) AS total_points_lost
            FROM v1 GROUP BY 1, 2""",
        "exam_breakdown": f"WITH {V1}, {BY_EXAM} SELECT * FROM by_exam",
        "student_summary": f"""WITH {V1}
            SELECT student_id, exam_id, sum(points_lost) AS total_points_lost, count(DISTINCT question_id) AS questions
            FROM v1 GROUP BY student_id, exam_id""",
        "score_distribution": f"WITH {V1}, {histogram('v1', 'points_lost', 10, bb1)}",
        "event_score_distribution": f"WITH {V2}, {histogram('v2', 'points_lost', 25, bb1)}",
        "summarize_errors": f"WITH {V1}, {ERRORS} SELECT * FROM errors",
        "error_by_exam": f"""WITH {V1}
            SELECT exam_id, rubric_item, count(*) AS count_rows, sum(points_lost) AS points_lost_total
            FROM v1 GROUP BY exam_id, rubric_item""",
        "rubric_exam_pivot": f"WITH {V1} SELECT rubric_item, "
        + ", ".join(f"count(*) FILTER (WHERE exam_id = 'Y{y}') AS \"Y{y}\"" for y in range(1995, 2002))
        + " FROM v1 GROUP BY rubric_item",
        "rubric_exam_map": f"""WITH {V1}, cells AS (SELECT rubric_item, exam_id, count(*) AS n FROM v1 GROUP BY ALL)
            SELECT rubric_item, '{{' || string_agg('"' || exam_id || '":' || n, ',' ORDER BY exam_id) || '}}' AS rows_by_exam
            FROM cells GROUP BY rubric_item""",
        "rollup_summaries": f"WITH {V1C} {parts}",
        "rollup_exam_breakdown": f"WITH {V1}, {BY_EXAM} SELECT * FROM by_exam",
        "rollup_kpis": f"""WITH {V1}, scoped AS (SELECT * FROM v1),
            per AS (SELECT student_id, sum(points_lost) AS t FROM scoped GROUP BY 1) {kpi}""",
        "rollup_packet": f"""WITH {V1C}
            SELECT 'exam_breakdown' AS artifact, 'exam_breakdown.csv' AS file, count(DISTINCT exam_id) AS rows FROM v1c
            UNION ALL SELECT 'summarize_errors', 'summarize_errors.csv', count(DISTINCT rubric_item) FROM v1c
            UNION ALL SELECT 'concept_stats', 'concept_stats.csv', count(DISTINCT concept) FROM v1c WHERE trim(concept) <> ''
            UNION ALL SELECT 'section_id_comparison', 'section_id_comparison.csv', count(DISTINCT section_id) FROM v1c""",
        "section_comparison": f"WITH {V1}, {group_stats('section_id', 'Unassigned')} SELECT * FROM grp",
        "ta_comparison": f"WITH {V1}, {group_stats('ta_id', 'Unassigned')} SELECT * FROM grp",
        "persistence": v1_persist,
        "persistence_manual_order": f"""WITH {V1}, {PLACES},
            placed AS (SELECT v1.*, place FROM v1 JOIN places USING (exam_id)),
            firsts AS (SELECT min(place) AS fp FROM placed),
            flags AS (SELECT rubric_item, student_id, bool_or(place = fp) AS f, bool_or(place > fp) AS l
                      FROM placed, firsts GROUP BY 1, 2)
            SELECT rubric_item, count(*) AS cohort_size, count(*) FILTER (WHERE l) AS repeated,
                   CAST(count(*) FILTER (WHERE l) AS DOUBLE) / count(*) AS persistence_rate
            FROM flags WHERE f GROUP BY rubric_item""",
        "course_group_stats": f"""WITH {V1}, {group_stats('section_id', 'Unassigned section')}
            SELECT * REPLACE (round_even(total_points_lost, 2) AS total_points_lost,
                              round_even(avg_points_per_student, 2) AS avg_points_per_student,
                              round_even(avg_points_per_row, 2) AS avg_points_per_row) FROM grp""",
        "disparity_gap": f"""WITH {V1}, {group_stats('ta_id', 'Unassigned TA')}
            SELECT max(round_even(avg_points_per_student, 2)) - min(round_even(avg_points_per_student, 2)) AS gap
            FROM grp""",
        "kpis": f"""WITH {V1}, scoped AS (SELECT * FROM v1),
            per AS (SELECT student_id, sum(points_lost) AS t FROM scoped GROUP BY 1) {kpi}""",
        "kpis_drilldown": f"""WITH {V1}, scoped AS (SELECT * FROM v1 WHERE rubric_item = 'Brand#16 LARGE'),
            per AS (SELECT student_id, sum(points_lost) AS t FROM scoped GROUP BY 1) {kpi}""",
        "score_rubric_stats": f"""WITH {V3}
            SELECT rubric_item, category, count(*) AS count, avg(score) AS avg_score, median(score) AS median_score,
                   round(stddev_pop(score), 6) AS std_score, max(max_score) AS max_score_value,
                   CAST(count(*) FILTER (WHERE score >= max_score) AS DOUBLE) / nullif(count(max_score), 0) * 100
                     AS full_points_pct
            FROM v3 GROUP BY rubric_item, category""",
        "score_rubric_stats_nulls": f"""WITH {V3}
            SELECT CASE WHEN comment <> 'A' THEN rubric_item END AS rubric_item, category, count(*) AS count,
                   avg(score) AS avg_score, median(score) AS median_score,
                   round(stddev_pop(score), 6) AS std_score, max(max_score) AS max_score_value,
                   CAST(count(*) FILTER (WHERE score >= max_score) AS DOUBLE) / nullif(count(max_score), 0) * 100
                     AS full_points_pct
            FROM v3 GROUP BY 1, 2""",
        "score_category_breakdown": f"""WITH {V3}
            SELECT category, count(DISTINCT rubric_item) AS items, count(DISTINCT student_id) AS submissions,
                   coalesce(sum(score), 0) AS score_sum, coalesce(sum(max_score), 0) AS max_sum,
                   CASE WHEN sum(max_score) > 0 THEN coalesce(sum(score), 0) / sum(max_score) * 100 END AS pct_of_total
            FROM v3 GROUP BY category""",
        "score_student_summary": f"""WITH {V3}
            SELECT student_id, student_name, assignment, coalesce(sum(score), 0) AS score_sum,
                   coalesce(sum(max_score), 0) AS max_sum,
                   CASE WHEN sum(max_score) > 0 THEN coalesce(sum(score), 0) / sum(max_score) * 100 END AS percent
            FROM v3 GROUP BY ALL""",
        "score_distribution_pct": f"""WITH {V3},
            ratio AS (SELECT greatest(least(score / nullif(max_score, 0), 1.0::DOUBLE), 0.0::DOUBLE) * 100 AS r FROM v3
                      WHERE score IS NOT NULL AND max_score IS NOT NULL),
            {histogram('ratio', 'r', 10, "CAST(trunc(bin_lo) AS BIGINT) || '-' || CAST(trunc(bin_hi) AS BIGINT)")}""",
        "item_concept_mode": f"WITH {RISK} SELECT rubric_item, concept FROM cat",
        "exam_changes": f"""WITH {V1}, {BY_EXAM}, {PLACES}
            SELECT b.*, total_points_lost - lag(total_points_lost) OVER w AS delta_vs_prev,
                   total_points_lost / lag(total_points_lost) OVER w - 1 AS pct_change_vs_prev
            FROM by_exam b LEFT JOIN places USING (exam_id)
            WINDOW w AS (ORDER BY place NULLS LAST, exam_id)""",
        "exam_change_table": f"""WITH {V1}, {BY_EXAM}
            SELECT *, coalesce(round_even(total_points_lost - lag(total_points_lost) OVER w, 2), 0) AS delta_vs_prev,
                   coalesce(round_even(total_points_lost / lag(total_points_lost) OVER w - 1, 3), 0) AS pct_change_vs_prev
            FROM by_exam WINDOW w AS (ORDER BY exam_id)""",
        "exam_order": f"""WITH {V1}
            SELECT exam_id, CAST(row_number() OVER (ORDER BY exam_id) - 1 AS INTEGER) AS exam_rank
            FROM (SELECT DISTINCT exam_id FROM v1)""",
        "top_issues": top_errors + "20",
        "top_rubric_items": top_errors + "10",
        "high_persistence": v1_persist + " WHERE cohort_size >= 3 ORDER BY persistence_rate DESC, rubric_item LIMIT 3",
        "high_points": top_errors + "3",
        "suggested_topics": f"""WITH {V1C} SELECT concept, sum(points_lost) AS points_lost FROM v1c
            GROUP BY concept ORDER BY points_lost DESC, concept LIMIT 3""",
        "top_concepts": f"""WITH {V1C}, {CONCEPT_STATS}
            SELECT *, points_lost_total * greatest(students_affected, 1) AS impact_score FROM cstats
            ORDER BY impact_score DESC, concept LIMIT 5""",
        "top_persistent": v1_persist + " ORDER BY persistence_rate DESC, cohort_size DESC, rubric_item LIMIT 5",
        "top_pairs": f"""WITH {V1}, {PAIRS},
            top AS (SELECT * FROM pairs ORDER BY jaccard DESC, rubric_item_a, rubric_item_b LIMIT 20)
            SELECT * REPLACE (round_even(jaccard, 3) AS jaccard, round_even(corr, 3) AS corr) FROM top""",
        "report_lines": f"""WITH {V1C}, {ERRORS}, {recs('v1c', 5)}, {persist('v1c', 'rubric_item').replace('firsts', 'f2').replace('flags', 'fl2')},
            e8 AS (SELECT *, row_number() OVER (ORDER BY points_lost_total DESC, rubric_item) AS r FROM errors),
            p6 AS (SELECT *, row_number() OVER (ORDER BY rubric_item) AS r FROM pers),
            r6 AS (SELECT *, row_number() OVER (ORDER BY impact_score DESC, concept) AS r FROM recs)
            SELECT 'Top issues' AS section, CAST(r AS INTEGER) AS line_no,
                   printf('- %s | rows %d | students %d | pts %.1f', rubric_item, count_rows, students_affected,
                          points_lost_total) AS line FROM e8 WHERE r <= 8
            UNION ALL SELECT 'Persistence', CAST(r AS INTEGER), printf('- %s: cohort %d, repeated %d, rate %.1f%%',
                   rubric_item, cohort_size, repeated, persistence_rate * 100) FROM p6 WHERE r <= 6
            UNION ALL SELECT 'Recommendations', CAST(r AS INTEGER), printf('- %s %s (impact %.1f, students %d, pts %.1f)',
                   action, concept, impact_score, students, points_lost_total) FROM r6 WHERE r <= 6""",
        "drilldown_candidates": f"""WITH {V1}, {ERRORS}
            SELECT rubric_item, count_rows, rubric_item || ' (' || count_rows || ' rows)' AS label
            FROM errors ORDER BY rubric_item LIMIT 9""",
        "concept_map_clean": f"WITH {CMAP} SELECT rubric_item, concept, valid FROM cleaned",
        "apply_concept": f"WITH {MAPPED} SELECT * FROM mapped",
        "concept_coverage": f"""WITH {MAPPED} SELECT count(*) FILTER (WHERE concept <> 'Unmapped') AS mapped,
            count(*) FILTER (WHERE concept = 'Unmapped') AS unmapped FROM mapped""",
        "allowed_concepts": f"WITH {MAPPED} SELECT DISTINCT concept FROM mapped WHERE concept <> 'Unmapped'",
        "concept_map_upsert": f"""WITH {CMAP},
            edited AS (
              SELECT i.rubric_item, CASE WHEN i.rubric_item LIKE '%7' THEN 'Edited'
                                         WHEN c.concept IS NULL THEN 'Added' END AS new, c.concept AS old
              FROM items i LEFT JOIN cmap c USING (rubric_item))
            SELECT rubric_item, coalesce(new, old) AS concept FROM edited""",
        "topic_present": f"WITH {V1} SELECT bool_or(topic <> '') AS topic_present FROM v1",
        "concept_stats": f"WITH {V1C}, {CONCEPT_STATS} SELECT * FROM cstats",
        "concept_persistence": f"""WITH {V1}, vr AS (SELECT *, rubric_item AS concept FROM v1),
            {persist('vr', 'concept')} SELECT * FROM pers""",
        "recommendations": f"""WITH {V1}, vr AS (SELECT *, rubric_item AS concept FROM v1),
            {recs('vr', 500)} SELECT * FROM recs""",
        "recommendations_allowed": f"""WITH {V1}, vr AS (SELECT *, rubric_item AS concept FROM v1),
            {recs('vr', 100000)} SELECT * FROM recs
            WHERE concept IN ('Brand#16 LARGE', 'Brand#11 SMALL', 'Brand#22 ECONOMY', 'Brand#3 PROMO', 'Brand#4 STANDARD',
                              'Brand#25 MEDIUM', 'Unmapped')""",
        "recommendations_unmapped_manual": f"""WITH {V1C}, {PLACES},
            placed AS (SELECT v1c.*, place FROM v1c JOIN places USING (exam_id)),
            firsts AS (SELECT min(place) AS fp FROM placed),
            flags AS (SELECT concept, student_id, bool_or(place = fp) AS f, bool_or(place > fp) AS l
                      FROM placed, firsts GROUP BY 1, 2),
            pers AS (SELECT concept, CAST(count(*) FILTER (WHERE l) AS DOUBLE) / count(*) AS rate
                     FROM flags WHERE f GROUP BY concept),
            stats AS (SELECT concept, count(DISTINCT student_id) AS students, sum(points_lost) AS points_lost_total
                      FROM v1c GROUP BY concept)
            SELECT concept, CASE WHEN coalesce(rate, 0) >= 0.2 THEN 'Re-teach' ELSE 'Add practice for' END AS action,
                   points_lost_total * greatest(students, 1) AS impact_score, students, points_lost_total,
                   coalesce(rate, 0.0::DOUBLE) AS persistence_rate
            FROM stats LEFT JOIN pers USING (concept)""",
        "recommendations_default": f"WITH {V1C}, {recs('v1c', 5)} SELECT * FROM recs",
        "lesson_plan": v1c_persist + f""", {CONCEPT_STATS},
            c1 AS (SELECT *, points_lost_total * greatest(students_affected, 1) AS impact_score FROM cstats
                   ORDER BY impact_score DESC, concept LIMIT 1),
            p1 AS (SELECT * FROM pers ORDER BY persistence_rate DESC, cohort_size DESC, rubric_item LIMIT 1)
            SELECT 1 AS line_no, printf('Prioritize reteaching **%s**; it has the highest impact score (%.1f).',
                   concept, impact_score) AS line FROM c1
            UNION ALL SELECT 2, printf('Address recurring concept **%s**; repeat rate %.0f%% across %d students.',
                   rubric_item, persistence_rate * 100, cohort_size) FROM p1
            UNION ALL SELECT 3, 'Add 10-minute targeted practice on top two concepts, then quick formative check.'
            UNION ALL SELECT 4, 'Share anonymized exemplars for the highest-impact misconception to speed feedback loops.'""",
        "item_support": f"""WITH {V1}, {PAIRS} SELECT rubric_item, students FROM support
            WHERE (SELECT count(*) FROM support) >= 2""",
        "pair_similarity": f"WITH {V1}, {PAIRS} SELECT * FROM pairs WHERE cooccurrence > 0",
        "similarity_edges": f"WITH {V1}, {PAIRS} SELECT * FROM pairs WHERE jaccard >= 0.2 OR corr >= 0.3",
        "misconception_clusters": f"""WITH RECURSIVE {V1}, {PAIRS},
            near AS (SELECT rubric_item_a AS a, rubric_item_b AS b FROM pairs WHERE jaccard >= 0.25
                     UNION ALL SELECT rubric_item_b, rubric_item_a FROM pairs WHERE jaccard >= 0.25),
            reach(item, root) AS (
              SELECT rubric_item, rubric_item FROM support
              UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.item),
            comp AS (SELECT item, min(root) AS root FROM reach GROUP BY item),
            sup AS (SELECT root, count(DISTINCT student_id) AS support_students, count(DISTINCT item) AS size
                    FROM comp JOIN inc ON inc.rubric_item = comp.item GROUP BY root),
            num AS (SELECT *, row_number() OVER (ORDER BY root) AS n FROM sup)
            SELECT 'Misconception ' || n AS label, item AS rubric_item, size, support_students
            FROM comp JOIN num USING (root)""",
        "risk_train": f"WITH {RISK}, {COMPACT} SELECT * EXCLUDE (seq, last) FROM compact WHERE seq > 0",
        "risk_score_frame": f"""WITH {RISK}, {COMPACT.replace('label, ', '')} SELECT * EXCLUDE (seq, last) FROM compact
            WHERE seq = last""",
        "risk_coefficients": f"""WITH RECURSIVE {RISK}, {NEWTON}
            SELECT 'prior_seen' AS feature, round(b1, 6) AS coefficient FROM fitted
            UNION ALL SELECT 'prior_concept_points', round(b2, 6) FROM fitted""",
        "risk_scores": f"""WITH RECURSIVE {RISK}, {COMPACT.replace('label, ', '')}, {NEWTON}
            SELECT * EXCLUDE (seq, last, c), round(c, 6) AS probability, {LEVEL}
            FROM (SELECT compact.*, {CHANCE} FROM compact, fitted WHERE seq = last)""",
        "top_risks": f"""WITH RECURSIVE {RISK}, {NEWTON}
            SELECT student_id, rubric_item, prior_seen, prior_concept_points, round_even(c, 3) AS probability, {LEVEL}
            FROM (SELECT frame.*, {CHANCE} FROM frame, fitted WHERE seq = last)
            ORDER BY probability DESC, student_id, rubric_item LIMIT 50""",
        "risk_train_weights": f"""WITH {RISK} SELECT prior_seen, prior_concept_points, label, count(*) AS n_rows
            FROM frame WHERE seq > 0 GROUP BY ALL""",
        "transitions": f"""WITH {STEPS},
            occ AS (SELECT rubric_item AS source, count(*) AS o FROM has WHERE seq < last GROUP BY 1),
            t AS (SELECT a.rubric_item AS source, b.rubric_item AS target, count(*) AS count
                  FROM has a JOIN has b ON a.student_id = b.student_id AND b.seq = a.seq + 1 GROUP BY 1, 2)
            SELECT source, target, count, CAST(count AS DOUBLE) / o AS conditional_prob FROM t JOIN occ USING (source)""",
        "top_transitions": f"""WITH {STEPS},
            occ AS (SELECT rubric_item AS source, count(*) AS o FROM has WHERE seq < last GROUP BY 1),
            t AS (SELECT a.rubric_item AS source, b.rubric_item AS target, count(*) AS count
                  FROM has a JOIN has b ON a.student_id = b.student_id AND b.seq = a.seq + 1 GROUP BY 1, 2),
            top AS (SELECT source, target, count, CAST(count AS DOUBLE) / o AS cp FROM t JOIN occ USING (source)
                    ORDER BY count DESC, cp DESC, source, target LIMIT 20)
            SELECT source, target, count, round_even(cp, 3) AS conditional_prob FROM top""",
        "trajectory": f"""WITH {STEPS},
            s AS (SELECT h.rubric_item, h.seq < h.last AS followed, n.seq IS NOT NULL AS repeated,
                         h.seq > 0 AND p.seq IS NULL AS emerged
                  FROM has h
                  LEFT JOIN has n ON n.student_id = h.student_id AND n.rubric_item = h.rubric_item AND n.seq = h.seq + 1
                  LEFT JOIN has p ON p.student_id = h.student_id AND p.rubric_item = h.rubric_item AND p.seq = h.seq - 1),
            c AS (SELECT rubric_item, count(*) FILTER (WHERE followed) AS followed,
                         count(*) FILTER (WHERE repeated) AS repeated, count(*) FILTER (WHERE emerged) AS emerged
                  FROM s GROUP BY 1)
            SELECT rubric_item, followed, repeated, followed - repeated AS dropped, emerged,
                   CAST(repeated AS DOUBLE) / nullif(followed, 0) AS persistence_share,
                   CAST(followed - repeated AS DOUBLE) / nullif(followed, 0) AS drop_off_share FROM c""",
    }
