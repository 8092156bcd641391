"""Reference SQL of every report over the star schema, for a single-node SQL engine.

``VIEWS`` are the eight tables; each report's SQL names the views it uses.
"""

from __future__ import annotations

import re



def _u(step: int) -> str:
    """A number between 0 and 1 for each student, start and draw."""
    key = f"student_id || '|' || (42 + start) || '|{step}'"
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


def _round(name: str, limit: float) -> str:
    """One round of k-means for every start whose centres moved by more than ``limit``."""
    means = ", ".join(f"avg(z[{i}])" for i in range(1, 6))
    return f"""SELECT start, i + 1, list_transform(range(1, 5), lambda j: coalesce(m[j], c[j])),
        list_sum(list_transform(range(1, 5), lambda j: coalesce(list_distance(m[j], c[j]) ** 2, 0::DOUBLE))), cost
        FROM (SELECT start, i, any_value(c) AS c, sum(q) AS cost, map(list(k), list(mean)) AS m FROM (
            SELECT start, i, any_value(c) AS c, k, sum(d * d) AS q, [{means}] AS mean FROM (
                SELECT start, i, c, z, list_position(ds, list_min(ds)) AS k, list_min(ds) AS d FROM (
                    SELECT start, i, c, z, list_transform(c, lambda x: list_distance(x, z)) AS ds
                    FROM {name}, zf WHERE moved > {limit} AND i < 300))
            GROUP BY start, i, k) GROUP BY start, i)"""


VIEWS: dict[str, str] = {
    "courses": "SELECT r_regionkey AS course_id, r_name AS course_name FROM region",
    "groups": """SELECT n_nationkey AS group_id, n_name AS group_name, n_regionkey AS course_id,
        50 + 4 * n_nationkey AS stated_num_students, 'I' || (n_nationkey % 4) AS instructor
        FROM nation""",
    "students": """SELECT c_custkey AS student_id, c_name AS full_name,
        CAST(17 + c_custkey % 20 AS DOUBLE) AS age, c_mktsegment AS city,
        c_nationkey AS group_id, g.course_id, g.instructor, g.group_name, c.course_name
        FROM customer LEFT JOIN groups g ON c_nationkey = g.group_id
        LEFT JOIN courses c ON g.course_id = c.course_id""",
    "owners": """SELECT o_orderkey AS assessment_id, o_custkey AS student_id, o_orderdate,
        o_totalprice, o_orderpriority, s.group_id, s.course_id
        FROM orders LEFT JOIN students s ON o_custkey = s.student_id""",
    "grades": """SELECT assessment_id, student_id, group_id, course_id, o_orderpriority AS type,
        o_totalprice / 5003 + CASE WHEN assessment_id % 500 = 0 THEN 200.0::DOUBLE ELSE 0.0::DOUBLE END
        AS score, o_orderdate AS date FROM owners""",
    "attendance": """SELECT student_id, group_id,
        CASE WHEN l_returnflag = 'R' THEN 'absent' ELSE 'attended' END AS status,
        l_shipdate AS session_datetime
        FROM lineitem LEFT JOIN owners ON l_orderkey = assessment_id""",
    "concepts": """SELECT student_id, course_id, p_brand AS concept_name,
        CASE WHEN l_quantity < 20 THEN 'failed' WHEN l_quantity < 45 THEN 'passed'
             ELSE 'in_progress' END AS mastery_status,
        2 * l_quantity AS score_pct, l_shipdate AS "timestamp"
        FROM lineitem LEFT JOIN owners ON l_orderkey = assessment_id
        LEFT JOIN part ON l_partkey = p_partkey""",
    "engagement": """SELECT user_id AS student_id,
        CASE event_type WHEN 'click' THEN 'login' WHEN 'view' THEN 'video_watch'
             WHEN 'purchase' THEN 'resource_download' WHEN 'signup' THEN 'forum_post'
             ELSE event_type END AS event_type,
        ts AS event_datetime,
        CASE WHEN value * 30 BETWEEN 0 AND 7200 THEN value * 30 END AS duration_seconds
        FROM events""",
    "submissions": """SELECT l_orderkey AS assessment_id, student_id, o_orderdate AS deadline,
        o_orderdate + to_hours(CAST((l_partkey * 7 + l_linenumber) % 601 - 300 AS BIGINT))
            AS submitted_at,
        (l_partkey * 7 + l_linenumber) % 601 - 300 > 0 AS is_late
        FROM lineitem LEFT JOIN owners ON l_orderkey = assessment_id""",
    # Shared steps.
    "att": """SELECT student_id, avg(CASE WHEN status = 'attended' THEN 1.0::DOUBLE
        ELSE 0.0::DOUBLE END) * 100 AS att_rate
        FROM attendance WHERE student_id IS NOT NULL GROUP BY student_id""",
    "grd": """SELECT student_id, avg(score) AS avg_grade FROM grades
        WHERE student_id IS NOT NULL GROUP BY student_id""",
    "lgn": """SELECT student_id, count(*) AS logins FROM engagement
        WHERE event_type = 'login' AND student_id IS NOT NULL GROUP BY student_id""",
    "vid": """SELECT student_id, coalesce(sum(duration_seconds), 0) AS video_sec FROM engagement
        WHERE event_type = 'video_watch' AND student_id IS NOT NULL GROUP BY student_id""",
    "fld": """SELECT student_id, count(*) AS failed_c FROM concepts
        WHERE mastery_status = 'failed' AND student_id IS NOT NULL GROUP BY student_id""",
    "feat": """SELECT student_id, coalesce(att_rate, 0) AS att_rate,
        coalesce(avg_grade, 0) AS avg_grade, coalesce(logins, 0) AS logins,
        coalesce(video_sec, 0) AS video_sec, coalesce(failed_c, 0) AS failed_c
        FROM att FULL JOIN grd USING (student_id) FULL JOIN lgn USING (student_id)
        FULL JOIN vid USING (student_id) FULL JOIN fld USING (student_id)""",
    "risk": """SELECT student_id, group_name, course_name, att_rate, avg_grade,
        coalesce(att_rate, 0) < 60 OR coalesce(avg_grade, 0) < 55 AS is_at_risk
        FROM students LEFT JOIN att USING (student_id) LEFT JOIN grd USING (student_id)""",
    "cstats": """SELECT course_name, avg(score) AS m, stddev_samp(score) AS s FROM cscore
        GROUP BY course_name""",
    "cfail": """SELECT concept_name, avg(CASE WHEN mastery_status = 'failed' THEN 1.0::DOUBLE
        ELSE 0.0::DOUBLE END) * 100 AS fail_rate
        FROM concepts WHERE concept_name IS NOT NULL GROUP BY concept_name""",
    "grate": """SELECT a.group_id, att_rate, group_name, g.course_id, course_name FROM (
            SELECT group_id, avg(CASE WHEN status = 'attended' THEN 1.0::DOUBLE
                ELSE 0.0::DOUBLE END) * 100 AS att_rate
            FROM attendance WHERE group_id IS NOT NULL GROUP BY group_id) a
        LEFT JOIN groups g ON a.group_id = g.group_id
        LEFT JOIN courses c ON g.course_id = c.course_id""",
    "sizes": """SELECT g.*, coalesce(true_count, 0) AS true_count FROM groups g LEFT JOIN (
            SELECT group_id, count(*) AS true_count FROM students
            WHERE group_id IS NOT NULL GROUP BY group_id) USING (group_id)""",
    "cscore": """SELECT course_name, score FROM grades LEFT JOIN courses USING (course_id)
        WHERE course_name IS NOT NULL""",
    "pairs4": """SELECT student_id, att_rate, avg_grade FROM att JOIN grd USING (student_id)""",
    "quart": """SELECT student_id, att_rate, avg_grade, greatest(1,
            CASE WHEN n > 1 THEN (4 * (r - 1) + n - 2) // (n - 1) ELSE 1 END)::INTEGER AS band_ord
        FROM (SELECT *, row_number() OVER (ORDER BY att_rate, student_id) AS r,
                count(*) OVER () AS n FROM pairs4)""",
    "quartl": """SELECT *, ['Q1 Low', 'Q2', 'Q3', 'Q4 High'][band_ord] AS band FROM quart""",
    "engaged": """SELECT student_id, avg_grade, coalesce(logins, 0) AS logins,
        coalesce(video_sec / 3600, 0) AS video_hrs
        FROM grd LEFT JOIN lgn USING (student_id) LEFT JOIN vid USING (student_id)""",
    "ccrate": """SELECT concept_name, course_id, avg(CASE WHEN mastery_status = 'failed'
        THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS fail_rate
        FROM concepts WHERE concept_name IS NOT NULL AND course_id IS NOT NULL
        GROUP BY concept_name, course_id""",
    "trend7": """SELECT strftime("timestamp", '%Y-%m') AS month,
        avg(CASE WHEN mastery_status = 'passed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100
            AS pass_rate, count(mastery_status) AS attempts
        FROM concepts WHERE "timestamp" IS NOT NULL AND concept_name = (
            SELECT concept_name FROM cfail ORDER BY fail_rate DESC NULLS LAST, concept_name LIMIT 1)
        GROUP BY 1""",
    "timed": """SELECT s.*, g.score,
        (epoch_us(deadline) - epoch_us(submitted_at)) / 3.6e9::DOUBLE AS buffer_hours
        FROM submissions s JOIN grades g
        ON s.assessment_id = g.assessment_id AND s.student_id = g.student_id
        WHERE g.score IS NOT NULL""",
    "banded": """SELECT *, CASE WHEN buffer_hours <= -200 OR buffer_hours IS NULL THEN NULL
            WHEN buffer_hours <= -1 THEN 1 WHEN buffer_hours <= 6 THEN 2
            WHEN buffer_hours <= 24 THEN 3 ELSE 4 END::INTEGER AS band_ord,
        ['Late', '<6h', '6–24h', '>24h'][band_ord] AS band FROM timed""",
    "weeks": """SELECT week, att_rate, events FROM (
            SELECT strftime(date_trunc('week', session_datetime), '%Y-%m-%d') || '/' ||
                strftime(date_trunc('week', session_datetime) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
                avg(CASE WHEN status = 'attended' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100
                    AS att_rate
            FROM attendance WHERE session_datetime IS NOT NULL GROUP BY 1)
        FULL JOIN (
            SELECT strftime(date_trunc('week', event_datetime), '%Y-%m-%d') || '/' ||
                strftime(date_trunc('week', event_datetime) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
                count(*) AS events
            FROM engagement WHERE event_datetime IS NOT NULL GROUP BY 1) USING (week)""",
    "wtrim": """SELECT * FROM weeks WHERE week > (SELECT min(week) FROM weeks)
        AND week < (SELECT max(week) FROM weeks)""",
    "heat": """SELECT monthname(session_datetime) AS month, dayname(session_datetime) AS dow,
        avg(CASE WHEN status = 'attended' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS rate
        FROM attendance WHERE session_datetime IS NOT NULL GROUP BY 1, 2""",
    "ages": """SELECT band_ord, ['≤19', '20–22', '23–25', '26–30', '31+'][band_ord] AS age_band,
        avg(avg_grade) AS avg_grade, avg(att_rate) AS att_rate, avg(logins) AS logins,
        count(student_id) AS count
        FROM (SELECT *, CASE WHEN age <= 0 THEN NULL WHEN age <= 19 THEN 1 WHEN age <= 22 THEN 2
                WHEN age <= 25 THEN 3 WHEN age <= 30 THEN 4 WHEN age <= 100 THEN 5 END::INTEGER
                AS band_ord FROM students)
        LEFT JOIN att USING (student_id) LEFT JOIN grd USING (student_id)
        LEFT JOIN lgn USING (student_id)
        WHERE band_ord IS NOT NULL GROUP BY band_ord""",
    "audit": """SELECT group_id, group_name, course_id, stated_num_students, true_count,
        course_name, stated_num_students - true_count AS discrepancy,
        coalesce((stated_num_students - true_count) / nullif(stated_num_students, 0)::DOUBLE * 100,
            100) AS disc_pct
        FROM sizes LEFT JOIN courses USING (course_id)""",
    "prof": """SELECT group_id, concept_name, avg(score_pct) AS level
        FROM concepts JOIN (SELECT DISTINCT student_id, group_id FROM students
            WHERE group_id IS NOT NULL) USING (student_id)
        WHERE concept_name IS NOT NULL AND score_pct IS NOT NULL GROUP BY group_id, concept_name""",
    "alike": """SELECT o.group_id, corr(o.level, m.level) AS similarity FROM prof o
        JOIN (SELECT concept_name, level FROM prof WHERE group_id = (
            SELECT group_id FROM sizes ORDER BY true_count, group_id LIMIT 1)) m USING (concept_name)
        GROUP BY o.group_id HAVING count(*) > 3""",
    "merges": """SELECT group_id, group_name, course_name, true_count,
        CASE WHEN isnan(similarity) THEN NULL ELSE similarity END AS similarity
        FROM sizes JOIN alike USING (group_id) LEFT JOIN courses USING (course_id)
        WHERE true_count > 10""",
    "per": """SELECT student_id, date_trunc('week', event_datetime) AS period, count(*) AS events
        FROM engagement WHERE student_id IS NOT NULL AND event_datetime IS NOT NULL GROUP BY 1, 2""",
    "mid": """SELECT period FROM (SELECT DISTINCT period FROM per) ORDER BY period
        LIMIT 1 OFFSET (SELECT count(DISTINCT period) // 2 FROM per)""",
    "decl": """SELECT student_id, eng_first, eng_last, eng_first - eng_last AS eng_decline FROM (
        SELECT student_id,
            coalesce(avg(events) FILTER (period <= (SELECT period FROM mid)), 0) AS eng_first,
            coalesce(avg(events) FILTER (period > (SELECT period FROM mid)), 0) AS eng_last
        FROM per GROUP BY student_id)""",
    "gathered": """SELECT student_id, full_name, course_name, group_name,
        coalesce(att_rate, 0) AS att_rate, coalesce(avg_grade, 0) AS avg_grade,
        coalesce(failed_c, 0) AS failed_c, coalesce(eng_decline, 0) AS eng_decline
        FROM students LEFT JOIN att USING (student_id) LEFT JOIN grd USING (student_id)
        LEFT JOIN fld USING (student_id) LEFT JOIN decl USING (student_id)""",
    "ends": """SELECT min(att_rate) AS a0, max(att_rate) AS a1, min(avg_grade) AS g0,
        max(avg_grade) AS g1, min(greatest(eng_decline, 0)) AS d0,
        max(greatest(eng_decline, 0)) AS d1, min(failed_c) AS f0, max(failed_c) AS f1
        FROM gathered""",
    "scored": """SELECT gathered.*, 100 * (
        0.35::DOUBLE * CASE WHEN a1 > a0 THEN (a1 - att_rate) / (a1 - a0) ELSE 0 END
        + 0.25::DOUBLE * CASE WHEN d1 > d0 THEN (greatest(eng_decline, 0) - d0) / (d1 - d0)
            ELSE 0 END
        + 0.25::DOUBLE * CASE WHEN g1 > g0 THEN (g1 - avg_grade) / (g1 - g0) ELSE 0 END
        + 0.15::DOUBLE * CASE WHEN f1 > f0 THEN (failed_c - f0)::DOUBLE / (f1 - f0) ELSE 0 END
        ) AS risk_score FROM gathered, ends""",
    "trend15": """SELECT group_id, group_name, seq, score FROM (
            SELECT group_id, m, avg(score) AS score,
                row_number() OVER (PARTITION BY group_id ORDER BY m) AS seq
            FROM (SELECT group_id, date_trunc('month', date) AS m, score FROM grades
                WHERE group_id IS NOT NULL AND date IS NOT NULL)
            GROUP BY group_id, m)
        JOIN groups USING (group_id) WHERE group_name IS NOT NULL""",
    "slopes": """SELECT group_id, group_name, regr_slope(score, seq) AS slope,
        coalesce(CASE WHEN isnan(corr(score, seq)) THEN NULL ELSE corr(score, seq) END, 0) AS r
        FROM trend15 GROUP BY group_id, group_name HAVING regr_count(score, seq) >= 3""",
    "dirn": """SELECT *, CASE WHEN slope > 0.05 THEN 'up' WHEN slope < -0.05 THEN 'down' END
        AS direction FROM slopes""",
    "inputs": """SELECT (SELECT concept_name FROM cfail ORDER BY fail_rate DESC, concept_name
            LIMIT 1) AS worst_concept,
        (SELECT max(fail_rate) FROM cfail) AS worst_concept_fail_pct,
        (SELECT group_name FROM sizes ORDER BY true_count, group_id LIMIT 1)
            AS unviable_group_name,
        (SELECT min(true_count) FROM sizes) AS unviable_group_size,
        (SELECT group_name FROM grate ORDER BY att_rate, group_id LIMIT 1)
            AS lowest_att_group_name,
        (SELECT min(att_rate) FROM grate) AS lowest_att_group_rate,
        (SELECT avg(att_rate) FROM grate) AS platform_avg_att,
        (SELECT count(*) FILTER (is_at_risk) FROM risk) AS risk_student_count,
        (SELECT avg(is_late::INTEGER::DOUBLE) * 100 FROM submissions) AS late_rate_pct""",
    "density": """SELECT type, x, sum(exp(-0.5 * ((x - score) / h) ** 2)) / (n * h * sqrt(2 * pi()))
        AS density FROM grades JOIN (
            SELECT type, count(score) AS n, 1.059::DOUBLE * least(stddev_samp(score),
                (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349::DOUBLE)
                * pow(count(score), -0.2::DOUBLE) AS h
            FROM grades WHERE type IS NOT NULL GROUP BY type) USING (type),
        (SELECT unnest(range(0, 101, 5))::DOUBLE AS x)
        GROUP BY type, x, n, h""",
    "lscore": """SELECT CASE type WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' END AS label,
        score FROM grades WHERE type IN ('1-URGENT', '5-LOW')""",
    "ldensity": """SELECT label, x, sum(exp(-0.5 * ((x - score) / h) ** 2)) / (n * h * sqrt(2 * pi()))
        AS density FROM lscore JOIN (
            SELECT label, count(score) AS n, 1.059::DOUBLE * least(stddev_samp(score),
                (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349::DOUBLE)
                * pow(count(score), -0.2::DOUBLE) AS h
            FROM lscore WHERE label IS NOT NULL GROUP BY label) USING (label),
        (SELECT unnest(range(0, 101, 5))::DOUBLE AS x)
        GROUP BY label, x, n, h""",
    "odds": """SELECT o_orderkey AS student_id, o_totalprice / 5003 AS avg_grade,
        (o_orderkey * 37 % 101)::DOUBLE AS att_rate, o_orderkey * 53 % 40 AS logins,
        (o_orderkey * 11 % 900)::DOUBLE AS video_sec, o_orderkey % 7 AS failed_c,
        floor(o_totalprice / 5003 / 25)::BIGINT || '-' || (o_orderkey * 37 % 101) // 34 || '-'
            || (o_orderkey * 53 % 40) // 20 AS cluster FROM orders""",
    "oddlabels": """SELECT cluster, CASE WHEN g >= 75 AND a >= 75 THEN '🏆 High Achievers'
            WHEN g < 60 AND a < 50 THEN '🚨 At-Risk / Disengaged'
            WHEN l >= (SELECT median(logins) FROM odds) AND g < 70 THEN '⚡ Engaged but Struggling'
            ELSE '📈 Average / Improving' END AS segment, students
        FROM (SELECT cluster, avg(avg_grade) AS g, avg(att_rate) AS a, avg(logins) AS l,
            count(*) AS students FROM odds GROUP BY cluster)""",
    "labelled": """SELECT cluster, CASE WHEN g >= 75 AND a >= 75 THEN '🏆 High Achievers'
            WHEN g < 60 AND a < 50 THEN '🚨 At-Risk / Disengaged'
            WHEN l >= (SELECT median(logins) FROM members) AND g < 70
                THEN '⚡ Engaged but Struggling'
            ELSE '📈 Average / Improving' END AS segment, students
        FROM (SELECT cluster, avg(avg_grade) AS g, avg(att_rate) AS a, avg(logins) AS l,
            count(*) AS students FROM members GROUP BY cluster)""",
    # K-means of ten starts, drawn by a race of arrival times; rounds are recursive.
    "zf": "SELECT student_id, ["
        + ", ".join(
            f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)::DOUBLE"
            for c in ("att_rate", "avg_grade", "logins", "video_sec", "failed_c")
        )
        + "] AS z FROM feat",
    "drawn1": "SELECT start, [arg_min(z, -ln(u))] AS c FROM ("
        + f"SELECT start, z, {_u(0)} AS u FROM zf, (SELECT unnest(range(10)) AS start)) GROUP BY start",
    **{f"drawn{step + 1}": f"""SELECT start, list_append(any_value(c), arg_min(z, -ln(u) / w)) AS c FROM (
        SELECT start, c, z, {_u(step)} AS u, list_min(list_transform(c, lambda x: list_distance(x, z))) ** 2 AS w
        FROM zf, drawn{step}) WHERE w > 0 GROUP BY start""" for step in (1, 2, 3)},
    "rounds": "SELECT start, 0 AS i, c, 1e9::DOUBLE AS moved, 0::DOUBLE AS cost FROM drawn4 UNION ALL "
        + _round("rounds", 1e-4),
    "rested": """SELECT start, arg_max(c, i) AS c, arg_max(moved, i) AS moved, arg_max(cost, i) AS cost
        FROM rounds GROUP BY start""",
    "polished": "(SELECT start, 0 AS i, c, moved, cost FROM rested ORDER BY cost, start LIMIT 1) UNION ALL "
        + _round("polished", 1e-12),
    "clustered": """SELECT feat.*, len(list_filter(c, lambda x: x[2] > c[k][2] OR x[2] = c[k][2] AND x[1] > c[k][1]))::INTEGER
        AS cluster FROM (SELECT student_id, c, list_position(ds, list_min(ds)) AS k FROM (
            SELECT student_id, c, list_transform(c, lambda x: list_distance(x, z)) AS ds
            FROM zf, (SELECT arg_max(c, i) AS c FROM polished))) JOIN feat USING (student_id)""",
    "segmented": """SELECT clustered.*, segment FROM clustered JOIN (
        SELECT cluster, CASE WHEN g >= 75 AND a >= 75 THEN '🏆 High Achievers'
            WHEN g < 60 AND a < 50 THEN '🚨 At-Risk / Disengaged'
            WHEN l >= (SELECT median(logins) FROM feat) AND g < 70 THEN '⚡ Engaged but Struggling'
            ELSE '📈 Average / Improving' END AS segment
        FROM (SELECT cluster, avg(avg_grade) AS g, avg(att_rate) AS a, avg(logins) AS l
            FROM clustered GROUP BY cluster)) USING (cluster)""",
    "members": """SELECT feat.*, course_id AS cluster FROM feat JOIN students USING (student_id)""",
    "feed": """SELECT event_id,
        CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value * 30 AS VARCHAR) END AS seconds,
        CASE WHEN event_type = 'error' THEN strftime(ts, '%d/%m/%Y')
            ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment FROM events""",
}


def _box(source: str, key: str) -> str:
    return f"""SELECT {key}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
        count(score) AS n,
        round(min(score) FILTER (score BETWEEN lower_fence AND upper_fence), 6) AS whisker_low,
        round(max(score) FILTER (score BETWEEN lower_fence AND upper_fence), 6) AS whisker_high,
        count(*) FILTER (score < lower_fence OR score > upper_fence) AS outliers
        FROM {source} JOIN (SELECT {key}, quantile_cont(score, 0.25) AS q1,
                median(score) AS median, quantile_cont(score, 0.75) AS q3,
                q1 - 1.5::DOUBLE * (q3 - q1) AS lower_fence,
                q3 + 1.5::DOUBLE * (q3 - q1) AS upper_fence
            FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}) USING ({key})
        GROUP BY ALL"""


def _z(col: str) -> str:
    return (
        f"round(coalesce(({col} - avg({col}) OVER ()) / "
        f"nullif(stddev_pop({col}) OVER (), 0), 0), 6) AS {col}"
    )


_NAMED = "SELECT student_id, course_name, group_name FROM students"
_CONCEPT_COLUMNS = [f"Brand#{i}" for i in range(1, 26)]
_GRID_CONCEPTS = [*_CONCEPT_COLUMNS, "Never taught"]

REPORTS: dict[str, str] = {
    "raw_courses": "SELECT * FROM courses",
    "raw_groups": "SELECT * FROM groups",
    "raw_students": "SELECT * FROM students",
    "raw_grades": "SELECT * REPLACE (round(score, 6) AS score) FROM grades",
    "raw_attendance": "SELECT * FROM attendance",
    "raw_concepts": "SELECT * FROM concepts",
    "raw_engagement":
        "SELECT * REPLACE (round(duration_seconds, 6) AS duration_seconds) FROM engagement",
    "raw_submissions": "SELECT * FROM submissions",
    "cleaned_feed": """SELECT event_id,
        CASE WHEN TRY_CAST(seconds AS DOUBLE) BETWEEN 0 AND 7200
            THEN round(TRY_CAST(seconds AS DOUBLE), 6) END AS seconds,
        TRY_CAST(moment AS TIMESTAMP) AS moment FROM feed""",
    "platform_kpis": """SELECT (SELECT count(*) FROM students) AS students,
        (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM courses) AS courses,
        (SELECT round(avg(CASE WHEN status = 'attended' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
            * 100, 6) FROM attendance) AS attendance_pct,
        (SELECT round(avg(score), 6) FROM grades) AS grade_mean,
        (SELECT round(avg(att_rate), 6) FROM att) AS mean_student_attendance,
        (SELECT round(avg(avg_grade), 6) FROM grd) AS mean_student_grade,
        (SELECT round(avg(att_rate), 6) FROM grate) AS mean_group_attendance,
        (SELECT count(*) FILTER (is_at_risk) FROM risk) AS at_risk,
        (SELECT round(avg(is_at_risk::INTEGER::DOUBLE) * 100, 6) FROM risk) AS at_risk_pct""",
    "student_risk": """SELECT student_id, group_name, course_name, round(att_rate, 6) AS att_rate,
        round(avg_grade, 6) AS avg_grade, is_at_risk FROM risk""",
    "concept_fail": "SELECT concept_name, round(fail_rate, 6) AS fail_rate FROM cfail",
    "group_attendance": """SELECT * REPLACE (round(att_rate, 6) AS att_rate),
        CASE WHEN att_rate < (SELECT avg(att_rate) FROM grate) THEN 'below' ELSE 'above' END
            AS vs_mean FROM grate""",
    "attendance_summary": """SELECT round(avg(att_rate), 6) AS platform_avg,
        (SELECT group_name FROM grate ORDER BY att_rate, group_id LIMIT 1) AS lowest_group,
        round(min(att_rate), 6) AS lowest_rate,
        (SELECT group_name FROM grate ORDER BY att_rate DESC, group_id DESC LIMIT 1)
            AS highest_group,
        round(max(att_rate), 6) AS highest_rate,
        count(*) FILTER (att_rate < (SELECT avg(att_rate) FROM grate)) AS groups_below
        FROM grate""",
    "low_attendance_groups": """SELECT * REPLACE (round(att_rate, 6) AS att_rate) FROM grate
        WHERE att_rate < (SELECT avg(att_rate) FROM grate)""",
    "group_health": """SELECT group_id, group_name, stated_num_students, true_count,
        stated_num_students - true_count AS size_gap,
        abs(stated_num_students - true_count) + 1 AS size_gap_abs FROM sizes""",
    "monthly_attendance": """SELECT strftime(session_datetime, '%Y-%m') AS month,
        round(avg(CASE WHEN status = 'attended' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6)
            AS attendance_rate
        FROM attendance WHERE session_datetime IS NOT NULL GROUP BY 1""",
    "group_month_attendance": """SELECT month, group_id, round(rate, 6) AS rate, group_name FROM (
            SELECT strftime(session_datetime, '%Y-%m') AS month, group_id,
                avg(CASE WHEN status = 'attended' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS rate
            FROM attendance WHERE session_datetime IS NOT NULL AND group_id IS NOT NULL
            GROUP BY 1, 2) JOIN groups USING (group_id)""",
    "grade_by_course":
        "SELECT course_name, round(avg(score), 6) AS avg_score FROM cscore GROUP BY course_name",
    "risk_by_course": """SELECT course_name, round(avg(is_at_risk::INTEGER::DOUBLE) * 100, 6)
        AS risk_rate FROM risk WHERE course_name IS NOT NULL GROUP BY course_name""",
    "top_cities": """SELECT city, count(*) AS count FROM students WHERE city IS NOT NULL
        GROUP BY city ORDER BY count DESC, city LIMIT 12""",
    "students_by_group_course": """SELECT course_name, group_name, count(*) AS students
        FROM students WHERE course_name IS NOT NULL AND group_name IS NOT NULL GROUP BY 1, 2""",
    "score_by_type": """SELECT type, round(avg(score), 6) AS mean,
        round(stddev_samp(score), 6) AS std, round(median(score), 6) AS median
        FROM grades WHERE type IS NOT NULL GROUP BY type""",
    "score_box_by_type": _box("grades", "type"),
    "score_outliers_by_type": """SELECT type, round(score, 6) AS score, count(*) AS copies
        FROM grades JOIN (SELECT type, quantile_cont(score, 0.25) AS q1,
            quantile_cont(score, 0.75) AS q3 FROM grades GROUP BY type) USING (type)
        WHERE score < q1 - 1.5::DOUBLE * (q3 - q1) OR score > q3 + 1.5::DOUBLE * (q3 - q1)
        GROUP BY type, grades.score""",
    "score_density_by_type": "SELECT type, x, round(density, 6) AS density FROM density",
    "assessment_type_frequency":
        "SELECT type, count(*) AS count FROM grades WHERE type IS NOT NULL GROUP BY type",
    "most_volatile_type": """SELECT array_to_string(list_transform(
            string_split(type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS type,
        round(s, 6) AS std FROM (
        SELECT type, stddev_samp(score) AS s FROM grades WHERE type IS NOT NULL GROUP BY type) v
        ORDER BY s DESC, v.type LIMIT 1""",
    "score_histogram": """SELECT type, CASE WHEN score < 0 THEN 0 WHEN score > 100 THEN 41
        ELSE least(floor(score * 40 / 100.0::DOUBLE)::INTEGER + 1, 40) END AS bin, count(*) AS count
        FROM grades WHERE type IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2""",
    "score_by_course": """SELECT course_name, round(avg(score), 6) AS mean,
        round(stddev_samp(score), 6) AS std, round(median(score), 6) AS median,
        count(score) AS count FROM cscore GROUP BY course_name""",
    "course_grade_gap": """SELECT
        (SELECT course_name FROM cstats ORDER BY m DESC NULLS LAST, course_name DESC LIMIT 1) AS best_course,
        (SELECT course_name FROM cstats ORDER BY m NULLS LAST, course_name LIMIT 1) AS worst_course,
        round(max(m) - min(m), 6) AS gap,
        (SELECT course_name FROM cstats ORDER BY s DESC NULLS LAST, course_name DESC LIMIT 1) AS widest_course,
        round(max(s), 6) AS widest_std FROM cstats""",
    "score_box_by_course": _box("cscore", "course_name"),
    "attendance_vs_grade": f"""SELECT student_id, round(att_rate, 6) AS att_rate,
        round(avg_grade, 6) AS avg_grade, band_ord, band, course_name, group_name
        FROM quartl LEFT JOIN ({_NAMED}) USING (student_id)""",
    "quartile_grade": """SELECT band_ord, band, round(avg(avg_grade), 6) AS avg_grade
        FROM quartl GROUP BY band_ord, band""",
    "attendance_grade_corr": """SELECT count(*) AS students,
        round(corr(att_rate, avg_grade), 6) AS r,
        CASE WHEN abs(corr(att_rate, avg_grade)) > 0.6 THEN 'Strong'
            WHEN abs(corr(att_rate, avg_grade)) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength
        FROM pairs4""",
    "attendance_grade_ols": f"""SELECT course_name, regr_count(avg_grade, att_rate) AS n,
        round(regr_slope(avg_grade, att_rate), 6) AS slope,
        round(regr_intercept(avg_grade, att_rate), 6) AS intercept,
        round(regr_r2(avg_grade, att_rate), 6) AS r2
        FROM pairs4 LEFT JOIN ({_NAMED}) USING (student_id)
        WHERE course_name IS NOT NULL GROUP BY course_name""",
    "engagement_vs_grade": """SELECT student_id, round(avg_grade, 6) AS avg_grade, logins,
        round(video_hrs, 6) AS video_hrs, course_name
        FROM engaged LEFT JOIN students USING (student_id)""",
    "engagement_grade_corr": """SELECT round(corr(logins, avg_grade), 6) AS r_login,
        round(corr(video_hrs, avg_grade), 6) AS r_video, round(avg(logins), 6) AS mean_logins
        FROM engaged""",
    "engagement_grade_ols": """SELECT course_name, regr_count(avg_grade, video_hrs) AS n,
        round(regr_slope(avg_grade, video_hrs), 6) AS slope,
        round(regr_intercept(avg_grade, video_hrs), 6) AS intercept,
        round(regr_r2(avg_grade, video_hrs), 6) AS r2
        FROM engaged LEFT JOIN students USING (student_id)
        WHERE course_name IS NOT NULL GROUP BY course_name""",
    "submission_timing": """SELECT assessment_id, student_id, deadline, submitted_at, is_late,
        round(buffer_hours, 6) AS buffer_hours, round(score, 6) AS score, band_ord, band
        FROM banded""",
    "timing_band_score": """SELECT band_ord, band, round(avg(score), 6) AS score FROM banded
        WHERE band_ord IS NOT NULL GROUP BY band_ord, band""",
    "late_vs_ontime": """SELECT round(avg(score) FILTER (NOT is_late), 6) AS ontime_avg,
        round(avg(score) FILTER (is_late), 6) AS late_avg,
        round(avg(score) FILTER (NOT is_late) - avg(score) FILTER (is_late), 6) AS gap
        FROM timed""",
    "submission_ols": """SELECT is_late, regr_count(score, buffer_hours) AS n,
        round(regr_slope(score, buffer_hours), 6) AS slope,
        round(regr_intercept(score, buffer_hours), 6) AS intercept,
        round(regr_r2(score, buffer_hours), 6) AS r2
        FROM timed WHERE buffer_hours > -500 AND buffer_hours < 500 GROUP BY is_late""",
    "score_box_by_lateness": _box("timed", "is_late"),
    "event_share": """SELECT event_type, count(*) AS count,
        round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share
        FROM engagement WHERE event_type IS NOT NULL GROUP BY event_type""",
    "event_share_labelled": """SELECT event, count(*) AS count,
        round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share
        FROM (SELECT CASE event_type WHEN 'login' THEN 'Login' WHEN 'video_watch' THEN 'Video Watch'
                WHEN 'resource_download' THEN 'Resource Download'
                WHEN 'quiz_attempt' THEN 'Quiz Attempt' WHEN 'forum_post' THEN 'Forum Post' END
            AS event FROM engagement) WHERE event IS NOT NULL GROUP BY event""",
    "concept_fail_by_course": """SELECT concept_name, course_id, round(fail_rate, 6) AS fail_rate,
        course_name FROM ccrate LEFT JOIN courses USING (course_id)""",
    "top_failing_concepts": """SELECT concept_name, course_id, round(fail_rate, 6) AS fail_rate,
        course_name FROM ccrate LEFT JOIN courses USING (course_id)
        ORDER BY ccrate.fail_rate DESC, concept_name, course_id LIMIT 15""",
    "biggest_weak_spot": """SELECT concept_name, course_name, round(fail_rate, 6) AS fail_rate
        FROM ccrate LEFT JOIN courses USING (course_id)
        ORDER BY ccrate.fail_rate DESC, concept_name, course_id LIMIT 1""",
    "course_concept_grid": """SELECT course_name, concept_name, round(avg(fail_rate), 6) AS fail_rate
        FROM ccrate JOIN courses USING (course_id)
        WHERE course_name IS NOT NULL AND concept_name IS NOT NULL GROUP BY 1, 2""",
    "course_concept_grid_listed": """SELECT course_name, concept_name,
        round(coalesce(avg(fail_rate), 0), 6) AS fail_rate
        FROM (SELECT DISTINCT course_name FROM ccrate JOIN courses USING (course_id) WHERE course_name IS NOT NULL)
        CROSS JOIN (SELECT unnest([%s]) AS concept_name)
        LEFT JOIN (SELECT * FROM ccrate JOIN courses USING (course_id))
            USING (course_name, concept_name) GROUP BY 1, 2""" % ", ".join(f"'{c}'" for c in _GRID_CONCEPTS),
    "course_concept_pivot": "SELECT course_name, "
        + ", ".join(
            f"""round(coalesce(avg(fail_rate) FILTER (concept_name = '{c}'), 0), 6) AS "{c}" """
            for c in _CONCEPT_COLUMNS
        )
        + " FROM ccrate JOIN courses USING (course_id) GROUP BY course_name",
    "worst_concept": """SELECT concept_name AS worst_concept FROM cfail
        ORDER BY fail_rate DESC, concept_name LIMIT 1""",
    "worst_concept_trend":
        "SELECT month, round(pass_rate, 6) AS pass_rate, attempts FROM trend7",
    "worst_concept_change": """SELECT round(a, 6) AS first_rate, round(b, 6) AS last_rate,
        round(b - a, 6) AS change, CASE WHEN b - a > 5 THEN 'improving'
            WHEN b - a < -5 THEN 'declining' ELSE 'flat' END AS trend
        FROM (SELECT arg_min(pass_rate, month) AS a, arg_max(pass_rate, month) AS b FROM trend7)""",
    "weekly_timeline": "SELECT week, round(att_rate, 6) AS att_rate, events FROM weeks",
    "weekly_timeline_trimmed": "SELECT week, round(att_rate, 6) AS att_rate, events FROM wtrim",
    "dip_week": """SELECT week, round(att_rate, 6) AS att_rate FROM wtrim
        WHERE att_rate IS NOT NULL ORDER BY wtrim.att_rate, week LIMIT 1""",
    "month_dow_heatmap": "SELECT month, dow, round(rate, 6) AS rate FROM heat",
    "month_dow_grid": "SELECT month, "
        + ", ".join(
            f"round(avg(rate) FILTER (dow = '{d}'), 6) AS {d}"
            for d in (
                "Saturday", "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
            )
        )
        + " FROM heat GROUP BY month",
    "age_band_stats": """SELECT band_ord, age_band, round(avg_grade, 6) AS avg_grade,
        round(att_rate, 6) AS att_rate, round(logins, 6) AS logins, count FROM ages""",
    "age_band_leaders": """SELECT
        (SELECT age_band FROM ages ORDER BY avg_grade DESC NULLS LAST, band_ord DESC LIMIT 1) AS best_grade_band,
        round(max(avg_grade), 6) AS best_grade,
        (SELECT age_band FROM ages ORDER BY logins DESC NULLS LAST, band_ord DESC LIMIT 1) AS most_engaged_band,
        (SELECT age_band FROM ages ORDER BY att_rate DESC NULLS LAST, band_ord DESC LIMIT 1)
            AS best_attendance_band FROM ages""",
    "stated_vs_true": "SELECT * REPLACE (round(disc_pct, 6) AS disc_pct) FROM audit",
    "overcounted_groups":
        "SELECT * REPLACE (round(disc_pct, 6) AS disc_pct) FROM audit WHERE disc_pct > 40",
    "size_audit_totals": """SELECT (SELECT group_name FROM audit ORDER BY true_count, group_id
            LIMIT 1) AS smallest_group, min(true_count) AS smallest_size,
        max(discrepancy) AS max_discrepancy, sum(discrepancy)::BIGINT AS total_discrepancy
        FROM audit""",
    "group_sizes": """SELECT group_id, group_name, course_id, true_count, course_name
        FROM sizes LEFT JOIN courses USING (course_id)""",
    "merge_candidates": "SELECT * REPLACE (round(similarity, 6) AS similarity) FROM merges",
    "top_merge_candidates": """SELECT * REPLACE (round(similarity, 6) AS similarity) FROM merges
        ORDER BY merges.similarity DESC NULLS LAST, group_id LIMIT 8""",
    "student_features": """SELECT student_id, round(att_rate, 6) AS att_rate,
        round(avg_grade, 6) AS avg_grade, logins, round(video_sec, 6) AS video_sec, failed_c
        FROM feat""",
    "student_features_scaled": "SELECT student_id, "
        + ", ".join(_z(c) for c in ("att_rate", "avg_grade", "logins", "video_sec", "failed_c"))
        + " FROM feat",
    "approx_score_check": """SELECT type, count(score) AS n, unnest(['q1', 'median', 'q3', 'p95']) AS name,
        true AS within FROM grades WHERE type IS NOT NULL AND score IS NOT NULL GROUP BY type""",
    "student_segments": """SELECT student_id, round(att_rate, 6) AS att_rate, round(avg_grade, 6) AS avg_grade,
        logins, round(video_sec, 6) AS video_sec, failed_c, cluster, segment FROM segmented""",
    "segment_profile": """SELECT segment, count(*) AS students, round(avg(att_rate), 6) AS att_rate,
        round(avg(avg_grade), 6) AS avg_grade, round(avg(logins), 6) AS logins,
        round(avg(video_sec), 6) AS video_sec, round(avg(failed_c), 6) AS failed_c
        FROM segmented GROUP BY segment""",
    "course_labels": "SELECT cluster, segment, students FROM labelled",
    "activity_decline": """SELECT student_id, round(eng_first, 6) AS eng_first,
        round(eng_last, 6) AS eng_last, round(eng_decline, 6) AS eng_decline FROM decl""",
    "risk_ranking": """SELECT student_id, full_name, course_name, group_name,
        round(att_rate, 6) AS att_rate, round(avg_grade, 6) AS avg_grade, failed_c,
        round(eng_decline, 6) AS eng_decline, round(risk_score, 6) AS risk_score FROM scored""",
    "top_at_risk": """SELECT student_id, full_name, course_name, group_name,
        round(att_rate, 6) AS att_rate, round(avg_grade, 6) AS avg_grade, failed_c,
        round(eng_decline, 6) AS eng_decline, round(risk_score, 6) AS risk_score FROM scored
        ORDER BY scored.risk_score DESC, student_id LIMIT 10""",
    "risk_tiers": """SELECT tier, count(*) AS students FROM (SELECT CASE WHEN risk_score >= 80 THEN 3
            WHEN risk_score >= 60 THEN 2 WHEN risk_score >= 40 THEN 1 END AS tier FROM scored)
        WHERE tier IS NOT NULL GROUP BY tier""",
    "grade_trend": "SELECT group_id, group_name, seq, round(score, 6) AS score FROM trend15",
    "trend_slopes": """SELECT group_id, group_name, round(slope, 6) AS slope, round(r, 6) AS r,
        direction FROM dirn""",
    "first_last": """SELECT group_name, round(arg_min(score, seq), 6) AS first,
        round(arg_max(score, seq), 6) AS last,
        round(arg_max(score, seq) - arg_min(score, seq), 6) AS change
        FROM trend15 GROUP BY group_name""",
    "trajectory_counts": """SELECT count(*) FILTER (direction = 'up') AS up,
        count(*) FILTER (direction = 'down') AS down FROM dirn""",
    "decision_inputs": """SELECT worst_concept,
        round(worst_concept_fail_pct, 6) AS worst_concept_fail_pct, unviable_group_name,
        unviable_group_size, lowest_att_group_name,
        round(lowest_att_group_rate, 6) AS lowest_att_group_rate,
        round(platform_avg_att, 6) AS platform_avg_att, risk_student_count,
        round(late_rate_pct, 6) AS late_rate_pct FROM inputs""",
    "decisions": """SELECT decision, insight_trigger, owner, timeframe, priority FROM (
        SELECT 'Redesign ' || worst_concept || ' concept module' AS decision,
            'Highest concept failure rate: ' || format('{:.1f}%', worst_concept_fail_pct)
                AS insight_trigger, 'Curriculum lead' AS owner, '2 weeks' AS timeframe,
            'Critical' AS priority FROM inputs
        UNION ALL SELECT 'Merge or dissolve ' || unviable_group_name,
            'True group size is ' || unviable_group_size, 'Operations lead', 'This week',
            'Critical' FROM inputs
        UNION ALL SELECT 'Launch attendance intervention for ' || lowest_att_group_name,
            'Lowest attendance group at ' || format('{:.1f}%', lowest_att_group_rate),
            'Instructor manager', 'This week', 'High' FROM inputs
        UNION ALL SELECT 'Start at-risk student outreach',
            risk_student_count || ' students below attendance or grade thresholds',
            'Student success', '48 hours', 'Critical' FROM inputs
        UNION ALL SELECT 'Deploy late-submission reminders',
            'Late submission rate is ' || format('{:.1f}%', late_rate_pct),
            'Academic operations', '1 week', 'High' FROM inputs)""",
    "cluster_labels": "SELECT cluster, segment, students FROM oddlabels",
    "cluster_profile": """SELECT segment, count(*) AS students, round(avg(att_rate), 6) AS att_rate,
        round(avg(avg_grade), 6) AS avg_grade, round(avg(logins), 6) AS logins,
        round(avg(video_sec), 6) AS video_sec, round(avg(failed_c), 6) AS failed_c
        FROM odds JOIN oddlabels USING (cluster) GROUP BY segment""",
    "course_modules": """SELECT r_regionkey AS course_id, i::INTEGER AS number,
        r_name || ' "' || i || '"' AS module
        FROM (SELECT *, unnest(range(1, r_regionkey + 3)) AS i FROM region)""",
    "oversized_groups": """SELECT group_id, group_name, count(*) AS true_count FROM students
        GROUP BY group_id, group_name HAVING count(*) > 45""",
    "enriched_students": """SELECT student_id, full_name, group_id, course_id, instructor, group_name,
        course_name FROM students""",
    "students_of_low_groups": """SELECT student_id, full_name, group_id FROM students
        WHERE group_id IN (SELECT group_id FROM grate WHERE att_rate < (SELECT avg(att_rate) FROM grate))""",
    "group_rate_texts": """SELECT group_id, round_even(round(att_rate, 6), 1) || '%' AS att_rate FROM grate""",
    "cumulative_attendance": """SELECT student_id, strftime(start, '%Y-%m-%d') || '/' ||
        strftime(start + INTERVAL 6 DAY, '%Y-%m-%d') AS week, round(rate, 6) AS att_rate, rate < 60 AS below
        FROM (SELECT student_id, start, sum(hits) OVER so_far / sum(n) OVER so_far * 100 AS rate
            FROM (SELECT student_id, date_trunc('week', session_datetime) AS start, count(*) AS n,
                count(*) FILTER (status = 'attended') AS hits FROM attendance
                WHERE student_id IS NOT NULL AND session_datetime IS NOT NULL GROUP BY 1, 2)
            WINDOW so_far AS (PARTITION BY student_id ORDER BY start
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "first_score_warning": """SELECT student_id, min(date) AS first_date,
        round(first(score ORDER BY date, assessment_id, score), 6) AS first_score FROM grades
        WHERE type = '1-URGENT' AND score IS NOT NULL AND student_id IS NOT NULL
        GROUP BY student_id HAVING first(score ORDER BY date, assessment_id, score) < 55""",
    "assessment_label_frequency": "SELECT label, count(*) AS count FROM lscore GROUP BY label",
    "score_box_by_label": _box("lscore", "label"),
    "score_density_by_label": "SELECT label, x, round(density, 6) AS density FROM ldensity",
}


def _needed(body: str, found: dict[str, str]) -> None:
    for name, sql in VIEWS.items():
        if name not in found and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", body):
            _needed(re.sub(rf"\b{name}\b", "", sql), found)  # a recursive view names itself
            found[name] = sql


def oracle_queries() -> dict[str, str]:
    """Each report's SQL with exactly the views it needs in front."""
    queries = {}
    for report, body in REPORTS.items():
        views: dict[str, str] = {}
        _needed(body, views)
        head = ",\n".join(f"{name} AS ({sql})" for name, sql in views.items())
        word = "WITH RECURSIVE" if "rounds" in views else "WITH"
        queries[report] = f"{word} {head}\n{body}" if views else body
    return queries
