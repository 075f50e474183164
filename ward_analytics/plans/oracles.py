"""The registered queries as SQL for DuckDB.

The SQL is written in long form (one row per patient and vital, joins with small value lists, ordered
string aggregation), while the Spark side works on wide rows. Only fixed texts are shared.
"""

from __future__ import annotations

from ward_analytics.catalogue import (
    ASSESS_LADDERS,
    CAUSE_RULES,
    EMPTY_LABELS,
    NO_PROBLEMS_TEXT,
    PROMPT_QUESTION,
    PROMPT_ROLE,
    VITAL_CATALOGUE,
    VITALS,
    VITALS_TABLE_HEAD,
)

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
VITAL_COLUMNS = ", ".join(VITALS)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"CAST({value} AS DOUBLE)"
    if isinstance(value, tuple):
        return "[" + ", ".join(_sql(v) for v in value) + "]::VARCHAR[]"
    return str(value)


def _values(name: str, columns: str, rows) -> str:
    lines = ",\n".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {lines})"


def _with(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + then


READINGS = """
readings AS (
  SELECT user_id AS patient_id, ts AS event_time,
    CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'view' THEN 'respiratory_rate'
      WHEN 'purchase' THEN 'spo2' WHEN 'error' THEN 'systolic_bp'
      WHEN 'signup' THEN 'temperature' END AS vital_sign,
    floor(CASE event_type WHEN 'click' THEN 35 + value % 115 WHEN 'view' THEN 6 + value % 26
      WHEN 'purchase' THEN 86 + value % 14 WHEN 'error' THEN 80 + value % 150
      WHEN 'signup' THEN 94 + value % 12 END * 100) / 100 AS value
  FROM events)"""

UNNUMBERED = READINGS.replace(
    "user_id AS patient_id", "CASE WHEN value > 50 THEN 'p' ELSE '' END || user_id AS patient_id"
)

# Readings that the three runs accept: of the last run's, those of windows that end after the watermark of the two before it.
LATE_READINGS = READINGS.replace(
    "FROM events",
    """FROM events WHERE NOT (ts < TIMESTAMP '2024-01-16' AND event_id % 10 = 0)
    OR time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE > (
      SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-30' AND NOT (ts < TIMESTAMP '2024-01-16' AND event_id % 10 = 0)
    ) - INTERVAL 1 MINUTE""",
)

# printf rounds the binary value
CELSIUS = "CAST(printf('%.1f', (temperature - 32) * 5 / 9) AS DOUBLE)"


def _wide(window: str) -> str:
    highest = ",\n".join(f"max(value) FILTER (WHERE vital_sign = '{v}') AS {v}" for v in VITALS)
    return f"""
wide AS (
  SELECT patient_id, time_bucket(INTERVAL '{window}', event_time) AS window_start,
    {highest}
  FROM readings GROUP BY 1, 2)"""


def _scored(temperature: str = "temperature", missing_zero: bool = False) -> str:
    def points(vital: str, cases: str) -> str:
        absent = f"WHEN {vital} IS NULL THEN 0 " if missing_zero else ""
        return f"CASE {absent}{cases} END"

    hr = points(
        "heart_rate",
        "WHEN heart_rate <= 40 THEN 3 WHEN heart_rate BETWEEN 41 AND 50 THEN 1 "
        "WHEN heart_rate BETWEEN 51 AND 90 THEN 0 WHEN heart_rate BETWEEN 91 AND 110 THEN 1 "
        "WHEN heart_rate BETWEEN 111 AND 130 THEN 2 ELSE 3",
    )
    rr = points(
        "respiratory_rate",
        "WHEN respiratory_rate <= 8 THEN 3 WHEN respiratory_rate BETWEEN 9 AND 11 THEN 1 "
        "WHEN respiratory_rate BETWEEN 12 AND 20 THEN 0 "
        "WHEN respiratory_rate BETWEEN 21 AND 24 THEN 2 ELSE 3",
    )
    spo2 = points(
        "spo2",
        "WHEN spo2 <= 91 THEN 3 WHEN spo2 BETWEEN 92 AND 93 THEN 2 "
        "WHEN spo2 BETWEEN 94 AND 95 THEN 1 ELSE 0",
    )
    sbp = points(
        "systolic_bp",
        "WHEN systolic_bp <= 90 THEN 3 WHEN systolic_bp BETWEEN 91 AND 100 THEN 2 "
        "WHEN systolic_bp BETWEEN 101 AND 110 THEN 1 WHEN systolic_bp BETWEEN 111 AND 219 THEN 0 "
        "ELSE 3",
    )
    temp = points(
        "temperature",
        f"WHEN {temperature} <= CAST(35.0 AS DOUBLE) THEN 3 "
        f"WHEN {temperature} BETWEEN CAST(35.1 AS DOUBLE) AND CAST(36.0 AS DOUBLE) THEN 1 "
        f"WHEN {temperature} BETWEEN CAST(36.1 AS DOUBLE) AND CAST(38.0 AS DOUBLE) THEN 0 "
        f"WHEN {temperature} BETWEEN CAST(38.1 AS DOUBLE) AND CAST(39.0 AS DOUBLE) THEN 1 ELSE 2",
    )
    return f"""
points AS (
  SELECT *, CAST({hr} + {rr} + {spo2} + {sbp} + {temp} AS INTEGER) AS news2_score FROM wide),
scores AS (
  SELECT TRY_CAST(patient_id AS INTEGER) AS patient_id, window_start, news2_score,
    CASE WHEN news2_score <= 4 THEN 'LOW' WHEN news2_score <= 6 THEN 'MEDIUM' ELSE 'HIGH' END
      AS risk_level,
    {VITAL_COLUMNS}
  FROM points)"""


FIVE_MINUTES = (READINGS, _wide("5 minutes"), _scored())
DAILY = (READINGS, _wide("1 day"), _scored())

MILD = (READINGS, _wide("1 day"), _scored(missing_zero=True))

NEWEST = """
newest AS (
  SELECT * FROM scores
  QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY window_start DESC, news2_score DESC) = 1)"""

PATIENTS = """
patients AS (
  SELECT CAST(c_custkey AS INTEGER) AS patient_id, c_name AS full_name,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD'
      THEN substr(c_mktsegment, 1, 2) || '-' || (c_custkey % 40) END AS room_number,
    CASE WHEN c_custkey % 13 <> 0
      THEN DATE '1930-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) END AS date_of_birth,
    CASE WHEN c_custkey % 11 <> 0
      THEN CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END END AS sex,
    CASE c_nationkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Penicillin — anaphylaxis']
      ELSE ['Latex — contact dermatitis', 'Aspirin — GI bleed'] END AS allergies,
    CASE c_nationkey % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['COPD', 'Asthma']
      WHEN 2 THEN ['Coronary artery disease', 'Heart failure']
      WHEN 3 THEN ['Hypertension', 'Type 2 diabetes'] ELSE ['Asthma'] END
      AS past_medical_conditions,
    CASE c_custkey % 4 WHEN 1 THEN 'Former smoker. CABG 2019.'
      WHEN 2 THEN 'Prior stay for pneumonia.' WHEN 3 THEN 'No prior stays.' END
      AS medical_history,
    CASE c_custkey % 4 WHEN 0 THEN []::VARCHAR[]
      WHEN 1 THEN ['Carvedilol 6.25mg BD', 'Furosemide 40mg OD']
      WHEN 2 THEN ['Beta blocker', 'Metformin 500mg BD'] ELSE ['Thiazide diuretic'] END
      AS current_medications,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Street ' || c_nationkey END AS home_address,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN lower(c_mktsegment) END AS occupation,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey % 1000) AS updated_at
  FROM customer)"""

PATIENT_TEXTS = """patient_id, full_name, room_number, date_of_birth, sex,
  array_to_string(allergies, '; ') AS allergies,
  array_to_string(past_medical_conditions, '; ') AS past_medical_conditions, medical_history,
  array_to_string(current_medications, '; ') AS current_medications, home_address, occupation,
  updated_at"""

EXPECTATIONS = """
expectations AS (
  SELECT CAST(c_custkey AS INTEGER) AS patient_id, c_name AS scenario,
    CASE c_custkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    CASE WHEN c_custkey % 3 = 2 THEN 7 WHEN c_custkey % 6 = 1 THEN 5 END AS min_score,
    CASE WHEN c_custkey % 3 = 0 THEN 4 WHEN c_custkey % 6 = 1 THEN 6 END AS max_score
  FROM customer)"""

CONTEXTS = """
contexts AS (
  SELECT patient_id, lower(array_to_string(past_medical_conditions, ' ') || ' '
    || coalesce(medical_history, '') || ' ' || array_to_string(current_medications, ' ')) AS context
  FROM patients)"""

CATALOGUE = _values(
    "catalogue",
    "vital_order, vital_sign, label, low, high, description, unit",
    [(i, *v, v.unit) for i, v in enumerate(VITAL_CATALOGUE, start=1)],
)

# Upper bound and points of each ladder step, written out apart from the catalogue; only the texts are shared.
BOUNDS = {
    "heart_rate": ((40, 3), (50, 1), (90, 0), (110, 1), (130, 2), (1e9, 3)),
    "respiratory_rate": ((8, 3), (11, 1), (20, 0), (24, 2), (1e9, 3)),
    "spo2": ((91, 3), (93, 2), (95, 1), (1e9, 0)),
    "systolic_bp": ((90, 3), (100, 2), (110, 1), (219, 0), (1e9, 3)),
    "temperature": ((35, 3), (36, 1), (38, 0), (39, 1), (1e9, 2)),
}

LADDER = _values(
    "ladder",
    "ladder_vital, step, upper, score, problem",
    [
        (vital, i, float(upper), points, ASSESS_LADDERS[vital][i].problem)
        for vital, steps in BOUNDS.items()
        for i, (upper, points) in enumerate(steps)
    ],
)

CAUSE_LIST = _values(
    "cause_list",
    "cause_vital, split, is_above, pos, cause, needs, terms",
    [
        (vital, 1e9 if rule.split is None else rule.split, side, pos, c.text, c.needs, c.terms)
        for vital, rule in CAUSE_RULES.items()
        for side, causes in ((True, rule.above), (False, rule.otherwise))
        for pos, c in enumerate(causes)
    ],
)

# One row per patient and catalogue vital: ends of the period, spread, trend.
HISTORY = f"""
recent AS (
  SELECT * REPLACE ({CELSIUS} AS temperature) FROM scores
  WHERE window_start >= {AS_OF} - INTERVAL 720 HOUR),
numbered AS (
  SELECT *,
    row_number() OVER (PARTITION BY patient_id ORDER BY window_start, news2_score) AS from_start,
    row_number() OVER (PARTITION BY patient_id ORDER BY window_start DESC, news2_score DESC)
      AS from_end,
    count(*) OVER (PARTITION BY patient_id) AS n_rows
  FROM recent),
long_values AS (
  SELECT n.*, c.*,
    CASE c.vital_sign WHEN 'heart_rate' THEN heart_rate WHEN 'respiratory_rate' THEN respiratory_rate
      WHEN 'spo2' THEN spo2 WHEN 'systolic_bp' THEN systolic_bp ELSE temperature END AS value
  FROM numbered n CROSS JOIN catalogue c),
per_vital AS (
  SELECT patient_id, vital_order, vital_sign, label, low, high, description, unit, n_rows,
    max(value) FILTER (WHERE from_start = 1) AS first_value,
    max(value) FILTER (WHERE from_end = 1) AS last_value,
    min(value) AS lowest, max(value) AS highest, count(value) AS n_values
  FROM long_values GROUP BY ALL),
trended AS (
  SELECT *,
    CASE WHEN n_rows >= 2 AND abs(last_value - first_value) >= CAST(0.5 AS DOUBLE) THEN
      CASE WHEN (vital_sign IN ('spo2', 'systolic_bp')) = (last_value < first_value)
        THEN 'worsening' ELSE 'improving' END END AS trend,
    CASE WHEN n_values > 0
      THEN least(lowest * CAST(0.9 AS DOUBLE), low * CAST(0.85 AS DOUBLE)) END AS y_min,
    CASE WHEN n_values > 0
      THEN greatest(highest * CAST(1.1 AS DOUBLE), high * CAST(1.15 AS DOUBLE)) END AS y_max
  FROM per_vital)"""

ASSESSED = """
assessed AS (
  SELECT t.*, l.score, l.problem,
    CASE l.score WHEN 0 THEN 'normal' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity,
    CASE WHEN l.problem IS NOT NULL THEN CAST(last_value AS VARCHAR) || ' ' || unit END AS detail
  FROM trended t JOIN ladder l ON l.ladder_vital = t.vital_sign AND t.last_value <= l.upper
  QUALIFY row_number() OVER (PARTITION BY t.patient_id, t.vital_sign ORDER BY l.step) = 1),
flags AS (
  SELECT patient_id,
    bool_or(vital_sign = 'temperature' AND score > 0) AS fever,
    bool_or(vital_sign = 'spo2' AND score > 0) AS hypoxia,
    CAST(count(*) FILTER (WHERE score > 0) AS INTEGER) AS n_abnormal,
    coalesce(string_agg(vital_sign, ', ' ORDER BY vital_order) FILTER (WHERE score > 0), '')
      AS abnormal
  FROM assessed GROUP BY 1),
listed AS (
  SELECT a.patient_id, a.vital_sign, a.vital_order, a.score, arg_min(c.cause, c.pos) AS cause,
    min(c.pos) AS pos
  FROM assessed a JOIN flags f USING (patient_id) LEFT JOIN contexts x USING (patient_id)
  JOIN cause_list c ON c.cause_vital = a.vital_sign AND c.is_above = (a.last_value > c.split)
  WHERE a.score > 0
    AND (c.needs IS NULL OR CASE c.needs WHEN 'has_fever' THEN f.fever WHEN 'has_hypoxia' THEN f.hypoxia
      WHEN 'fever_or_multi' THEN f.fever OR f.n_abnormal >= 3
      WHEN 'fever_and_multi' THEN f.fever AND f.n_abnormal >= 3 END)
    AND (len(c.terms) = 0
      OR len(list_filter(c.terms, lambda t: contains(coalesce(x.context, ''), t))) > 0)
  GROUP BY a.patient_id, a.vital_sign, a.vital_order, a.score, lower(c.cause)),
shown AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id, vital_sign ORDER BY pos) AS place
  FROM listed QUALIFY place <= 3),
cause_texts AS (
  SELECT patient_id, vital_sign, 'Likely causes: ' || string_agg(cause, ', ' ORDER BY place) AS causes
  FROM shown GROUP BY 1, 2),
explained AS (
  SELECT a.*, t.causes FROM assessed a LEFT JOIN cause_texts t USING (patient_id, vital_sign))"""

NARRATED = """
problems AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY score DESC, vital_order) AS place,
    count(*) OVER (PARTITION BY patient_id) AS n,
    split_part(problem, ' — ', 1) || ' (' || detail || ')' AS clause,
    substr(problem, strpos(problem, ' — ') + 3) AS plain
  FROM explained WHERE problem IS NOT NULL),
openings AS (
  SELECT patient_id, CAST(max(n) AS INTEGER) AS n_problems,
    'Patient presents with ' || CASE max(n)
      WHEN 1 THEN string_agg(clause, '')
      WHEN 2 THEN string_agg(clause, ' and ' ORDER BY place)
      ELSE string_agg(clause, ', ' ORDER BY place) FILTER (WHERE place < n) || ', and '
        || max(clause) FILTER (WHERE place = n) END || '.' AS opening,
    string_agg(upper(substr(plain, 1, 1)) || substr(plain, 2)
      || CASE trend WHEN 'worsening' THEN ' and getting worse'
           WHEN 'improving' THEN ' but improving' ELSE '' END || '.', chr(10) ORDER BY place)
      AS plain_english
  FROM problems GROUP BY 1),
all_causes AS (
  SELECT s.patient_id, arg_min(s.cause, p.place * 10 + s.place) AS cause,
    min(p.place * 10 + s.place) AS pos
  FROM shown s JOIN problems p USING (patient_id, vital_sign)
  GROUP BY s.patient_id, lower(s.cause)),
cause_lists AS (
  SELECT patient_id, string_agg(cause, '; ' ORDER BY pos) AS causes,
    string_agg('  • ' || cause, chr(10) ORDER BY pos) AS bullets
  FROM all_causes GROUP BY 1),
everyone AS (
  SELECT patient_id, news2_score, risk_level FROM numbered WHERE from_end = 1),
narrated AS (
  SELECT * FROM everyone LEFT JOIN openings USING (patient_id)
    LEFT JOIN cause_lists USING (patient_id))"""

PERIOD = (*DAILY, CATALOGUE, HISTORY)
CUT_PERIOD = (*FIVE_MINUTES, CATALOGUE, HISTORY.replace("720 HOUR", "500 HOUR"))

# The watermark after all events, and closed windows of what three runs accept.
WATERMARK = "(SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"
ACCEPTED = (
    LATE_READINGS, _wide("5 minutes"), _scored().replace("scores AS", "every_score AS"),
    f"scores AS (SELECT * FROM every_score WHERE window_start + INTERVAL 5 MINUTE <= {WATERMARK})",
)
# Readings of the last run whose window the watermark of the two before it had closed.
LATE_WATERMARK = """(SELECT max(ts) FROM events
  WHERE ts < TIMESTAMP '2024-01-30' AND NOT (ts < TIMESTAMP '2024-01-16' AND event_id % 10 = 0)) - INTERVAL 1 MINUTE"""
EXPLAINED = (*PERIOD, PATIENTS, CONTEXTS, LADDER, CAUSE_LIST, ASSESSED)
REPORTS = (*EXPLAINED, NARRATED)

TEXT_LINES = f"""
lines AS (
  SELECT patient_id, window_start, news2_score, risk_level,
    strftime(window_start, '%Y-%m-%d %H:%M:%S')
      || ' | ' || coalesce(CAST(heart_rate AS VARCHAR), 'None')
      || ' | ' || coalesce(CAST(respiratory_rate AS VARCHAR), 'None')
      || ' | ' || coalesce(CAST(spo2 AS VARCHAR), 'None')
      || ' | ' || coalesce(CAST(systolic_bp AS VARCHAR), 'None')
      || ' | ' || coalesce(CAST({CELSIUS} AS VARCHAR), '—')
      || ' | ' || news2_score || ' | ' || risk_level AS line
  FROM scores WHERE window_start >= {AS_OF} - INTERVAL 720 HOUR)"""

TEXT_TABLES = f"""
text_tables AS (
  SELECT patient_id,
    {_sql(VITALS_TABLE_HEAD[0])} || chr(10) || {_sql(VITALS_TABLE_HEAD[1])} || chr(10)
      || string_agg(line, chr(10) ORDER BY window_start) AS vitals_table,
    arg_max(news2_score, window_start) AS news2_score,
    arg_max(risk_level, window_start) AS risk_level
  FROM lines GROUP BY 1)"""

SCENARIOS = """
judged AS (
  SELECT e.patient_id, e.scenario, n.news2_score AS score, upper(n.risk_level) AS risk,
    concat_ws('; ',
      CASE WHEN n.risk_level <> e.risk_level
        THEN 'expected risk ' || e.risk_level || ', got ' || n.risk_level END,
      CASE WHEN n.news2_score < e.min_score
        THEN 'expected score >= ' || e.min_score || ', got ' || n.news2_score END,
      CASE WHEN n.news2_score > e.max_score
        THEN 'expected score <= ' || e.max_score || ', got ' || n.news2_score END,
      CASE WHEN n.patient_id IS NULL THEN 'no score in Postgres' END) AS reasons
  FROM expectations e LEFT JOIN newest n USING (patient_id)),
checked AS (
  SELECT patient_id, scenario, score, risk, CASE reasons WHEN '' THEN 'PASS' ELSE 'FAIL' END AS verdict,
    reasons,
    CASE reasons WHEN '' THEN 'PASS' ELSE 'FAIL' END || ' — ' || scenario || ' (patient '
      || patient_id || '): '
      || CASE WHEN score IS NULL THEN reasons
           ELSE 'score=' || score || ', risk=' || risk
             || CASE reasons WHEN '' THEN '' ELSE ' (' || reasons || ')' END END AS report
  FROM judged)"""

ACTIVE = """
active AS (
  SELECT n.patient_id, p.full_name, n.news2_score, n.risk_level, n.window_start, p.room_number
  FROM newest n JOIN patients p USING (patient_id))"""

RAW_READINGS = """
SELECT CAST(patient_id AS VARCHAR) AS patient_id,
  strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", vital_sign, value FROM readings"""

PROFILES = """
profiles AS (
  SELECT CAST(p_partkey AS INTEGER) AS patient_id, q.* EXCLUDE (patient_id),
    q.patient_id IS NOT NULL AS found
  FROM part LEFT JOIN patients q ON q.patient_id = p_partkey)"""


def _label(column: str) -> str:
    text = f"array_to_string({column}, ', ')" if column in (
        "allergies", "past_medical_conditions", "current_medications"
    ) else column
    return f"coalesce(nullif({text}, ''), {_sql(EMPTY_LABELS[column])}) AS {column}"


AGE = """(year(DATE '2024-01-31') - year(date_of_birth)
  - CASE WHEN (month(date_of_birth), day(date_of_birth)) > (1, 31) THEN 1 ELSE 0 END)"""


PROMPT = f"""SELECT patient_id, {_sql(PROMPT_ROLE)} || 'Patient background: '
  || coalesce({AGE} || ' years old', 'age unknown') || ', ' || coalesce(sex, 'unknown') || ', '
  || coalesce(nullif(array_to_string(past_medical_conditions, ', '), ''), 'none documented')
  || ', ' || coalesce(nullif(array_to_string(current_medications, ', '), ''), 'none documented')
  || '. Their vitals over the last 720 hours:' || chr(10)
  || coalesce(vitals_table, 'No vitals recorded in the last 720 hours.') || chr(10)
  || 'Current NEWS2 score: ' || coalesce(CAST(news2_score AS VARCHAR), '—') || ' - '
  || coalesce(risk_level, 'UNKNOWN') || '. ' || {_sql(PROMPT_QUESTION)} AS prompt"""


INSERTED = """SELECT patient_id, full_name, room_number FROM patients UNION ALL
SELECT CAST(l_partkey AS INTEGER), 'Arrival ' || l_orderkey, NULL FROM lineitem
WHERE l_partkey NOT IN (SELECT patient_id FROM patients)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "window_vitals": _with(
            READINGS, _wide("5 minutes"),
            then=f"SELECT patient_id, window_start, window_start + INTERVAL 5 MINUTE AS window_end, "
            f"{VITAL_COLUMNS} FROM wide",
        ),
        "scores": _with(*FIVE_MINUTES, then="SELECT * FROM scores"),
        "scores_daily": _with(*DAILY, then="SELECT * FROM scores"),
        "scores_daily_celsius": _with(
            READINGS, _wide("1 day"), _scored(CELSIUS), then="SELECT * FROM scores"
        ),
        "scores_daily_missing_zero": _with(*MILD, then="SELECT * FROM scores"),
        "message_roundtrip": _with(
            READINGS,
            then="SELECT CAST(patient_id AS VARCHAR) AS patient_id, event_time, vital_sign, value "
            "FROM readings",
        ),
        "decode_malformed": "SELECT 'reading' AS status, count(*) AS n_messages FROM events "
        "UNION ALL SELECT 'malformed', count(*) FROM documents",
        "csv_roundtrip": _with(READINGS, then=RAW_READINGS),
        "stream_scores": _with(
            *FIVE_MINUTES,
            then="SELECT * FROM scores WHERE window_start + INTERVAL 5 MINUTE "
            "<= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE",
        ),
        "stream_late": _with(
            LATE_READINGS, _wide("5 minutes"), _scored(),
            then="SELECT * FROM scores WHERE window_start + INTERVAL 5 MINUTE "
            "<= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE",
        ),
        "live_newest": _with(*ACCEPTED, NEWEST, then="SELECT * FROM newest"),
        "accounted_scores": _with(*ACCEPTED, then="SELECT * FROM scores"),
        "late_readings": _with(
            READINGS.replace("SELECT user_id", "SELECT event_id, user_id"),
            then="SELECT CAST(patient_id AS VARCHAR) AS patient_id, event_time, vital_sign, value, "
            "time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, "
            "(epoch_us(limits.w) // 1000 * 1000 - epoch_us(event_time)) / CAST(1000000 AS DOUBLE) AS late_by "
            f"FROM readings, (SELECT {LATE_WATERMARK} AS w) limits WHERE event_time < TIMESTAMP '2024-01-16' "
            "AND event_id % 10 = 0 AND time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE <= limits.w",
        ),
        "live_assessments": _with(
            *ACCEPTED, CATALOGUE, HISTORY.replace(f"{AS_OF} - INTERVAL 720 HOUR", f"{WATERMARK} - INTERVAL 6 HOUR"),
            PATIENTS, CONTEXTS, LADDER, CAUSE_LIST, ASSESSED,
            then="SELECT patient_id, vital_order, vital_sign, label, last_value AS value, score, "
            "severity, problem, detail, trend, causes FROM explained",
        ),
        "csv_replay": _with(READINGS, then=RAW_READINGS),
        "scores_published": _with(*FIVE_MINUTES, then=f"SELECT *, {AS_OF} AS created_at FROM scores"),
        "scores_by_filter": _with(*FIVE_MINUTES, then="SELECT * FROM scores WHERE patient_id IN (1, 2, 3, 5, 8, 13)"),
        "gated_scores": _with(*FIVE_MINUTES, then="SELECT * FROM scores"),
        "gate_refused": _with(
            *MILD, NEWEST, EXPECTATIONS, SCENARIOS,
            then="SELECT count(*) AS n_checks, count(*) FILTER (WHERE verdict = 'FAIL') AS n_failures, "
            "count(*) FILTER (WHERE verdict = 'FAIL') = 0 AS kept FROM checked",
        ),
        "stored_insert": _with(PATIENTS, then=INSERTED),
        "stored_backfill": _with(
            PATIENTS,
            then="SELECT patient_id, coalesce(room_number, 'R-' || first_order) AS room_number "
            "FROM patients LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders "
            "WHERE o_custkey // 100 % 2 = 0 GROUP BY 1) ON o_custkey = patient_id",
        ),
        "stored_update": _with(
            PATIENTS,
            then="SELECT patient_id, full_name, "
            "CASE WHEN u.o_custkey IS NULL THEN home_address ELSE 'Ward ' || u.o_orderkey END "
            "AS home_address, CASE WHEN u.o_custkey IS NULL THEN occupation "
            "WHEN u.o_orderstatus <> 'O' THEN u.o_orderpriority END AS occupation "
            "FROM patients LEFT JOIN (SELECT * FROM orders WHERE o_custkey // 100 % 2 = 0 QUALIFY row_number() OVER "
            "(PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) u ON u.o_custkey = patient_id",
        ),
        "arrivals_repeated": "SELECT CAST(o_custkey AS INTEGER) AS patient_id, count(*) AS n_arrived, "
        "bool_or(o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) AS in_table FROM orders "
        "GROUP BY o_custkey HAVING count(*) > 1 OR bool_or(o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer))",
        "partial_trend": _with(*CUT_PERIOD, then="SELECT patient_id, vital_order, vital_sign, trend FROM trended"),
        "partial_axis_domain": _with(
            *CUT_PERIOD, then="SELECT patient_id, vital_order, vital_sign, y_min, y_max FROM trended WHERE n_values > 0"
        ),
        "partial_coverage": _with(
            *CUT_PERIOD,
            then="SELECT patient_id, vital_order, vital_sign, n_values, CASE n_values WHEN 0 THEN 'No data' END AS status FROM trended",
        ),
        "bucketed_assessments": _with(
            *EXPLAINED,
            then="SELECT patient_id, vital_order, vital_sign, label, last_value AS value, score, "
            "severity, problem, detail, trend, causes FROM explained",
        ),
        "score_table": _with(
            *FIVE_MINUTES, then=f"SELECT *, {AS_OF} AS created_at FROM scores"
        ),
        "score_table_compacted": _with(
            *FIVE_MINUTES, then=f"SELECT *, {AS_OF} AS created_at FROM scores"
        ),
        "score_table_rejected": _with(
            UNNUMBERED, _wide("5 minutes"), _scored(),
            then=f"SELECT *, {AS_OF} AS created_at FROM scores WHERE patient_id IS NULL",
        ),
        "scores_by_key": _with(
            *FIVE_MINUTES, then="SELECT * FROM scores WHERE patient_id IN (1, 2, 3, 5, 8, 13)"
        ),
        "ensure_columns": _with(
            PATIENTS,
            then=f"SELECT {PATIENT_TEXTS} FROM (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS "
            "room_number, CAST(NULL AS VARCHAR) AS home_address, CAST(NULL AS VARCHAR) AS "
            "occupation) FROM patients)",
        ),
        "insert_absent": _with(PATIENTS, then=INSERTED),
        "backfill_null": _with(
            PATIENTS,
            then="SELECT patient_id, coalesce(room_number, 'R-' || first_order) AS room_number "
            "FROM patients LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders "
            "GROUP BY 1) ON o_custkey = patient_id",
        ),
        "keyed_update": _with(
            PATIENTS,
            then="SELECT patient_id, full_name, "
            "CASE WHEN u.o_custkey IS NULL THEN home_address ELSE 'Ward ' || u.o_orderkey END "
            "AS home_address, CASE WHEN u.o_custkey IS NULL THEN occupation "
            "WHEN u.o_orderstatus <> 'O' THEN u.o_orderpriority END AS occupation "
            "FROM patients LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER "
            "(PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) u ON u.o_custkey = patient_id",
        ),
        "quarantine_invalid": _with(
            UNNUMBERED,
            _wide("5 minutes"),
            _scored(),
            then="SELECT *, CASE WHEN patient_id IS NULL THEN 'rejected' ELSE 'valid' END AS status "
            "FROM scores",
        ),
        "apply_defaults": _with(
            PATIENTS,
            then="SELECT patient_id, full_name, sex, CAST(NULL AS VARCHAR) AS room_number, "
            "CAST(NULL AS DATE) AS date_of_birth, '' AS allergies, '' AS past_medical_conditions, "
            "CAST(NULL AS VARCHAR) AS medical_history, '' AS current_medications, "
            "CAST(NULL AS VARCHAR) AS home_address, CAST(NULL AS VARCHAR) AS occupation, "
            f"{AS_OF} AS updated_at FROM patients",
        ),
        "duplicate_keys": _with(
            READINGS,
            then="SELECT patient_id, vital_sign, count(*) AS n_rows FROM readings GROUP BY 1, 2 "
            "HAVING count(*) > 1",
        ),
        "cohort_dob": "SELECT CAST(c_custkey AS INTEGER) AS patient_id, c_name AS full_name, "
        "DATE '2024-01-31' - CAST((20 + c_custkey % 70) * 365 AS INTEGER) AS date_of_birth "
        "FROM customer",
        "cohort_replaced": "SELECT CAST(c_custkey AS INTEGER) AS patient_id, c_name AS full_name, "
        "DATE '2024-01-31' - CAST((20 + c_custkey % 70) * 365 AS INTEGER) AS date_of_birth "
        "FROM customer WHERE c_custkey % 3 = 0",
        "latest_scores": _with(*FIVE_MINUTES, NEWEST, then="SELECT * FROM newest"),
        "latest_scores_ranked": _with(*FIVE_MINUTES, NEWEST, then="SELECT * FROM newest"),
        "latest_in_range": _with(
            *FIVE_MINUTES, NEWEST,
            then="SELECT patient_id, news2_score, risk_level, window_start FROM newest "
            "WHERE patient_id BETWEEN 5 AND 75 ORDER BY patient_id",
        ),
        "last_six_hours": _with(
            *FIVE_MINUTES,
            then=f"SELECT * FROM scores WHERE window_start >= {AS_OF} - INTERVAL 6 HOUR",
        ),
        "vitals_history": _with(
            *FIVE_MINUTES,
            then=f"SELECT * REPLACE ({CELSIUS} AS temperature) FROM scores "
            "ORDER BY patient_id, window_start",
        ),
        "history_json": _with(
            *FIVE_MINUTES,
            then="SELECT CAST(json_object('patient_id', patient_id, 'window_start', "
            "strftime(window_start, '%Y-%m-%dT%H:%M:%S'), 'news2_score', news2_score, "
            "'risk_level', risk_level, 'heart_rate', heart_rate, 'respiratory_rate', "
            "respiratory_rate, 'spo2', spo2, 'systolic_bp', systolic_bp, 'temperature', "
            f"{CELSIUS}) AS VARCHAR) AS json FROM scores",
        ),
        "active_patients": _with(
            *FIVE_MINUTES, NEWEST, PATIENTS, ACTIVE, then="SELECT * FROM active ORDER BY patient_id"
        ),
        "ward_cards": _with(
            *FIVE_MINUTES, NEWEST, PATIENTS, ACTIVE,
            then="SELECT patient_id, coalesce(room_number, '—') AS room, "
            "CAST(news2_score AS VARCHAR) AS news2, risk_level AS risk, "
            "strftime(window_start, '%Y-%m-%d %H:%M:%S UTC') AS last_updated FROM active",
        ),
        "roster": _with(
            *FIVE_MINUTES, NEWEST, PATIENTS, ACTIVE,
            then="SELECT patient_id, full_name || ' (' || news2_score || ')' AS label, risk_level "
            "FROM active ORDER BY patient_id",
        ),
        "needs_review": _with(
            *MILD, NEWEST, then="SELECT * FROM newest WHERE risk_level <> 'LOW'"
        ),
        "patient_profile": _with(
            PATIENTS, PROFILES, then=f"SELECT {PATIENT_TEXTS}, found FROM profiles"
        ),
        "profile_json": _with(
            PATIENTS, PROFILES,
            then="""SELECT patient_id, CASE WHEN found THEN CAST(json_object(
  'patient_id', patient_id, 'full_name', full_name, 'room_number', room_number,
  'date_of_birth', strftime(date_of_birth, '%Y-%m-%d'), 'sex', sex, 'allergies', allergies,
  'past_medical_conditions', past_medical_conditions, 'medical_history', medical_history,
  'current_medications', current_medications, 'home_address', home_address,
  'occupation', occupation, 'updated_at', strftime(updated_at, '%Y-%m-%dT%H:%M:%S'),
  'found', found) AS VARCHAR)
  ELSE CAST(json_object('patient_id', patient_id, 'found', found) AS VARCHAR) END AS json
FROM profiles""",
        ),
        "patient_background": _with(
            PATIENTS,
            then="SELECT patient_id, full_name AS title, concat_ws(' · ', "
            "'Patient ID: ' || patient_id, 'Room: ' || room_number, "
            "'DOB: ' || strftime(date_of_birth, '%d %b %Y'), 'Sex: ' || sex) AS meta, "
            + ", ".join(_label(c) for c in EMPTY_LABELS)
            + " FROM patients",
        ),
        "patient_age": _with(
            PATIENTS, then=f"SELECT patient_id, CAST({AGE} AS INTEGER) AS age FROM patients"
        ),
        "patient_context": _with(
            PATIENTS, CONTEXTS,
            then="SELECT patient_id, context, "
            "regexp_matches(context, 'copd|asthma') AS has_airway_disease, "
            "regexp_matches(context, 'smok|pneumonia') AS has_lung_risk, "
            "regexp_matches(context, 'heart failure') AS has_heart_failure FROM contexts",
        ),
        "unpivot_vitals": _with(
            *DAILY,
            then=" UNION ALL ".join(
                f"SELECT patient_id, window_start, '{v}' AS vital_sign, {v} AS value FROM scores "
                f"WHERE {v} IS NOT NULL"
                for v in VITALS
            ),
        ),
        "vital_catalogue_join": _with(
            READINGS, CATALOGUE,
            then="SELECT r.*, c.vital_order, c.label, c.low, c.high, c.description "
            "FROM readings r JOIN catalogue c USING (vital_sign)",
        ),
        "trend": _with(
            *PERIOD, then="SELECT patient_id, vital_order, vital_sign, trend FROM trended"
        ),
        "vital_coverage": _with(
            *PERIOD,
            then="SELECT patient_id, vital_order, vital_sign, n_values, "
            "CASE n_values WHEN 0 THEN 'No data' END AS status FROM trended",
        ),
        "axis_domain": _with(
            *PERIOD,
            then="SELECT patient_id, vital_order, vital_sign, y_min, y_max FROM trended "
            "WHERE n_values > 0",
        ),
        "assessments": _with(
            *EXPLAINED,
            then="SELECT patient_id, vital_order, vital_sign, label, last_value AS value, score, "
            "severity, problem, detail, trend, causes FROM explained",
        ),
        "abnormal_vitals": _with(
            *EXPLAINED,
            then="SELECT patient_id, vital_sign, last_value AS value, score, severity, problem "
            "FROM assessed WHERE score > 0",
        ),
        "abnormal_summary": _with(
            *EXPLAINED,
            then="SELECT patient_id, abnormal, n_abnormal, n_abnormal >= 3 AS multi_system, fever, "
            "hypoxia FROM flags",
        ),
        "likely_causes": _with(
            *EXPLAINED, then="SELECT patient_id, vital_sign, score, causes FROM explained"
        ),
        "vital_cards": _with(
            *EXPLAINED,
            then="SELECT t.patient_id, t.vital_order, t.vital_sign, t.description, t.label, "
            "CASE WHEN t.n_values = 0 THEN 'No data' WHEN t.last_value IS NULL THEN 'nan' "
            "WHEN t.vital_sign = 'temperature' THEN printf('%.2f', t.last_value) "
            "ELSE printf('%.1f', t.last_value) END AS value_text, a.trend, "
            "CASE WHEN t.n_values > 0 THEN coalesce(a.severity, 'normal') END AS severity, "
            "t.y_min, t.y_max, a.causes, CASE WHEN t.last_value IS NOT NULL "
            "THEN coalesce(a.problem, 'Within normal range') END AS status, "
            "strftime(n.window_start, '%Y-%m-%d %H:%M:%S UTC') AS last_updated "
            "FROM trended t LEFT JOIN explained a USING (patient_id, vital_sign) "
            "JOIN numbered n ON n.patient_id = t.patient_id AND n.from_end = 1",
        ),
        "split_problem": _with(
            *EXPLAINED,
            then="SELECT patient_id, vital_sign, split_part(problem, ' — ', 1) AS medical, "
            "split_part(problem, ' — ', 2) AS plain FROM assessed WHERE score > 0",
        ),
        "unique_causes": _with(*REPORTS, then="SELECT patient_id, causes FROM narrated"),
        "medical_narrative": _with(
            *REPORTS,
            then="SELECT patient_id, opening || coalesce(chr(10) || 'Likely contributing factors:' "
            "|| chr(10) || bullets, '') AS narrative FROM narrated",
        ),
        "plain_english": _with(
            *REPORTS,
            then="SELECT patient_id, coalesce(plain_english, '') AS plain_english FROM narrated",
        ),
        "active_problems": _with(
            *REPORTS,
            then="SELECT patient_id, news2_score, risk_level, "
            "CAST(coalesce(n_problems, 0) AS INTEGER) AS n_problems, "
            f"CASE WHEN n_problems IS NULL THEN {_sql(NO_PROBLEMS_TEXT)} "
            "ELSE 'Active Problem (NEWS2 ' || news2_score || ' — ' || risk_level || ')' END "
            "AS heading, opening AS medical, causes, plain_english FROM narrated",
        ),
        "vitals_text_lines": _with(
            *FIVE_MINUTES, TEXT_LINES, then="SELECT patient_id, window_start, line FROM lines"
        ),
        "vitals_text_table": _with(
            *DAILY, TEXT_LINES, TEXT_TABLES, then="SELECT * FROM text_tables"
        ),
        "clinical_prompts": _with(
            *DAILY, TEXT_LINES, TEXT_TABLES, PATIENTS,
            then=f"{PROMPT} FROM patients LEFT JOIN text_tables USING (patient_id)",
        ),
        "review_prompts": _with(
            *MILD, TEXT_LINES, TEXT_TABLES, PATIENTS,
            then=f"{PROMPT} FROM patients JOIN text_tables USING (patient_id) "
            "WHERE risk_level <> 'LOW'",
        ),
        "scenario_check": _with(
            *MILD, NEWEST, EXPECTATIONS, SCENARIOS, then="SELECT * FROM checked"
        ),
        "missing_scores": _with(
            EXPECTATIONS,
            then="SELECT patient_id, scenario FROM expectations "
            "WHERE patient_id NOT IN (SELECT user_id FROM events)",
        ),
        "scenario_check_summary": _with(
            *MILD, NEWEST, EXPECTATIONS, SCENARIOS,
            then="SELECT count(*) AS n_checks, count(*) FILTER (WHERE verdict = 'FAIL') "
            "AS n_failures FROM checked",
        ),
    }
