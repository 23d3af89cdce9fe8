"""Reference SQL for each registered query, for DuckDB on the same files.

The statements are written the long way round on purpose: point-in-interval
joins, islands by running sums, at-risk segments by ``lag``. They share no
logic with the Spark operators they check.
"""

from __future__ import annotations

import re
from itertools import combinations

from spanwise.config import (
    AGE_BANDS,
    DATE_FIELDS,
    DENOMINATOR_BANDS,
    DENOMINATOR_SEXES,
    MODE_LABELS,
    NUMERIC_ESTIMATES,
    NUMERIC_VARIABLES,
    PERSISTENCE_RULES,
    RECORD_TABLES,
    mode_name,
)
from spanwise.functions.dates import band_label

from spanwise.sources.fixtures import FIXTURE_FIELDS, STUDY, VIEWS

CUT = f"DATE '{STUDY.data_end_date}'"
FIELDS = {**DATE_FIELDS, **FIXTURE_FIELDS}
CTES: dict[str, str] = dict(VIEWS)


def define(name: str, select: str) -> None:
    CTES[name] = select


def query(select: str) -> str:
    """``select`` with every table expression it needs, in order, in front."""
    needed, todo = set(), [select]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    parts = [f"{n} AS ({CTES[n].strip()})" for n in CTES if n in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select.strip()


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# Records.
define(
    "recs",
    union(
        f"SELECT person_id, '{t}' AS domain, CAST({FIELDS[t][0]} AS DATE) AS start_date,"
        f" CAST({FIELDS[t][1]} AS DATE) AS end_date FROM {t}"
        for t in RECORD_TABLES
    ),
)
define(
    "repaired",
    """SELECT person_id, domain, start_date,
              CASE WHEN end_date IS NULL OR end_date < start_date THEN start_date
                   ELSE end_date END AS end_date
       FROM recs""",
)
define(
    "person_span",
    """SELECT person_id, min(start_date) AS start_date, max(end_date) AS end_date
       FROM recs GROUP BY person_id""",
)
define(
    "first_death",
    "SELECT person_id, min(death_date) AS died FROM death GROUP BY person_id",
)
define(
    "attrs",
    """SELECT person_id,
              CASE gender_concept_id WHEN 8532 THEN 'Female' WHEN 8507 THEN 'Male'
                   ELSE 'None' END AS sex,
              make_date(CAST(year_of_birth AS BIGINT),
                        CAST(coalesce(month_of_birth, 1) AS BIGINT),
                        CAST(coalesce(day_of_birth, 1) AS BIGINT)) AS dob
       FROM person""",
)


def eras(source: str, keys: str, gap: int) -> str:
    return f"""
        SELECT {keys}, min(start_date) AS start_date, max(end_date) AS end_date FROM (
          SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start_date, end_date
                                     ROWS UNBOUNDED PRECEDING) AS era FROM (
            SELECT *, CASE WHEN start_date <= max(end_date) OVER (
                        PARTITION BY {keys} ORDER BY start_date, end_date
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}
                      THEN 0 ELSE 1 END AS opens
            FROM {source}))
        GROUP BY {keys}, era"""


def censored(source: str) -> str:
    return f"""
        SELECT person_id, start_date, end_date FROM (
          SELECT person_id, start_date,
                 CASE WHEN end_1 IS NULL THEN NULL WHEN end_1 <= {CUT} THEN end_1
                      ELSE {CUT} END AS end_date FROM (
            SELECT s.person_id, s.start_date,
                   CASE WHEN d.died IS NULL THEN s.end_date
                        WHEN d.died <= s.end_date THEN d.died
                        ELSE s.end_date END AS end_1
            FROM {source} s LEFT JOIN first_death d ON s.person_id = d.person_id))
        WHERE start_date <= end_date"""


# Period definitions.
define("base_eras", eras("repaired", "person_id", 0))
define(
    "extract_raw",
    f"""SELECT s.person_id, s.start_date,
               CAST(a.dob + INTERVAL {STUDY.censor_age} YEAR AS DATE) AS end_date
        FROM person_span s JOIN attrs a ON s.person_id = a.person_id""",
)
define("min_extract", censored("extract_raw"))
define("min_max", censored("person_span"))
define(
    "stays",
    """SELECT person_id, visit_start_date AS start_date,
              CASE WHEN visit_end_date IS NULL OR visit_end_date < visit_start_date
                   THEN visit_start_date ELSE visit_end_date END AS end_date
       FROM visit_occurrence WHERE visit_concept_id IN (9201, 262)""",
)
define("impatient", eras("stays", "person_id", 0))
define(
    "original_data",
    """SELECT person_id, observation_period_start_date AS start_date,
              observation_period_end_date AS end_date,
              observation_period_id AS period_id
       FROM observation_period""",
)
for days, tail in PERSISTENCE_RULES:
    label = mode_name(days, tail)
    if tail:
        # The long way: extend every base era, then merge what touches.
        define(
            f"extended_{days}",
            f"SELECT person_id, start_date, end_date + {days} AS end_date FROM base_eras",
        )
        define(f"merged_{label}", eras(f"extended_{days}", "person_id", 0))
    else:
        define(f"merged_{label}", eras("base_eras", "person_id", days))
    define(label, censored(f"merged_{label}"))
define(
    "all_periods",
    union(
        f"SELECT '{m}' AS mode, person_id, start_date, end_date, "
        + ("period_id" if m == "original_data" else "CAST(NULL AS BIGINT) AS period_id")
        + f" FROM {m}"
        for m in MODE_LABELS
    ),
)


def age(date: str) -> str:
    """Birthdays reached: calendar years apart, less one if this year's is still to come.

    Somebody born on 29 February is a year older on 1 March of other years.
    """
    years = f"date_diff('year', dob, {date})"
    birthday = f"CASE WHEN month(dob) = 2 AND day(dob) = 29 THEN dob + 1 + to_years(CAST({years} AS INT)) ELSE dob + to_years(CAST({years} AS INT)) END"
    leap = f"month({date}) = 2 AND day({date}) = 29 AND month(dob) = 2 AND day(dob) = 29"
    return f"CAST({years} - CASE WHEN {birthday} > {date} AND NOT ({leap}) THEN 1 ELSE 0 END AS INT)"


def band(value: str) -> str:
    whens = " ".join(
        f"WHEN {value} >= {low} "
        + ("" if high is None else f"AND {value} <= {high} ")
        + f"THEN '{band_label((low, high))}'"
        for low, high in AGE_BANDS
    )
    return f"CASE {whens} ELSE 'None' END"


# Person-time by year.
define(
    "period_years",
    f"""SELECT mode, yr, sex, days, {band("age_then")} AS age_group FROM (
          SELECT mode, yr, sex, dob, last_day - first_day + 1 AS days,
                 {age("first_day")} AS age_then FROM (
            SELECT mode, yr, coalesce(sex, 'None') AS sex, dob,
                   CASE WHEN start_date < make_date(yr, 1, 1) THEN make_date(yr, 1, 1)
                        ELSE start_date END AS first_day,
                   CASE WHEN end_date > make_date(yr, 12, 31) THEN make_date(yr, 12, 31)
                        ELSE end_date END AS last_day
            FROM (SELECT p.*, a.sex, a.dob,
                         unnest(range(year(start_date), year(end_date) + 1)) AS yr
                  FROM all_periods p LEFT JOIN attrs a ON p.person_id = a.person_id)))""",
)
define(
    "mode_totals",
    """SELECT mode, count(*) AS all_records,
              sum(end_date - start_date + 1) AS all_days
       FROM all_periods GROUP BY mode""",
)
define(
    "in_obs",
    """SELECT c.mode, CAST(yr AS INT) AS year, coalesce(sex, 'overall') AS sex,
              coalesce(age_group, 'overall') AS age_group,
              CAST(n AS BIGINT) AS records, CAST(d AS BIGINT) AS person_days,
              100.0 * n / all_records AS records_percentage,
              100.0 * d / all_days AS person_days_percentage
       FROM (SELECT mode, yr, sex, age_group, count(*) AS n, sum(days) AS d
             FROM period_years
             GROUP BY GROUPING SETS ((mode, yr, sex, age_group), (mode, yr, sex),
                                     (mode, yr, age_group), (mode, yr))) c
       JOIN mode_totals t ON c.mode = t.mode""",
)

# Features.
for what, table, column in (
    ("drugs", "drug_exposure", "drug_exposure_start_date"),
    ("conditions", "condition_occurrence", "condition_start_date"),
    ("visits", "visit_occurrence", "visit_start_date"),
):
    define(
        f"inside_{what}",
        f"""SELECT p.mode, p.person_id, p.start_date, p.end_date, p.period_id,
                   count(*) AS n
            FROM all_periods p JOIN {table} r ON p.person_id = r.person_id
             AND r.{column} BETWEEN p.start_date AND p.end_date
            GROUP BY ALL""",
    )
SAME = " AND ".join(
    f"x.{c} IS NOT DISTINCT FROM p.{c}"
    for c in ("mode", "person_id", "start_date", "end_date", "period_id")
)
define(
    "counted",
    "SELECT p.*, d.n AS number_drugs, c.n AS number_conditions, v.n AS number_visits"
    " FROM all_periods p"
    + "".join(
        f" LEFT JOIN inside_{t} {a} ON {SAME.replace('x.', a + '.')}"
        for a, t in (("d", "drugs"), ("c", "conditions"), ("v", "visits"))
    ),
)
define(
    "feats",
    f"""SELECT mode, person_id, start_date, end_date, period_id,
               end_date - start_date + 1 AS duration,
               coming - start_date AS time_to_next_observation,
               coming - end_date AS gap_to_next,
               age_start, age_end, {band("age_start")} AS age_group_start,
               {band("age_end")} AS age_group_end, sex,
               number_drugs, number_conditions, number_visits,
               number_drugs / (end_date - start_date + 1.0) AS drugs_per_day,
               number_conditions / (end_date - start_date + 1.0) AS conditions_per_day,
               number_visits / (end_date - start_date + 1.0) AS visits_per_day
        FROM (SELECT c.*, coalesce(a.sex, 'None') AS sex,
                     {age("start_date")} AS age_start, {age("end_date")} AS age_end,
                     lead(start_date) OVER (PARTITION BY mode, c.person_id
                       ORDER BY start_date, end_date, period_id) AS coming
              FROM counted c LEFT JOIN attrs a ON c.person_id = a.person_id)""",
)


def numeric(source: str, variables) -> str:
    return union(
        f"""SELECT mode, '{v}' AS variable,
              quantile_cont(CAST({v} AS DOUBLE), 0.5) AS median,
              quantile_cont(CAST({v} AS DOUBLE), 0.25) AS q25,
              quantile_cont(CAST({v} AS DOUBLE), 0.75) AS q75,
              CAST(min({v}) AS DOUBLE) AS min, CAST(max({v}) AS DOUBLE) AS max,
              avg(CAST({v} AS DOUBLE)) AS mean,
              stddev_samp(CAST({v} AS DOUBLE)) AS sd
            FROM {source} WHERE {v} IS NOT NULL GROUP BY mode"""
        for v in variables
    )


define("num_summary", numeric("feats", NUMERIC_VARIABLES))
define(
    "cat_summary",
    """SELECT f.mode, variable, level, count(*) AS count,
              100.0 * count(*) / any_value(total) AS percentage
       FROM ("""
    + union(
        f"SELECT mode, '{v}' AS variable, {v} AS level FROM feats"
        for v in ("sex", "age_group_start", "age_group_end")
    )
    + """) f JOIN (SELECT mode, count(*) AS total FROM feats GROUP BY mode) t
       ON f.mode = t.mode GROUP BY f.mode, variable, level""",
)
define(
    "sizes",
    """SELECT mode, count(*) AS number_records,
              count(DISTINCT person_id) AS number_subjects
       FROM all_periods GROUP BY mode""",
)
define(
    "per_person",
    """SELECT mode, p.person_id, count(*) AS op_per_person
       FROM all_periods p JOIN person USING (person_id) GROUP BY mode, p.person_id""",
)
define("per_person_summary", numeric("per_person", ["op_per_person"]))

# Cohorts.
NAMES = ", ".join(f"'{n}'" for n in STUDY.ingredients)
define(
    "codelist",
    f"""SELECT DISTINCT c.concept_name AS codelist_name,
               a.descendant_concept_id AS concept_id
        FROM concept c JOIN concept_ancestor a ON c.concept_id = a.ancestor_concept_id
        WHERE c.concept_class_id = 'Ingredient' AND lower(c.concept_name) IN ({NAMES})""",
)
define(
    "exposures",
    """SELECT codelist_name AS outcome, d.person_id,
              drug_exposure_start_date AS start_date,
              CASE WHEN drug_exposure_end_date IS NULL
                     OR drug_exposure_end_date < drug_exposure_start_date
                   THEN drug_exposure_start_date
                   ELSE drug_exposure_end_date END AS end_date
       FROM drug_exposure d JOIN codelist c ON d.drug_concept_id = c.concept_id
       WHERE EXISTS (SELECT 1 FROM observation_period o
                     WHERE o.person_id = d.person_id AND d.drug_exposure_start_date
                       BETWEEN o.observation_period_start_date
                           AND o.observation_period_end_date)""",
)
define("outcomes", eras("exposures", "outcome, person_id", STUDY.drug_gap_era))
BANDS = ", ".join(
    f"({i}, '{band_label(b)}', {b[0]}, {b[1]})" for i, b in enumerate(DENOMINATOR_BANDS)
)
SEXES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(DENOMINATOR_SEXES, 1))
define(
    "followed",
    f"""SELECT mode, person_id, sex, age_group, band_no, entry, leave FROM (
          SELECT mode, p.person_id, sex, age_group, band_no,
                 greatest(start_date + {STUDY.days_prior}, DATE '{STUDY.study_start}',
                          CAST(dob + to_years(low) AS DATE)) AS entry,
                 least(end_date, CAST(dob + to_years(high + 1) AS DATE) - 1) AS leave
          FROM all_periods p JOIN attrs a ON p.person_id = a.person_id
          CROSS JOIN (VALUES {BANDS}) b(band_no, age_group, low, high)
          WHERE dob IS NOT NULL)
        WHERE entry <= leave""",
)
define(
    "cohorts",
    f"""SELECT mode, band_no * 3 + sex_no AS cohort_definition_id, person_id, age_group,
               s.sex, entry, leave
        FROM followed f JOIN (VALUES {SEXES}) s(sex_no, sex)
          ON s.sex = 'Both' OR s.sex = f.sex""",
)

# Incidence: segments at risk between outcomes, cut to follow-up and interval.
define(
    "outcome_names",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{n}')" for n in STUDY.ingredients)
    + ") o(outcome)",
)


def segments(source: str, washout: int) -> str:
    return f"""
        SELECT outcome, person_id,
               coalesce(lag(end_date) OVER w + {washout + 1}, DATE '0001-01-01') AS since,
               start_date AS until, start_date AS event
        FROM {source} WINDOW w AS (PARTITION BY outcome, person_id ORDER BY start_date)
        UNION ALL
        SELECT outcome, person_id, max(end_date) + {washout + 1}, DATE '9999-12-31', NULL
        FROM {source} GROUP BY outcome, person_id
        UNION ALL
        SELECT outcome, person_id, DATE '0001-01-01', DATE '9999-12-31', NULL
        FROM (SELECT outcome, person_id FROM outcome_names CROSS JOIN attrs
              EXCEPT SELECT outcome, person_id FROM {source})"""


define("washed", eras("outcomes", "outcome, person_id", STUDY.washout))
define("segs", segments("washed", STUDY.washout))
define(
    "first_segs",
    """SELECT outcome, person_id, DATE '0001-01-01' AS since,
              min(start_date) AS until, min(start_date) AS event
       FROM outcomes GROUP BY outcome, person_id
       UNION ALL
       SELECT outcome, person_id, DATE '0001-01-01', DATE '9999-12-31', NULL
       FROM (SELECT outcome, person_id FROM outcome_names CROSS JOIN attrs
             EXCEPT SELECT outcome, person_id FROM outcomes)""",
)


def at_risk(source: str) -> str:
    return f"""
        SELECT f.mode, f.person_id, f.sex, f.age_group, s.outcome, s.event,
               greatest(f.entry, s.since) AS a, least(f.leave, s.until) AS b
        FROM followed f JOIN {source} s ON f.person_id = s.person_id
         AND f.entry <= s.until AND s.since <= f.leave"""


def by_interval(source: str, start: str, end: str, event: str) -> str:
    """Rows cut to calendar years, and the uncut rows as ``overall``."""
    others = "mode, person_id, sex, age_group" + (", outcome" if event else "")
    event = f", {event}" if event else ""
    return f"""
        SELECT {others}, 'years' AS analysis_interval, yr,
               greatest({start}, make_date(yr, 1, 1)) AS a,
               least({end}, make_date(yr, 12, 31)) AS b{event}
        FROM (SELECT *, unnest(range(year({start}), year({end}) + 1)) AS yr FROM {source})
        UNION ALL
        SELECT {others}, 'overall', NULL, {start}, {end}{event} FROM {source}"""


def rates(risk: str) -> str:
    """Counts of every stratum and outcome; zero where nobody is at risk."""
    return f"""
        SELECT t.mode, o.outcome, t.sex, t.age_group, t.analysis_interval,
               CAST(t.yr AS INT) AS year, t.opened, t.closed,
               coalesce(denominator_count, 0) AS denominator_count,
               coalesce(outcome_count, 0) AS outcome_count,
               CAST(coalesce(days, 0) AS BIGINT) AS person_days,
               coalesce(days, 0) / 365.25 AS person_years
        FROM strata t CROSS JOIN outcome_names o LEFT JOIN (
          SELECT mode, outcome, x.sex, age_group, analysis_interval, yr,
                 count(DISTINCT person_id) AS denominator_count,
                 count(CASE WHEN event BETWEEN a AND b THEN 1 END) AS outcome_count,
                 sum(b - a + 1) AS days
          FROM ({by_interval(risk, "a", "b", "event")}) r
          JOIN (VALUES {SEXES}) x(sex_no, sex) ON x.sex = 'Both' OR x.sex = r.sex
          GROUP BY ALL) c
        ON t.mode = c.mode AND o.outcome = c.outcome AND t.sex = c.sex
           AND t.age_group = c.age_group AND t.analysis_interval = c.analysis_interval
           AND t.yr IS NOT DISTINCT FROM c.yr"""


define(
    "strata",
    f"""SELECT mode, x.sex, age_group, analysis_interval, yr,
               CASE analysis_interval WHEN 'years' THEN make_date(yr, 1, 1)
                    ELSE min(a) END AS opened,
               CASE analysis_interval WHEN 'years' THEN make_date(yr, 12, 31)
                    ELSE max(b) END AS closed
        FROM ({by_interval("followed", "entry", "leave", "")}) r
        JOIN (VALUES {SEXES}) x(sex_no, sex) ON x.sex = 'Both' OR x.sex = r.sex
        GROUP BY mode, x.sex, age_group, analysis_interval, yr""",
)
define("risk", at_risk("segs"))
define("first_risk", at_risk("first_segs"))
define("inc", rates("risk"))
define("inc_first", rates("first_risk"))
define(
    "covered",
    "SELECT mode, min(entry) AS opens, max(leave) AS closes FROM followed GROUP BY mode",
)

# Exact Poisson limits by bisection: the mean at which P(X <= k) is p.
define(
    "counts",
    "SELECT DISTINCT outcome_count AS n FROM inc",
)
define(
    "bisected",
    """SELECT n, n AS k, 0.025 AS p, 'upper' AS side, 0.0::DOUBLE AS lo,
              (n + 12 * sqrt(n + 1) + 50)::DOUBLE AS hi, 0 AS step FROM counts
       UNION ALL
       SELECT n, n - 1, 0.975, 'lower', 0.0, n + 12 * sqrt(n) + 50, 0
       FROM counts WHERE n > 0
       UNION ALL
       SELECT n, k, p, side, CASE WHEN below > p THEN (lo + hi) / 2 ELSE lo END,
              CASE WHEN below > p THEN hi ELSE (lo + hi) / 2 END, step + 1
       FROM (SELECT *, list_sum(list_transform(range(0, k + 1), lambda x:
                 exp(x * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(x + 1)))) AS below
             FROM bisected WHERE step < 70)""",
)
define(
    "limits",
    """SELECT n, coalesce(max(CASE WHEN side = 'lower' THEN (lo + hi) / 2 END), 0.0) AS low,
              max(CASE WHEN side = 'upper' THEN (lo + hi) / 2 END) AS high
       FROM bisected WHERE step = 70 GROUP BY n""",
)
define(
    "inc_rates",
    """SELECT i.*, outcome_count * 100000.0 / nullif(person_years, 0) AS rate,
              low * 100000.0 / nullif(person_years, 0) AS rate_low,
              high * 100000.0 / nullif(person_years, 0) AS rate_high
       FROM inc i JOIN limits l ON i.outcome_count = l.n""",
)

# The long result: one settings id per analysis and mode, in the order of binding.
MODES = list(MODE_LABELS)
COHORTS = [(band_label(b), s) for b in DENOMINATOR_BANDS for s in DENOMINATOR_SEXES]


def _settings_values() -> str:
    rows = [("summarise_omop_snapshot", None, None, None)]
    rows += [("summarise_in_observation", m, None, None) for m in MODES]
    rows += [("incidence", m, a, s) for m in MODES for a, s in COHORTS]
    rows += [("summarise_table", m, None, None) for m in MODES]
    rows += [("summarise_table", m, "1", None) for m in MODES]
    quoted = [
        ", ".join("NULL" if v is None else f"'{v}'" for v in row) for row in rows
    ]
    return ", ".join(f"({i}, {q})" for i, q in enumerate(quoted, 1))


define(
    "sets",
    f"""SELECT CAST(id AS INT) AS result_id, result_type, mode,
               CASE WHEN result_type = 'incidence' THEN a END AS age_group,
               sex, result_type = 'summarise_table' AND a IS NOT NULL AS per_person
        FROM (VALUES {_settings_values()}) v(id, result_type, mode, a, sex)""",
)


def long_select(source, ident, variable, name, kind, value, **other) -> str:
    """One estimate as long rows; numbers in ``num`` and other values in ``txt``."""
    number = kind in ("integer", "numeric", "percentage")
    columns = {
        "result_id": ident,
        "cdm_name": f"'{STUDY.cdm_name}'",
        "group_name": "'overall'",
        "group_level": "'overall'",
        "strata_name": "'overall'",
        "strata_level": "'overall'",
        "variable_name": variable,
        "variable_level": "CAST(NULL AS VARCHAR)",
        "estimate_name": f"'{name}'",
        "estimate_type": f"'{kind}'",
        "num": f"CAST({value} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)",
        "txt": "CAST(NULL AS VARCHAR)" if number else f"CAST({value} AS VARCHAR)",
        "additional_name": "'overall'",
        "additional_level": "'overall'",
        **other,
    }
    shown = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"SELECT {shown} FROM {source}"


def with_set(source: str, kind: str, on: str = "x.mode = s.mode") -> str:
    return f"{source} x JOIN sets s ON s.result_type = '{kind}' AND {on}"


define(
    "snap",
    """SELECT * FROM (SELECT count(*) AS person_count FROM person)
       CROSS JOIN (SELECT count(*) AS observation_period_count,
                          min(observation_period_start_date) AS first_start_date,
                          max(observation_period_end_date) AS last_end_date
                   FROM observation_period)""",
)
define(
    "long_snapshot",
    union(
        long_select("snap", "CAST(1 AS INT)", f"'{v}'", n, k, c)
        for v, n, k, c in (
            ("person", "count", "integer", "person_count"),
            ("observation_period", "count", "integer", "observation_period_count"),
            ("observation_period", "start_date", "date", "first_start_date"),
            ("observation_period", "end_date", "date", "last_end_date"),
            ("cdm", "source_name", "character", "NULL"),
            ("cdm", "version", "character", "NULL"),
        )
    ),
)


def told(names) -> dict[str, str]:
    """Name and level of the strata columns that are not overall."""
    name = " || ' &&& ' || ".join(f"'{n}'" for n in names)
    level = " || ' &&& ' || ".join(f"x.{n}" for n in names)
    one, two = names
    return {
        "strata_name": f"""CASE WHEN x.{one} <> 'overall' AND x.{two} <> 'overall'
            THEN {name} WHEN x.{one} <> 'overall' THEN '{one}'
            WHEN x.{two} <> 'overall' THEN '{two}' ELSE 'overall' END""",
        "strata_level": f"""CASE WHEN x.{one} <> 'overall' AND x.{two} <> 'overall'
            THEN {level} WHEN x.{one} <> 'overall' THEN x.{one} ELSE x.{two} END""",
    }


define(
    "long_in_obs",
    union(
        long_select(
            with_set("in_obs", "summarise_in_observation"),
            "s.result_id",
            f"'{label}'",
            name,
            kind,
            f"x.{column}",
            group_name="'omop_table'",
            group_level="'observation_period'",
            additional_name="'time_interval &&& interval'",
            additional_level="x.year || '-01-01 to ' || x.year || '-12-31 &&& years'",
            **told(("sex", "age_group")),
        )
        for label, name, kind, column in (
            ("Number records in observation", "count", "integer", "records"),
            (
                "Number records in observation",
                "percentage",
                "percentage",
                "records_percentage",
            ),
            ("Number person-days", "count", "integer", "person_days"),
            ("Number person-days", "percentage", "percentage", "person_days_percentage"),
        )
    ),
)
RATE = "incidence_100000_pys"
define(
    "long_incidence",
    union(
        long_select(
            with_set(
                "inc_rates",
                "incidence",
                "x.mode = s.mode AND x.age_group = s.age_group AND x.sex = s.sex",
            ),
            "s.result_id",
            f"'{variable}'",
            name,
            kind,
            f"x.{column}",
            group_name="'denominator_cohort_name &&& outcome_cohort_name'",
            group_level="'denominator_' || lower(x.sex) || '_' ||"
            " replace(x.age_group, ' ', '_') || ' &&& ' || x.outcome",
            additional_name="'incidence_start_date &&& incidence_end_date' ||"
            " CASE x.analysis_interval WHEN 'years' THEN ' &&& analysis_interval'"
            " ELSE '' END",
            additional_level="CAST(x.opened AS VARCHAR) || ' &&& ' ||"
            " CAST(x.closed AS VARCHAR) || CASE x.analysis_interval"
            " WHEN 'years' THEN ' &&& years' ELSE '' END",
        )
        for variable, name, kind, column in (
            ("Denominator", "denominator_count", "integer", "denominator_count"),
            ("Denominator", "person_days", "numeric", "person_days"),
            ("Denominator", "person_years", "numeric", "person_years"),
            ("Outcome", "outcome_count", "integer", "outcome_count"),
            ("Outcome", RATE, "numeric", "rate"),
            ("Outcome", f"{RATE}_95CI_lower", "numeric", "rate_low"),
            ("Outcome", f"{RATE}_95CI_upper", "numeric", "rate_high"),
        )
    ),
)
OWN = "x.mode = s.mode AND NOT s.per_person"
define(
    "long_periods",
    union(
        [
            *(
                long_select(
                    with_set("sizes", "summarise_table", OWN),
                    "s.result_id",
                    f"'number {w}'",
                    "count",
                    "integer",
                    f"x.number_{w}",
                )
                for w in ("records", "subjects")
            ),
            *(
                long_select(
                    with_set("num_summary", "summarise_table", OWN),
                    "s.result_id",
                    "x.variable",
                    e,
                    "numeric",
                    f"x.{e}",
                )
                for e in NUMERIC_ESTIMATES
            ),
            *(
                long_select(
                    with_set("cat_summary", "summarise_table", OWN),
                    "s.result_id",
                    "x.variable",
                    name,
                    kind,
                    f"x.{name}",
                    variable_level="x.level",
                )
                for name, kind in (("count", "integer"), ("percentage", "percentage"))
            ),
        ]
    ),
)
define(
    "long_per_person",
    union(
        long_select(
            with_set(
                "per_person_summary", "summarise_table", "x.mode = s.mode AND s.per_person"
            ),
            "s.result_id",
            "x.variable",
            e,
            "numeric",
            f"x.{e}",
        )
        for e in NUMERIC_ESTIMATES
    ),
)


def boxed(name: str, cells: str, dims: str, totals: bool = True) -> None:
    """Table ``name``: seeds, hidden places, and all corners of the cheapest box of each seed.

    ``cells`` has family, layer, x, y, z, v, seed and hid; '' is the coordinate of a
    total. Every corner is a join; the boxes of a seed are ranked by what they hide.
    """
    subsets = [c for n in range(1, len(dims) + 1) for c in combinations(dims, n)]
    place = ("family", "layer", "x", "y", "z")
    joins, cost, up, down = [], [], [], ["s.v >= 2"]
    for subset in subsets:
        a = "c" + "".join(subset)
        on = [f"{a}.family = s.family", f"{a}.layer = s.layer", f"{a}.v > 0"]
        for d in "xyz":
            if subset == (d,):
                on.append(f"{a}.{d} <> s.{d}")
            else:
                on.append(f"{a}.{d} = {'c' + d if d in subset else 's'}.{d}")
        joins.append(f"JOIN cells_{name} {a} ON {' AND '.join(on)}")
        cost.append(f"CASE WHEN {a}.seed OR {a}.hid THEN 0 ELSE {a}.v END")
        signs = [f"CASE WHEN s.{d} = '' OR c{d}.{d} = '' THEN 1 ELSE -1 END" if totals else "-1" for d in subset]
        sign = " * ".join(f"({x})" for x in signs)
        up.append(f"({sign} > 0 OR {a}.v >= 2)")
        down.append(f"({sign} < 0 OR {a}.v >= 2)")
    partner = {d: f"c{d}.{d}" if d in dims else f"s.{d}" for d in "xyz"}
    define(f"cells_{name}", cells)
    define(
        f"chosen_{name}",
        f"""SELECT {", ".join(f"s.{c}" for c in place)}, {", ".join(f"{v} AS {d}2" for d, v in partner.items())}
            FROM (SELECT * FROM cells_{name} WHERE seed) s {" ".join(joins)}
            WHERE ({" AND ".join(up)}) OR ({" AND ".join(down)})
            QUALIFY row_number() OVER (PARTITION BY {", ".join(f"s.{c}" for c in place)}
                ORDER BY {" + ".join(cost)}, {", ".join(partner.values())}) = 1""",
    )
    corners = [
        f"SELECT family, layer, {', '.join(d + '2' if d in subset else d for d in 'xyz')} FROM chosen_{name}"
        for subset in subsets
    ]
    define(name, f"SELECT {', '.join(place)} FROM cells_{name} WHERE seed OR hid UNION " + " UNION ".join(corners))


K = STUDY.min_cell_count
IN_OBS = """SELECT mode AS family, CAST(year AS VARCHAR) AS layer, replace(sex, 'overall', '') AS x,
    replace(age_group, 'overall', '') AS y, '' AS z, records AS v, FALSE AS hid, {seed} AS seed FROM in_obs"""
boxed("first_in_obs", IN_OBS.format(seed=f"records > 0 AND records < {K}"), "xy")
# A definition with a single hidden year has the smallest other one hidden as well.
define(
    "second_year",
    """SELECT family, min_by(layer, (v, layer)) AS layer FROM cells_first_in_obs c
       WHERE x = '' AND y = '' AND v > 0
         AND family IN (SELECT family FROM first_in_obs WHERE x = '' AND y = '' GROUP BY family HAVING count(*) = 1)
         AND (family, layer) NOT IN (SELECT (family, layer) FROM first_in_obs WHERE x = '' AND y = '')
       GROUP BY family""",
)
boxed(
    "gone_in_obs",
    IN_OBS.format(
        seed=f"""(records > 0 AND records < {K}) OR (sex = 'overall' AND age_group = 'overall'
            AND (mode, CAST(year AS VARCHAR)) IN (SELECT (family, layer) FROM second_year))"""
    ),
    "xy",
)
AT_RISK = f"""mode AS family, CASE WHEN sex = '{DENOMINATOR_SEXES[0]}' THEN '' ELSE sex END AS x,
    CASE WHEN age_group = '{band_label(DENOMINATOR_BANDS[0])}' THEN '' ELSE age_group END AS y,
    CASE WHEN analysis_interval = 'years' THEN CAST(opened AS VARCHAR) ELSE '' END AS z"""
boxed(
    "gone_at_risk",
    f"""SELECT {AT_RISK}, '' AS layer, min(nullif(denominator_count, 0)) AS v, FALSE AS hid,
            coalesce(min(nullif(denominator_count, 0)) < {K}, FALSE) AS seed FROM inc GROUP BY ALL""",
    "xyz",
)
boxed(
    "gone_outcomes",
    f"""SELECT i.* EXCLUDE (v), v, g.family IS NOT NULL AS hid,
               v > 0 AND (v < {K} OR g.family IS NOT NULL) AS seed
        FROM (SELECT {AT_RISK}, outcome AS layer, outcome_count AS v FROM inc) i
        LEFT JOIN gone_at_risk g ON (g.family, g.x, g.y, g.z) = (i.family, i.x, i.y, i.z)""",
    "xyz",
)
boxed(
    "gone_levels",
    f"""SELECT mode AS family, variable AS layer, level AS x, '' AS y, '' AS z, count AS v, FALSE AS hid,
               count > 0 AND count < {K} AS seed FROM cat_summary""",
    "x",
    totals=False,
)


def hidden(source: str, further: str = "FALSE") -> str:
    """Small counts blanked, with their cell; with their stratum for sizes; and what ``further`` selects."""
    stratum = "result_id, cdm_name, group_name, group_level, strata_name, strata_level,"
    stratum += " additional_name, additional_level"
    return f"""
        SELECT * REPLACE (CASE WHEN hide THEN NULL ELSE num END AS num,
                          CASE WHEN hide THEN NULL ELSE txt END AS txt) FROM (
          SELECT *, bool_or(small) OVER (PARTITION BY {stratum}, variable_name,
                                         variable_level)
                 OR bool_or(small AND variable_name IN ('number records',
                            'number subjects', 'Number records in observation',
                            'Denominator')) OVER (PARTITION BY {stratum})
                 OR coalesce({further}, FALSE) AS hide
          FROM (SELECT *, coalesce(estimate_name LIKE '%count' AND num > 0 AND num < {K},
                                   FALSE) AS small FROM {source}))"""


# The keys of hidden places as they stand in the long rows.
define(
    "gone_strata",
    """SELECT s.result_id, CASE WHEN x <> '' AND y <> '' THEN 'sex &&& age_group' WHEN x <> '' THEN 'sex'
               WHEN y <> '' THEN 'age_group' ELSE 'overall' END AS strata_of,
           CASE WHEN x = '' AND y = '' THEN 'overall' ELSE concat_ws(' &&& ', nullif(x, ''),
               nullif(y, '')) END AS strata, layer || '-01-01 to ' || layer || '-12-31 &&& years' AS additional
       FROM gone_in_obs g JOIN sets s ON s.mode = g.family AND result_type = 'summarise_in_observation'""",
)
define(
    "gone_incidence",
    f"""SELECT s.result_id, layer AS outcome, z AS opened, whole FROM (
            SELECT family, layer, x, y, z, FALSE AS whole FROM gone_outcomes
            UNION ALL SELECT family, NULL, x, y, z, TRUE FROM gone_at_risk) g
        JOIN sets s ON s.mode = g.family AND result_type = 'incidence'
            AND s.sex = CASE WHEN x = '' THEN '{DENOMINATOR_SEXES[0]}' ELSE x END
            AND s.age_group = CASE WHEN y = '' THEN '{band_label(DENOMINATOR_BANDS[0])}' ELSE y END""",
)
OPENED = "CASE WHEN additional_name LIKE '%interval' THEN split_part(additional_level, ' &&& ', 1) ELSE '' END"
define(
    "safe_in_obs",
    hidden("long_in_obs", "(result_id, strata_name, strata_level, additional_level)"
        " IN (SELECT (result_id, strata_of, strata, additional) FROM gone_strata)"),
)
define(
    "safe_incidence",
    hidden(
        "long_incidence",
        f"""(result_id, {OPENED}) IN (SELECT (result_id, opened) FROM gone_incidence WHERE whole)
            OR variable_name = 'Outcome' AND (result_id, split_part(group_level, ' &&& ', 2), {OPENED})
                IN (SELECT (result_id, outcome, opened) FROM gone_incidence WHERE NOT whole)""",
    ),
)
define(
    "safe_periods",
    hidden(
        "long_periods",
        """(result_id, variable_name, variable_level) IN (SELECT (s.result_id, layer, x)
            FROM gone_levels g JOIN sets s ON s.mode = g.family AND result_type = 'summarise_table'
            AND NOT s.per_person)""",
    ),
)
define("safe_per_person", hidden("long_per_person"))
LONG = (
    "result_id, cdm_name, group_name, group_level, strata_name, strata_level,"
    " variable_name, variable_level, estimate_name, estimate_type, num, txt,"
    " additional_name, additional_level"
)
define(
    "safe_tables",
    f"SELECT {LONG} FROM safe_periods UNION ALL SELECT {LONG} FROM safe_per_person",
)
define(
    "safe_all",
    f"""SELECT {LONG} FROM long_snapshot UNION ALL SELECT {LONG} FROM safe_in_obs
        UNION ALL SELECT {LONG} FROM safe_incidence
        UNION ALL SELECT {LONG} FROM safe_tables""",
)
