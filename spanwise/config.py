"""Fixed values of the study: tables, fields, rule sets, bands and labels."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# The record tables that make a person observable.
RECORD_TABLES = (
    "drug_exposure",
    "condition_occurrence",
    "procedure_occurrence",
    "visit_occurrence",
    "device_exposure",
    "measurement",
    "observation",
    "death",
)

# Start and end field of each record table (CDM standard names).
DATE_FIELDS = {
    "drug_exposure": ("drug_exposure_start_date", "drug_exposure_end_date"),
    "condition_occurrence": ("condition_start_date", "condition_end_date"),
    "procedure_occurrence": ("procedure_date", "procedure_end_date"),
    "visit_occurrence": ("visit_start_date", "visit_end_date"),
    "device_exposure": ("device_exposure_start_date", "device_exposure_end_date"),
    "measurement": ("measurement_date", "measurement_date"),
    "observation": ("observation_date", "observation_date"),
    "death": ("death_date", "death_date"),
    "observation_period": (
        "observation_period_start_date",
        "observation_period_end_date",
    ),
}

# Visit concepts that count as a hospital stay.
INPATIENT_CONCEPTS = (9201, 262)

# Gender concepts of the CDM standard.
MALE_CONCEPT = 8507
FEMALE_CONCEPT = 8532

# Persistence lengths in days, and which of them also run with a
# surveillance window after the last record.
PERSISTENCE_RULES = (
    (0, False),
    (180, True),
    (180, False),
    (365, True),
    (365, False),
    (545, True),
    (545, False),
    (730, True),
    (730, False),
)

# Age bands (None is unbounded) for person-time by year, and the
# bands of the incidence denominators.
AGE_BANDS = ((0, 19), (20, 39), (40, 59), (60, 79), (80, None))
DENOMINATOR_BANDS = ((0, 150), (0, 19), (20, 39), (40, 59), (60, 79), (80, 150))
DENOMINATOR_SEXES = ("Both", "Female", "Male")

# Ingredients whose exposures are the outcomes.
INGREDIENTS = ("azithromycin", "ciprofloxacin", "teicoplanin")

# Display labels of the thirteen definitions.
MODE_LABELS = {
    "original_data": "Bespoke",
    "min_extract": "First record to extract",
    "min_max": "First to last record",
    "impatient": "Inpatient hospitalisation",
    "persistence_0_surveillanceFALSE": "Persistence 0",
    "persistence_180_surveillanceFALSE": "Persistence 180",
    "persistence_180_surveillanceTRUE": "Persistence 180 + surveillance",
    "persistence_365_surveillanceFALSE": "Persistence 365",
    "persistence_365_surveillanceTRUE": "Persistence 365 + surveillance",
    "persistence_545_surveillanceFALSE": "Persistence 545",
    "persistence_545_surveillanceTRUE": "Persistence 545 + surveillance",
    "persistence_730_surveillanceFALSE": "Persistence 730",
    "persistence_730_surveillanceTRUE": "Persistence 730 + surveillance",
}

# Display names of the databases compared in the report.
DATABASE_LABELS = {
    "Barts Health": "Barts Health",
    "CPRD AURUM 202409 - 50 prac": "CPRD AURUM 50",
    "GOSH_OMOP": "GOSH",
    "IDRIL_1": "IDRIL",
    "UCLH-from-2019": "UCLH",
}

# Display order of sexes and age groups.
SEX_LEVELS = ("overall", "Female", "Male")
AGE_GROUP_LEVELS = (
    "overall",
    "0 to 19",
    "20 to 39",
    "40 to 59",
    "60 to 79",
    "80 or above",
)

# Names of the summary variables and estimates.
NUMERIC_VARIABLES = (
    "duration",
    "time_to_next_observation",
    "age_start",
    "age_end",
    "number_conditions",
    "number_drugs",
    "number_visits",
    "conditions_per_day",
    "drugs_per_day",
    "visits_per_day",
)
CATEGORICAL_VARIABLES = ("sex", "age_group_start", "age_group_end")
NUMERIC_ESTIMATES = ("median", "q25", "q75", "min", "max", "mean", "sd")
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def mode_name(persistence: int, surveillance: bool) -> str:
    """Name of one persistence definition."""
    return f"persistence_{persistence}_surveillance{str(surveillance).upper()}"


@dataclass(frozen=True)
class StudyConfig:
    """Parameters of one study run."""

    data_end_date: dt.date
    cdm_name: str = "cdm"
    censor_age: int = 150
    censor_all: bool = False
    min_cell_count: int = 5
    study_start: dt.date | None = dt.date(2012, 1, 1)
    study_end: dt.date | None = None
    days_prior: int = 0
    ingredients: tuple[str, ...] = INGREDIENTS
    washout: int = 30
    repeated_events: bool = True
    drug_gap_era: int = 1
    # Published period ids are numbered in so many parts at a time; a prime, so that
    # regularly spaced person ids still spread over all of them.
    id_buckets: int = 4099

    def __post_init__(self):
        if not isinstance(self.data_end_date, dt.date):
            raise TypeError("data_end_date must be a date")
        if self.censor_age <= 0:
            raise ValueError("censor_age must be positive")
        if self.min_cell_count < 0 or self.washout < 0 or self.days_prior < 0:
            raise ValueError("counts and windows must not be negative")
