"""Fixed values of the medical-record tables: keys, concept columns and time columns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EventTable:
    """Where an event table keeps its concept and its times; None where it has no such column."""

    name: str
    concept: str
    start_date: str
    start_datetime: str | None
    end_date: str | None = None
    end_datetime: str | None = None

    @property
    def is_span(self) -> bool:
        return self.end_date is not None

    @property
    def row_id(self) -> str:
        return f"{self.name}_id"

    def time_column(self, side: str, precision: str) -> tuple[str, bool]:
        """Column of the side's time, and whether the precision had to fall back to dates."""
        date, exact = (self.end_date, self.end_datetime) if side == "end" else (self.start_date, self.start_datetime)
        if precision == "datetime" and exact is None:
            return date, True
        return (exact if precision == "datetime" else date), False


@dataclass(frozen=True)
class TimeTable:
    """A table whose rows are observations with a time zero."""

    name: str
    row_id: str
    subject: str
    start_date: str
    start_datetime: str | None
    end_date: str | None
    end_datetime: str | None


def _span(name: str, concept: str, stem: str, timed: bool = True) -> EventTable:
    at = [f"{stem}_start_date", f"{stem}_start_datetime", f"{stem}_end_date", f"{stem}_end_datetime"]
    return EventTable(name, concept, at[0], at[1] if timed else None, at[2], at[3] if timed else None)


# Names of the common data model, version 5.4.
POINT_TABLES = {t: EventTable(t, f"{t}_concept_id", f"{t}_date", f"{t}_datetime") for t in ("measurement", "observation", "specimen")}
SPAN_TABLES = {
    t.name: t
    for t in (
        _span("drug_exposure", "drug_concept_id", "drug_exposure"),
        _span("condition_occurrence", "condition_concept_id", "condition"),
        EventTable("procedure_occurrence", "procedure_concept_id", "procedure_date", "procedure_datetime", "procedure_end_date", "procedure_end_datetime"),
        _span("device_exposure", "device_concept_id", "device_exposure"),
        _span("drug_era", "drug_concept_id", "drug_era", timed=False),
        _span("dose_era", "drug_concept_id", "dose_era", timed=False),
        _span("condition_era", "condition_concept_id", "condition_era", timed=False),
        _span("episode", "episode_concept_id", "episode"),
    )
}
EVENT_TABLES = POINT_TABLES | SPAN_TABLES
TIME_TABLES = {
    "person": TimeTable("person", "person_id", "person_id", "birth_datetime", "birth_datetime", None, None),
    "person_cohort": TimeTable("cohort", "subject_id", "subject_id", "cohort_start_date", None, "cohort_end_date", None),
    "person_observation_period": TimeTable("observation_period", "observation_period_id", "person_id", "observation_period_start_date", None, "observation_period_end_date", None),
    "person_visit_occurrence": TimeTable("visit_occurrence", "visit_occurrence_id", "person_id", "visit_start_date", "visit_start_datetime", "visit_end_date", "visit_end_datetime"),
}
#: End of an observation that has none.
OPEN_END = "2999-12-31 23:59:59"
# The tables of the model by kind.
TABLE_GROUPS = {
    "clinical": "person observation_period visit_occurrence visit_detail condition_occurrence drug_exposure procedure_occurrence device_exposure measurement observation death note note_nlp specimen fact_relationship".split(),
    "health_system": "location care_site provider".split(),
    "health_economics": "payer_plan_period cost".split(),
    "derived": "drug_era dose_era condition_era episode episode_event".split(),
    "metadata": "metadata cdm_source".split(),
    "vocabulary": "concept vocabulary domain concept_class concept_relationship relationship concept_synonym concept_ancestor source_to_concept_map drug_strength".split(),
    "results": "cohort cohort_definition".split(),
}
TABLES = frozenset(t for group in TABLE_GROUPS.values() for t in group)
# Names of aggregation strategies.
STRATEGIES = ("last", "first", "mean", "median", "mode", "sum", "count", "min", "max", "std")
# Texts that count as missing.
MISSING = ("nan", "np.nan", "<NA>", "pd.NA")
UNITS = {
    1: ("us", "micro", "micros", "microsecond", "microseconds"),
    1_000: ("ms", "milli", "millis", "millisecond", "milliseconds"),
    1_000_000: ("s", "sec", "second", "seconds"),
    60_000_000: ("m", "min", "minute", "minutes"),
    3_600_000_000: ("h", "hr", "hour", "hours"),
    86_400_000_000: ("d", "day", "days"),
    604_800_000_000: ("w", "week", "weeks"),
}
_MICROSECONDS = {name: size for size, names in UNITS.items() for name in names} | {"D": 86_400_000_000, "W": 604_800_000_000}
DAY = 86_400_000_000


def microseconds(number: int, unit: str) -> int:
    """Length of an interval; only units of fixed length are accepted."""
    if unit not in _MICROSECONDS:
        raise ValueError(f"interval_length_unit {unit!r} is not a unit of fixed length from microseconds to weeks.")
    return number * _MICROSECONDS[unit]
