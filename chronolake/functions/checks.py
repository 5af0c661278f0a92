"""Checks of the arguments of extraction; messages and error types are fixed values of the interface."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from .spec import POINT_TABLES, SPAN_TABLES, STRATEGIES, TIME_TABLES, UNITS

log = logging.getLogger(__name__)


def _require(fine: bool, error: type[Exception], message: str) -> None:
    if not fine:
        raise error(message)


def check_observation_table(name) -> str:
    _require(isinstance(name, str), TypeError, "Expected observation_table to be a string.")
    _require(name in TIME_TABLES, ValueError, f"observation_table must be one of {list(TIME_TABLES)}.")
    return name


def check_catalog(catalog):
    from ..sources.catalog import Catalog

    _require(isinstance(catalog, Catalog), TypeError, "Expected catalog to be a Catalog.")
    return catalog


def check_flag(value, name: str) -> bool:
    _require(isinstance(value, bool), TypeError, f"Expected {name} to be a boolean.")
    return value


def check_data_tables(tables, spans: bool) -> list[str]:
    known = list(SPAN_TABLES if spans else POINT_TABLES)
    _require(isinstance(tables, str | Sequence), TypeError, "Expected data_tables to be a string or Sequence.")
    tables = [tables] if isinstance(tables, str) else list(tables)
    _require(set(tables) <= set(known), ValueError, f"data_tables must be a subset of {known}.")
    return tables


def check_fields(fields, tables: list[str]) -> dict[str, list[str]]:
    """Fields of each table; the caller's dictionary is not touched."""
    if isinstance(fields, dict):
        _require(set(fields) == set(tables), ValueError, "data_field_to_keep keys must be equal to data_tables.")
        for v in fields.values():
            _require(isinstance(v, str | Sequence), TypeError, "data_field_to_keep values must be a string or Sequence.")
        return {t: [v] if isinstance(v, str) else list(v) for t, v in fields.items()}
    _require(isinstance(fields, str | Sequence), TypeError, f"Expected data_field_to_keep to be a string, Sequence, or dict, but is {type(fields)}")
    _require(len(tables) == 1, TypeError, "data_field_to_keep must be a dictionary if more than one data table is used.")
    return {tables[0]: [fields] if isinstance(fields, str) else list(fields)}


def check_intervals(number, unit, count) -> None:
    _require(isinstance(number, int), TypeError, "Expected interval_length_number to be an integer.")
    _require(isinstance(unit, str), TypeError, "Expected interval_length_unit to be a string.")
    _require(isinstance(count, int), TypeError, "Expected num_intervals to be an integer.")


def check_concepts(concepts) -> None:
    _require(concepts == "all" or isinstance(concepts, Sequence) and not isinstance(concepts, str), TypeError, "concept_ids must be a sequence of integers or 'all'.")


def check_strategy(strategy) -> str:
    _require(strategy in STRATEGIES, TypeError, f"aggregation_strategy must be one of {list(STRATEGIES)}.")
    return strategy


def check_choice(value, name: str, options: list[str]) -> str:
    _require(isinstance(value, str), TypeError, f"Expected {name} to be a string.")
    _require(value in options, ValueError, f"{name} must be one of {options}.")
    return value


def warn_on_precision(unit: str, precision: str) -> None:
    """Intervals shorter than a day make little sense where only dates are kept."""
    short = {name for size, names in UNITS.items() if size < 86_400_000_000 for name in names}
    if precision == "date" and unit in short:
        log.warning("Using interval_length_unit %r with time_precision 'date': all events of a day fall into one interval.", unit)
