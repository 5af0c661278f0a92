"""Medical-record tables of the common data model as cubes."""

from .operators.extraction import setup_interval_variables, setup_obs, setup_variables
from .sources.catalog import Catalog, setup_connection

__all__ = ["Catalog", "setup_connection", "setup_interval_variables", "setup_obs", "setup_variables"]
