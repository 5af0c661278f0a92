"""chronolake: longitudinal-record analytics on Spark DataFrames."""

from .operators.cube import Cube, Layer
from .operators.features import feature_type_overview, harmonize_missing_values, infer_feature_types, replace_feature_types
from .operators.move import move_to_obs, move_to_x

__version__ = "0.1.0"
__all__ = ["Cube", "Layer", "feature_type_overview", "harmonize_missing_values", "infer_feature_types", "move_to_obs", "move_to_x", "replace_feature_types"]
