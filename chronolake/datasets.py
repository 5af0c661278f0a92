"""Data sets from given paths, and generated ones."""

from .sources.loaders import diabetes_130_fairlearn, diabetes_130_raw, gibleed_omop, mimic_2, mimic_2_preprocessed, mimic_iv_omop, physionet2012, physionet2019, read_csv, synthea27nj_omop
from .sources.synthetic import blobs

__all__ = ["blobs", "diabetes_130_fairlearn", "diabetes_130_raw", "gibleed_omop", "mimic_2", "mimic_2_preprocessed", "mimic_iv_omop", "physionet2012", "physionet2019", "read_csv", "synthea27nj_omop"]
