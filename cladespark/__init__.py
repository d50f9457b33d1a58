"""A PySpark-native engine for cohort-contrast genomics: what is present in one sample group and absent from another."""

__version__ = "0.2.0"
