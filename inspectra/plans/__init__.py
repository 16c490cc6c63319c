"""Composed queries over the business tables and their SQL twins."""

from . import annotated, dataset, inspection, jobs, rasters
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotated", "dataset", "inspection", "jobs", "rasters"]
