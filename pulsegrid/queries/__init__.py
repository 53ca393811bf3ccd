"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from . import checked, distance, engagement, ingest, models, text  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
