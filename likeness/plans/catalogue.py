"""Importing this module registers every query."""

from likeness.plans import (  # noqa: F401
    curation, evaluation, features, learning, likenesses, modelling, profiling, scoring, shapes)
from likeness.plans.registry import ORACLES, QUERIES  # noqa: F401
