"""Queries of the event engine and their DuckDB SQL."""

from rategrid.plans import calibrate, catalog, checks, cube, features, fit, inference, model, motion, prepare, process, scores, sequence, studies  # noqa: F401  they register their queries
from rategrid.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "q_feature_cube"
