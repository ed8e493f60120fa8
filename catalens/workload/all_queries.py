"""Importing this module registers every query."""

from catalens.workload import (  # noqa: F401
    cleaning_queries,
    encoding_queries,
    evaluation_queries,
    matching_queries,
    pipeline_queries,
    profile_queries,
    recommend_queries,
    source_queries,
    spec_queries,
)
from catalens.workload.registry import ORACLES, QUERIES  # noqa: F401
