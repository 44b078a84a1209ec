"""All registered queries."""

from . import (  # noqa: F401  (registration by import)
    queries_analysis,
    queries_blocks,
    queries_evaluate,
    queries_fitting,
    queries_metrics,
    queries_rules,
    queries_sequences,
    queries_sources,
    queries_text,
)
from .registry import ORACLES, QUERIES  # noqa: F401
