"""All registered queries and their SQL oracles."""

from tessera.functions import queries_graders, queries_text  # noqa: F401
from tessera.operators import queries_batch, queries_curation, queries_exchange, queries_metrics, queries_rollout, queries_video  # noqa: F401
from tessera.plans import queries_agents, queries_plans  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES
from tessera.sources import queries_io  # noqa: F401
from tessera.streaming import queries_streaming  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
