"""All registered queries."""

from chalkline.plans import a_brief, a_scoring, a_stats, g_graph, p_filters, p_joins, s_streams, w_quiz  # noqa: F401
from chalkline.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
