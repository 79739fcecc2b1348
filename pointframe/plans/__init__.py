"""Query registry; importing this package registers every query of the library's own operators."""

from pointframe.plans import q_fit, q_planes, q_points, q_spatial, q_streams, q_time  # noqa: F401
from pointframe.plans.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "query"]
