"""Imports every query module, which fills the registry."""

from . import chart_queries, correlation_queries, detector_queries, enrich_queries, io_queries, ioc_queries, scalar_queries, stream_queries, summary_queries  # noqa: F401
from .core import REGISTRY  # noqa: F401
