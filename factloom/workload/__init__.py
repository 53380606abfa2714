"""Registered queries: importing this package fills ``base.QUERIES`` and ``base.ORACLE``."""

from factloom.workload import base  # noqa: F401
from factloom.workload import text_queries  # noqa: F401
from factloom.workload import pair_queries  # noqa: F401
from factloom.workload import graph_queries  # noqa: F401
from factloom.workload import metric_queries  # noqa: F401
from factloom.workload import chain_queries  # noqa: F401
from factloom.workload import run_queries  # noqa: F401
