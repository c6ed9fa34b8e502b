"""ledgerlens: sales-analytics marts as Spark DataFrame plans.

Layout
------
sources/    parquet readers, the logical sales tables, table sinks
functions/  Column expressions: exact money, dates and periods, text ids
operators/  reusable DataFrame transformations (shares, growth, pivots, top-1, checks)
plans/      the named marts, growth tables, KPIs and ad-hoc reports
"""

from ledgerlens.plans.context import Marts
from ledgerlens.session import build_session, checkpoint_dir, cluster_conf

__all__ = ["Marts", "build_session", "checkpoint_dir", "cluster_conf"]
