"""Shared plan context: the logical tables plus memoised mart DataFrames.

Marts are lazy DataFrames. Memoising the DataFrame objects (not caching
their data) means a query that reads one mart several times carries the very
same logical subtree each time, so Spark's exchange reuse shares the shuffles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.functions.dates import IMPUTE_DAYS
from ledgerlens.sources.tables import SalesTables, load_sales_tables


class Marts:
    def __init__(self, tables: SalesTables, impute_days: int = IMPUTE_DAYS,
                 new_customer_year: int = 1998, persist: bool | str = False,
                 line_store: str | None = None):
        self.t = tables
        # A folder of lines stored by half-year, read instead of joining them anew.
        self.line_store = line_store
        # How the base marts that many others read (line revenue, order grain,
        # line shares) are kept once computed:
        #   False: nowhere; every query reads the columns and periods it needs;
        #   True / "memory": persisted blocks (memory, spilling to disk);
        #   "table": written as tables bucketed by order id in the shared folder
        #            (durable; readers keep the order-id partitioning).
        self.persist = "memory" if persist is True else persist
        self.impute_days = impute_days
        self.new_customer_year = new_customer_year
        self._memo: dict[str, DataFrame] = {}
        self.sf_dir: str | None = None
        self.window = None
        self._full: Marts | None = None

    @classmethod
    def load(cls, spark: SparkSession, sf_dir: str, **kw) -> "Marts":
        window = kw.pop("window", None)
        marts = cls(load_sales_tables(spark, sf_dir, window=window), **kw)
        marts.sf_dir, marts.window = sf_dir, window
        return marts

    def full_span(self) -> "Marts":
        """The same marts over every order in the data (no window)."""
        if self.sf_dir is not None and self.window is None:
            return self
        if self._full is None:
            if self.sf_dir is None:
                raise ValueError("full_span needs a Marts created with Marts.load")
            self._full = Marts.load(self.spark, self.sf_dir, window=None, impute_days=self.impute_days,
                                    new_customer_year=self.new_customer_year, persist=self.persist,
                                    line_store=self.line_store)
        return self._full

    @property
    def spark(self) -> SparkSession:
        return self.t.orders.sparkSession

    def memo(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def shared(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Keep a base mart for reuse according to ``self.persist``. ``key`` is
        the order-id column the mart is partitioned by."""
        if self.persist == "memory":
            # Lost blocks are recomputed from the lineage.
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        if self.persist == "table":
            from ledgerlens.sources.sinks import save_bucketed
            return save_bucketed(df, name, key)
        return df

    def release(self) -> None:
        """Drop persisted marts of this context."""
        for df in self._memo.values():
            if df.storageLevel != StorageLevel.NONE:
                df.unpersist()


def mart(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Memoise a ``fn(m: Marts) -> DataFrame`` builder per context."""

    @functools.wraps(fn)
    def wrapper(m: Marts, *args, **kwargs) -> DataFrame:
        if args or kwargs:
            key = f"{fn.__module__}.{fn.__name__}{args}{sorted(kwargs.items())}"
        else:
            key = f"{fn.__module__}.{fn.__name__}"
        return m.memo(key, lambda: fn(m, *args, **kwargs))

    return wrapper
