"""Sources (parquet -> logical sales tables) and sinks (written tables)."""

from ledgerlens.sources.sinks import materialize, read_table, save_table
from ledgerlens.sources.tables import (SalesTables, load_sales_tables,
                                       read_raw)

__all__ = ["SalesTables", "load_sales_tables", "read_raw",
           "materialize", "read_table", "save_table"]
