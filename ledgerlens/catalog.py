"""Query catalogue: one builder per registered query key.

Every builder takes a :class:`~ledgerlens.plans.context.Marts` and returns a
lazy DataFrame. :func:`present` gives the comparison form shared with the
DuckDB twins (exact decimals become DOUBLE once, at the very end).

Operator keys of the generic inventory that a named mart already exercises
in full point at that mart (see ``OPERATOR_COVERAGE``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ledgerlens.plans import (adhoc, country, customer, employee, generic, growth, kpi, product,
                              revenue, shipping)
from ledgerlens.plans.context import Marts

Builder = Callable[[Marts], DataFrame]

MARTS: dict[str, Builder] = {
    # 2B named derived tables
    "revenue_transactions": revenue.revenue_transactions,                 # V1
    "order_transactions": revenue.order_transactions,                     # V2
    "monthly_transactions": revenue.monthly_transactions,                 # V3
    "country_transactions": country.country_transactions,                 # V4
    "country_transactions_h2": country.country_transactions_h2,           # V5
    "country_transactions_h1": country.country_transactions_h1,           # V6
    "customer_transactions": customer.customer_transactions,              # V7
    "customer_classification": customer.customer_classification,          # V8
    "customer_summary": customer.customer_summary,                        # V9
    "product_transactions": product.product_transactions,                 # V10
    "product_details": product.product_details,                           # V11
    "stock_status": product.stock_status,                                 # V11a
    "weighted_averages": product.weighted_averages,                       # V12
    "weighted_averages_fixed": product.weighted_averages_fixed,           # V12b
    "allocation": product.allocation,                                     # V13
    "allocation_fixed": product.allocation_fixed,                         # V13b
    "allocation_h2": product.allocation_h2,                               # V14
    "allocation_h1": product.allocation_h1,                               # V15
    "allocation_summary": product.allocation_summary,                     # V16
    "allocation_summary_by_year": lambda m: product.allocation_summary(m, frame="year"),  # V16 fix
    "products_report": product.products_report,                           # V17
    "discount_96": product.discount_96,                                   # V18
    "discount_97_h1": product.discount_97_h1,                             # V19
    "discount_97_h2": product.discount_97_h2,                             # V20
    "discount_98": product.discount_98,                                   # V21
    "p_sales_h2": product.p_sales_h2,                                     # V22
    "p_sales_h2_fixed": product.p_sales_h2_fixed,                         # V22b
    "p_sales_h1": product.p_sales_h1,                                     # V23
    "category_performance": product.category_performance,                 # V24
    "employee_transactions": employee.employee_transactions,              # V25
    "employee_performance": employee.employee_performance,                # V26
    "employee_performance_wide": employee.employee_performance_wide,      # V26 tidy
    "shipping_report": shipping.shipping_report,                          # V27
    "shipping_report_h2": shipping.shipping_report_h2,                    # V28
    "shipping_report_h1": shipping.shipping_report_h1,                    # V29
    # ad-hoc analyses
    "unshipped_orders": adhoc.unshipped_orders,                           # H1
    "unshipped_qty_by_product": adhoc.unshipped_qty_by_product,           # H2
    "avg_days_to_ship": adhoc.avg_days_to_ship,                           # H3
    "growth_by_country_like": adhoc.growth_by_country_like,               # H4
    "actual_growth_by_country_like": adhoc.actual_growth_by_country_like,  # H4
    "country_line_drilldown": adhoc.country_line_drilldown,               # H5
    "net_purchases_by_year_country": adhoc.net_purchases_by_year_country,  # H6
    "customer_counts": adhoc.customer_counts,                             # H7
    "growth_by_product": adhoc.growth_by_product,                         # H8
    "actual_growth_by_product": adhoc.actual_growth_by_product,           # H8
    # 2C growth tables
    "country_growth": growth.country_growth,                              # G1
    "actual_country_growth": growth.actual_country_growth,                # G2
    "product_growth": growth.product_growth,                              # G3
    "actual_product_growth": growth.actual_product_growth,                # G4
    "growth_long": lambda m: growth.growth_long(m.full_span()),           # G5
    "growth_long_calendar": lambda m: growth.growth_long(m.full_span(), calendar=True),  # G5
    "period_aligned_growth": lambda m: growth.period_aligned_growth(m.full_span()),      # G6
    "period_aligned_growth_cutoff": lambda m: growth.period_aligned_growth(m.full_span(), cutoff=(5, 6)),  # G6
    "growth_comparison": growth.growth_comparison,                        # G7
    # 2D KPIs
    "orders_summary": kpi.orders_summary,                                 # K1
    "shipping_efficiency": kpi.shipping_efficiency,                       # K2
    "catalogue_counts": kpi.catalogue_counts,                             # K3
    "sales_totals": kpi.sales_totals,                                     # K4
    "best_month": kpi.best_month,                                         # K5
    "top_country_by_year": kpi.top_country_by_year,                       # K6
    "country_most_customers": kpi.country_most_customers,                 # K7
    "country_discount_rank": kpi.country_discount_rank,                   # K8
    "amount_paid_total": kpi.amount_paid_total,                           # K9
    "new_customers_by_class": kpi.new_customers_by_class,                 # K10
    "monthly_active_customers": kpi.monthly_active_customers,             # K11
    "stock_status_mix": kpi.stock_status_mix,                             # K12
    "top_category": kpi.top_category,                                     # K13
    "top_freight_shipper_by_year": kpi.top_freight_shipper_by_year,       # K14
    "delivery_performance": kpi.delivery_performance,                     # K15
    "top_on_time_shipper_by_year": kpi.top_on_time_shipper_by_year,       # K16
    "sales_pivot": kpi.sales_pivot_country,                               # K17
    "sales_pivot_category": kpi.sales_pivot_category,                     # K17
}

GENERIC: dict[str, Builder] = {
    "scan_table": generic.scan_table,                      # A1
    "scan_project": generic.scan_project,                  # A2
    "scan_ordered": generic.scan_ordered,                  # A3
    "load_query": generic.load_query,                      # A4
    "save_table": generic.save_table_roundtrip,            # A5
    "named_view": generic.named_view,                      # A6
    "project_alias": generic.project_alias,                # B1
    "filter_null": generic.filter_null,                    # B2
    "filter_eq_or": generic.filter_eq_or,                  # B3
    "filter_like_prefix": generic.filter_like_prefix,      # B4
    "filter_like_contains": generic.filter_like_contains,  # B5
    "like_no_wildcard": generic.like_no_wildcard,          # B6
    "filter_year_month": generic.filter_year_month,        # B7
    "filter_query_expr": generic.filter_query_expr,        # B8
    "case_when": generic.case_when,                        # B9
    "between_dates_le": generic.between_dates_le,          # B10
    "select_positions": generic.select_positions,          # B11
    "rename_cols": generic.rename_cols,                    # B12
    "reorder_cols": generic.reorder_cols,                  # B13
    "impute_const": generic.project_alias,                 # B14
    "fill_null_zero": generic.fill_null_zero,              # B15
    "join_left_fact_dim": generic.join_left_fact_dim,      # C1
    "join_inner": generic.join_inner,                      # C2
    "join_natural_right": generic.join_natural_right,      # C5
    "join_natural_left": generic.join_natural_left,        # C6
    "join_natural_inner": growth.country_semi_annual,      # C7
    "stored_slices": generic.stored_slices,                # B7 on a stored table
    "product_period_rollup": product.product_period_rollup,  # D1 over grouping sets
    "agg_count": generic.order_counts_by_year,             # D2
    "agg_ratio": generic.freight_share,                    # D6
    "union_distinct": generic.union_distinct_slices,       # S3
    "agg_count_distinct": generic.distinct_customers_by_year,  # D3
    "sort_multi": generic.sort_multi,                      # S1
    "head_n": kpi.best_months,                             # S2
    "pivot_years": kpi.sales_pivot_country,                # S4
    "scalar_functions": generic.scalar_functions,          # F1-F12
    "net_sales_sql_function": generic.net_sales_sql_function,  # U
    "enforce_not_null": generic.enforce_not_null,          # E1
    "enforce_type_len": generic.enforce_type_len,          # E2
}

# Operator -> the registered query that exercises it (documentation only).
OPERATOR_COVERAGE = {
    "C3 join_left_then_null_filter": "unshipped_qty_by_product",
    "C4 join_fanout": "weighted_averages",
    "C8 semi_in_subquery": "employee_transactions",
    "C9 lookup_scalar_subquery": "product_details, p_sales_h2",
    "D1 agg_sum_group": "country_transactions",
    "D4 agg_avg": "products_report",
    "D5 agg_avg_int_trunc": "avg_days_to_ship, allocation_summary",
    "D7 agg_global": "orders_summary",
    "D8 distinct_rows": "weighted_averages, customer_classification",
    "D9 agg_conditional_count": "employee_performance",
    "D10 agg_expr_on_agg": "customer_summary",
    "W1 win_share_of_group": "weighted_averages_fixed",
    "W2 win_share_zero_guard": "weighted_averages_fixed",
    "W3 win_running_avg": "allocation_summary",
    "W4 win_running_sum": "discount_96",
    "W5 win_min_over_group": "customer_classification",
    "W6 pct_change": "growth_long",
    "S5 merge_halves": "actual_country_growth",
    "F1 net_sales": "scalar_functions, net_sales_sql_function, revenue_transactions",
    "F2 round_money": "scalar_functions, revenue_transactions, allocation_summary",
    "F3 cast_decimal": "scalar_functions, order_transactions, shipping_report_h2",
    "F4 cast_date": "project_alias, revenue_transactions",
    "F5 year_month": "scalar_functions, monthly_transactions",
    "F6 date_add_days": "scalar_functions, project_alias",
    "F7 date_diff_days": "scalar_functions, avg_days_to_ship",
    "F8 str_left": "scalar_functions, customer_summary, shipping_report_h2",
    "F9 str_concat_plus": "scalar_functions, country_transactions",
    "F10 str_concat_fn": "scalar_functions, products_report, employee_transactions",
    "F11 cast_int_string": "scalar_functions, product_transactions",
    "F12 arith": "scalar_functions, customer_transactions",
}

QUERIES: dict[str, Builder] = {**MARTS, **GENERIC}


def present(df: DataFrame) -> DataFrame:
    """Cast DECIMAL columns to DOUBLE, keep everything else."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(c.cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else c)
    return df.select(*cols)
