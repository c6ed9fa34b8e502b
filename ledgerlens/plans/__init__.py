"""The marts, as functions ``(m: Marts) -> DataFrame`` (memoised per context).

context   Marts: the logical tables, persistence mode, memo of built marts
revenue   V1 revenue lines, V2 order totals, V3 monthly totals
country   V4 country-year totals, V5/V6 half-year slices
customer  V7 customer orders, V8 classification, V9 customer-year summary
product   V10-V24: product-year totals and details, line shares, freight
          allocation, running averages, discount-rate sums, half-year reports,
          category performance
employee  V25 employee-year totals with position, V26 employee-month performance
shipping  V27 order shipping report, V28/V29 shipper half-year reports
growth    G1-G4 growth tables, G5 growth over all years, G6 aligned halves, G7 comparison
kpi       K1-K17 dashboard figures
adhoc     H1-H8 ad-hoc analyses
generic   one query per generic operator
views     the marts under the source view names
"""
