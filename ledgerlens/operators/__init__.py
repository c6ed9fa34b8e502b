"""Reusable DataFrame transformations.

shares    share of a group total (aggregate + join), period totals
growth    period-over-period change (row lag, calendar lag)
reshape   pandas-style natural merge, presence pivot, union distinct, year pivots
running   cumulative (running) totals over pre-aggregated periods
ranking   top-1 per group as a min_by aggregate
quality   NOT NULL / INT / NVARCHAR(n) rule reports
"""
