"""DataFrame operators.

Bars are unique per (ticker, date): `gaps.first_seen` and the stored tables see to that. A
window over one ticker therefore holds at most one row per calendar day, some ten thousand for
decades of history, however many bars there are in total or however many raw records one
ticker has. Windows by date have no such bound, so per-date figures are aggregated first
(map-side) and joined back through `plans.joins.join_by_date`.
"""
