"""DataFrame -> DataFrame building blocks.

Catalyst and AQE broadcast a side only after checking its size, and fall back to a shuffled join (with skew splitting)
above the threshold. A broadcast is asked for only where the number of rows is fixed: a LIMIT, or the years of a
calendar. Single-row parameters travel as scalar subqueries.
"""
