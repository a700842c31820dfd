"""Retail assortment analytics on Spark DataFrames.

Layers (see README): transaction summaries (weekly, N-week periods, interval
joins), data quality, demand features (Pareto lumping, log market share),
Spark ML models, and greedy assortment under a multinomial-logit demand model.
"""

__all__ = ["session"]
