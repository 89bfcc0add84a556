"""tillcast: weekly store/department retail analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame; nothing is collected except bounded model parameters (scaler
quantiles, p x p moment matrices, fold cut dates, top-k lists).
"""

__version__ = "0.1.0"
