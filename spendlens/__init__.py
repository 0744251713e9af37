"""spendlens: cloud-cost findings analytics as Spark DataFrame jobs.

Every operator is a function ``f(DataFrame..., params) -> DataFrame`` built from
DataFrame / SQL expressions so Catalyst can prune, push down and plan it.
"""

__version__ = "0.1.0"
