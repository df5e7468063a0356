"""Monthly account and spend analytics on Spark DataFrames.

Layers, bottom up: ``functions`` (column helpers), ``sources`` (typed tables),
``operators`` (DataFrame -> DataFrame building blocks) and ``plans`` (whole
questions put together from operators).
"""

from monthweave.session import build_session

__all__ = ["build_session"]
