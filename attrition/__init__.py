"""Subscriber-attrition analytics on Spark DataFrames."""

from attrition.config import FEATURES, PAGES, Params

__all__ = ["FEATURES", "PAGES", "Params"]
