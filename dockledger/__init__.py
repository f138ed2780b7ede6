"""Goods-receiving analytics on Spark DataFrames."""

from dockledger.tables import Tables

__all__ = ["Tables"]
