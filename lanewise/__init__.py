"""Freight-shipment analytics as lazy PySpark DataFrame operators."""

from lanewise.schema import Params

__all__ = ["Params"]
