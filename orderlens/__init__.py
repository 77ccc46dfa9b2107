"""Order, fulfilment and experiment analytics as PySpark DataFrame operators."""

from orderlens.params import Params

__all__ = ["Params"]
