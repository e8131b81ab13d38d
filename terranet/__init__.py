"""Channel networks from elevation rasters, as Spark DataFrame operators."""

from terranet.plans.extract import Network, extract_network

__all__ = ["Network", "extract_network"]
