"""facetcube: an incremental, PySpark-native OLAP-cube engine for time series."""

__version__ = "0.1.0"
