"""weft: a Spark-native engine for multilayer file graphs and the tables around them."""

__version__ = "0.1.0"
