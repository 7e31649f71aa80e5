"""terrakite: analytics for visual-map data on Spark DataFrames."""

__version__ = "0.1.0"
