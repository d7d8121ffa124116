"""A PySpark library for gridded daily time series and for preparing training data."""
