"""Telemetry analytics on Spark: DataFrame-to-DataFrame operators for keyed time series."""
