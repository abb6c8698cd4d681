"""Behaviour-telemetry feature engineering as Spark jobs (DataFrame in, DataFrame out)."""
