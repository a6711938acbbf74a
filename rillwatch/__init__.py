"""Network-flow analytics on Spark: frames, microflows, traffic aggregates, warnings, alerts."""
