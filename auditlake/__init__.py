"""Spark operators for software-audit findings and chain-monitoring telemetry."""
