"""Early-warning analytics for equipment telemetry, written as Spark plans."""
