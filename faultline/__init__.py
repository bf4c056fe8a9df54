"""Predictive-maintenance analytics on wide sensor tables, as Spark jobs."""
