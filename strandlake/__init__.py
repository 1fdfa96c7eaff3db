"""Sequence annotation analytics and corpus preparation as Spark jobs."""
