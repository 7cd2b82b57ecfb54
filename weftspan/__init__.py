"""Interval algebra, contact graphs and stripe calling as Spark DataFrame jobs."""
