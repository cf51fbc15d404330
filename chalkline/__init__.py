"""Chalkline: DataFrame functions for school-programme analytics on Spark."""
