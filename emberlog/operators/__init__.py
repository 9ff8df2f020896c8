"""Operators: functions from an entry DataFrame to a DataFrame, for batches and streams."""
