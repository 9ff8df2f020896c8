"""Pipelines of operators, their configuration, extraction definitions and searches."""
