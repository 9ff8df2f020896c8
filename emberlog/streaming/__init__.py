"""Stateful streams: reassembly and sessions that hold templates."""
