"""Inputs: the driver tables as observations, text formats of gauges, and sinks."""
