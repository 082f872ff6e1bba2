"""Threat-intelligence feed engine expressed as Spark DataFrame plans."""
