"""Hourly network-activity analytics per map cell, expressed as Spark plans."""
