"""Detectors: one score per row, higher is more anomalous."""
