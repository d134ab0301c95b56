"""Analytic operators over datasets and frames."""
