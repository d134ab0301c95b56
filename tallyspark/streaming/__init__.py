"""Continuous forms of the append, trend and alert operators."""
