"""Experiment planning and the registered queries."""
