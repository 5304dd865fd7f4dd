"""Composed jobs: feature sets, models, chart data and exports."""
