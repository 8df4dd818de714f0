"""Inference on pre-aggregated tables: logistic fits, bootstraps, exact tests."""
