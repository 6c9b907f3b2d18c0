"""Chunking, ranking, budgets, span scores, resampling, judge and calibration operators."""
