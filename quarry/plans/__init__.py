"""Whole plans: offline, answering, evaluation."""
