"""Operators: functions from frames to frames, without actions."""
