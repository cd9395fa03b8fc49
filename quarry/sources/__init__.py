"""Readers and writers, and the rules by which sources become text."""
