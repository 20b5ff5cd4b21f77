"""Operators over items, answers and probabilities."""
