"""Operators that prepare training data for language and speech models."""
