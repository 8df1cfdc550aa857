"""Operators for preparing training text and vectors at cluster scale."""
