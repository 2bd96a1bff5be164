"""Relational, history, encoding, evidence and decision operators over DataFrames."""
