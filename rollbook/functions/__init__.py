"""Filters, input cleaning and aggregate columns shared by the operators."""
