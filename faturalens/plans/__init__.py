"""Larger compositions: session settings, running totals, the data profile."""
