"""Test-result analytics on Spark: typed tables, link inference, coverage and flake queries."""
