"""Composed reports: the PPP flow, the data-quality report, the query
catalog and its SQL oracle."""
