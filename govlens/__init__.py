"""Governance analytics on Spark: facts and signals in, verdicts and scores out."""
