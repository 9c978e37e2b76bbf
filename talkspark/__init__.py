"""Transcript evidence over a corpus of talks, as Spark jobs."""
