"""Threadloom: analytics over coding-agent session transcripts, as Spark DataFrames."""
