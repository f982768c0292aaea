"""Multilingual retrieval and text-processing engine on the Spark DataFrame API."""
