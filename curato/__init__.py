"""Curato: dataset curation and evaluation as composable Spark DataFrame operators."""
