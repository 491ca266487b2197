"""Dialogue annotation and transcript scoring as Spark DataFrame operators."""
