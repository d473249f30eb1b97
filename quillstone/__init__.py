"""Quillstone: document analytics as Spark DataFrame operators."""
