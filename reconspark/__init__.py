"""Spark operators for 3D-capture tables and log streams, plus training-data operators in ``llm``."""
