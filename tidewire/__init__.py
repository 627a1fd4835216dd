"""Tidewire: a Spark-first engine for turning many content sources into a digest."""
