"""Readers and writers: text formats by Spark's own sources, binary formats by a Python data source."""
