"""Operators for preparing training data. Nothing outside this subpackage imports it but ``__spark_entry__`` and ``corpus_pipeline``."""
