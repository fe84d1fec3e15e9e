"""Quarrylight: ranked text retrieval and corpus preparation as Spark DataFrame plans."""
