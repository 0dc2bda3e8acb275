"""Multimodal retrieval analytics over long recordings, as Spark DataFrame plans."""
