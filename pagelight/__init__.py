"""Pagelight: document-evidence analytics expressed as Spark DataFrame operators."""
