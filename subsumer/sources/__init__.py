"""Reading ontologies."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from ..ontology import Ontology
from .obo import read_obo
from .owl import read_owl


def detect_format(path: str, explicit: str = "auto") -> str:
    """obo or owl, as asked for or by the path's extension."""
    if explicit != "auto":
        if explicit not in ("obo", "owl"):
            raise ValueError(f"no format {explicit!r}: use obo or owl")
        return explicit
    kind = {".obo": "obo", ".owl": "owl", ".xml": "owl", ".rdf": "owl"}.get(PurePosixPath(path).suffix.lower())
    if kind is None:
        raise ValueError(f"cannot tell the format of {path!r}: use obo or owl")
    return kind


def read_ontology(spark: SparkSession, path: str, explicit: str = "auto") -> Ontology:
    if detect_format(path, explicit) == "obo":
        return read_obo(spark, path)
    return read_owl(spark, path)
