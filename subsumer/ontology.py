"""A parsed ontology: three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Ontology:
    header: DataFrame
    terms: DataFrame
    typedefs: DataFrame
