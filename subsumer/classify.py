"""The whole way from a parsed ontology to its hierarchy."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .ontology import Ontology
from .operators.normalize import Normalized, normalize
from .operators.taxonomy import direct_parents, inferred_count
from .plans.lineage import written
from .plans.saturation import Saturated, saturate
from .operators.export import classified


@dataclass(frozen=True)
class Classified:
    normalized: Normalized
    saturated: Saturated
    direct: DataFrame
    hierarchy: DataFrame
    stats: dict


def classify(ontology: Ontology, *, nf5: DataFrame | None = None, nf6: DataFrame | None = None, parse_ms: int = 0, collapse_equivalents: bool = False) -> Classified:
    """Normalises, saturates and reduces; stats has counts and milliseconds of each phase."""
    marks = [time.monotonic()]
    n = normalize(ontology, nf5=nf5, nf6=nf6)
    marks.append(time.monotonic())
    s = saturate(n.concepts.select("id"), n.axioms)
    marks.append(time.monotonic())
    direct = written(direct_parents(s.subsumers, n.concepts, collapse_equivalents=collapse_equivalents), "parents")
    marks.append(time.monotonic())
    ms = [round(1000 * (b - a)) for a, b in zip(marks, marks[1:], strict=False)]
    stats = {
        "concept_count": n.concepts.count() - 2,
        "role_count": n.roles.count(),
        "inferred_subsumptions": inferred_count(s.subsumers, n.concepts).first()[0],
        "parse_time_ms": parse_ms,
        "normalize_time_ms": ms[0],
        "saturate_time_ms": ms[1],
        "reduction_time_ms": ms[2],
        "total_time_ms": parse_ms + sum(ms),
    }
    return Classified(n, s, direct, classified(direct, n.concepts), stats)
