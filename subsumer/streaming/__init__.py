"""Ontologies that arrive as text while a stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..ontology import Ontology
from ..sources.obo import blocks_of, parse


def for_each_document(documents: DataFrame, column: str, key: str, act: Callable[[Ontology, int], None], checkpoint: str) -> StreamingQuery:
    """Parses each micro-batch of OBO documents in a string column, one whole document in a batch, and hands the ontology to act(ontology, batch)."""

    def one(batch: DataFrame, number: int) -> None:
        if batch.head(1):
            act(parse(blocks_of(batch, column, key)), number)

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
