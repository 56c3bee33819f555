"""Incremental ingestion with Structured Streaming: an extension beyond batch ingestion.

Each micro-batch of answers becomes facts and events in the store, and the facts of the keys that it changed are related anew. Fact ids come from their content, so a batch that is delivered twice changes nothing; keys are noted before facts are saved, so a batch that failed between is made good by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.facts import facts_from_answers
from factloom.operators.store import FactStore
from factloom.plans.pipeline import relate_noted, save_facts


def ingest_batch(store: FactStore, answers: DataFrame) -> None:
    facts, events = facts_from_answers(answers)
    save_facts(store, facts)
    store.save("processing_events", events)
    relate_noted(store)


def ingest_stream(store: FactStore, answers: DataFrame, checkpoint: str) -> StreamingQuery:
    """answers is a stream with the columns that facts_from_answers takes."""
    return answers.writeStream.foreachBatch(lambda batch, _: ingest_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
