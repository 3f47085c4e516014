"""Streams of events and documents: rolling counts, lockouts, task de-duplication, turn pairing and ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators import ingest
from ..operators.commits import Tables

FAILURES, WITHIN, LOCKED = 5, 300, 900


def rolling_counts(events: DataFrame, at: str, by: str, window: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows in each window of event time and value of by; on streams, rows later than delay are dropped."""
    source = events.withWatermark(at, delay) if delay else events
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return source.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str, delay: str | None = None) -> DataFrame:
    """Runs of rows of one key with pauses below gap."""
    source = events.withWatermark(at, delay) if delay else events
    return source.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def dedupe_tasks(tasks: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """Tasks of a stream without those whose key came before, as long as the watermark remembers it."""
    return tasks.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def dedupe_tasks_batch(tasks: DataFrame, keys: list[str], at: str) -> DataFrame:
    return tasks.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(at, "task_id"))).where("_k = 1").drop("_k")


def _lock(state: tuple[list[float], float], rows: list[tuple[float, bool, int]], within: float, locked: float) -> tuple[tuple[list[float], float], list[tuple[int, float]]]:
    """Failures within the window so far and the end of the lock, after some rows (second, failed, id), and new locks."""
    recent, until = list(state[0]), state[1]
    locks = []
    for at, failed, event in sorted(rows):
        if at < until:
            continue
        if not failed:
            recent = []
            continue
        recent = [t for t in recent if at - t <= within] + [at]
        if len(recent) >= FAILURES:
            until, recent = at + locked, []
            locks.append((event, until))
    return (recent, until), locks


LOCKS = "user_id bigint, event_id bigint, locked_until double"


def lockouts(events: DataFrame, within: float = WITHIN, locked: float = LOCKED) -> DataFrame:
    """Locks of a stream of log-ins (user_id, event_id, ts, failed): five failures in five minutes lock for a quarter of an
    hour, in which attempts are ignored; a success forgets failures. The state of a user is at most five times."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = (list(state.get[0]), state.get[1]) if state.exists else ([], 0.0)
        rows = [(t.timestamp(), bool(f), int(e)) for b in batches for t, f, e in zip(b["ts"], b["failed"], b["event_id"], strict=True)]
        held, locks = _lock(held, rows, within, locked)
        state.update((held[0], held[1]))
        if locks:
            yield pd.DataFrame([(key[0], e, u) for e, u in locks], columns=["user_id", "event_id", "locked_until"])

    return events.groupBy("user_id").applyInPandasWithState(step, LOCKS, "recent array<double>, until double", "append", GroupStateTimeout.NoTimeout)


def lockouts_batch(events: DataFrame, within: float = WITHIN, locked: float = LOCKED) -> DataFrame:
    """The same of a table. A user's rows come sorted, batch by batch, and between batches only the state is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, ([], 0.0)
        for batch in batches:
            for key, group in batch.groupby("user_id", sort=False):
                if key != user:
                    user, state = key, ([], 0.0)
                rows = [(t.timestamp(), bool(f), int(e)) for t, f, e in zip(group["ts"], group["failed"], group["event_id"], strict=True)]
                state, locks = _lock(state, rows, within, locked)
                if locks:
                    yield pd.DataFrame([(key, e, u) for e, u in locks], columns=["user_id", "event_id", "locked_until"])

    dealt = events.where("user_id is not null").select("user_id", "event_id", "ts", "failed").repartition("user_id").sortWithinPartitions("user_id", "ts", "failed", "event_id")
    return dealt.mapInPandas(run, LOCKS)


PAIRS = "session_id bigint, turn bigint, question_turn bigint"


def pair_turns(messages: DataFrame) -> DataFrame:
    """Each answer of a stream with the turn of the last user message before it in its session; turns arrive in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked = state.get[0] if state.exists else None
        out = []
        for turn, role in sorted((int(t), r) for b in batches for t, r in zip(b["turn"], b["role"], strict=True)):
            if role == "user":
                asked = turn
            elif role == "assistant":
                out.append((key[0], turn, asked))
        state.update((asked,))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "turn", "question_turn"]).astype({"question_turn": "Int64"})

    return messages.groupBy("session_id").applyInPandasWithState(step, PAIRS, "asked bigint", "append", GroupStateTimeout.NoTimeout)


def pair_turns_batch(messages: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order)
    return messages.withColumn("question_turn", asked).where("role = 'assistant'").select("session_id", "turn", "question_turn")


def ingest_stream(spark: SparkSession, source: str, schema: str, chunks: str, checkpoint: str) -> StreamingQuery:
    """Chunks of all documents that arrive as Parquet files in source, partitioned by the batch that brought them.

    A batch overwrites its own partition, so that one that is run again after a failure leaves no rows twice."""

    def write(batch: DataFrame, number: int) -> None:
        found = ingest.chunk_text(batch.withColumn("page", F.lit(1)))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(chunks)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_documents(docs: DataFrame, kinds: list[tuple[str, list[str]]], least: int = 1) -> dict[str, DataFrame]:
    """What ingestion makes of documents (doc_id, title, text): chunks, rows told in lines of their texts, the kind, and a
    status, which is failed, with a message, where a text has fewer than least characters."""
    from ..operators.retrieval import label_by_markers

    chunks = ingest.chunk_text(docs.withColumn("page", F.lit(1)))
    rows = ingest.parse_row_lines(docs.select(F.col("doc_id").alias("document"), "text"))
    kind = label_by_markers(docs.withColumn("named", F.concat_ws(" ", "title", "text")), "named", kinds, "general", "kind").select("doc_id", "kind")
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    status = docs.select("doc_id", F.when(size >= least, "done").otherwise("failed").alias("status"), F.when(size < least, F.concat(F.lit("reason=low_text extracted="), size, F.lit(f" threshold={least}"))).alias("message"))
    return {"chunks": chunks, "rows": rows, "kinds": kind, "status": status}


def ingest_all(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, kinds: list[tuple[str, list[str]]], attempts: int = 3) -> StreamingQuery:
    """ingest_documents for all documents that arrive in source; the tables are read by Tables(spark, target).

    A batch becomes visible in all tables at once, and its documents replace earlier ones of the same ids. A batch that
    fails is tried again, attempts times in all; then its documents are recorded as failed with the error, and have
    nothing else, so that the stream goes on and later files are taken. A batch that is run again changes nothing."""
    tables = Tables(spark, target)

    def write(batch: DataFrame, number: int) -> None:
        ids = batch.select("doc_id")
        for left in range(attempts - 1, -1, -1):
            try:
                tables.commit(str(number), ingest_documents(batch, kinds), ids)
                return
            except Exception as error:  # noqa: BLE001
                if not left:
                    failed = batch.select("doc_id", F.lit("failed").alias("status"), F.lit(f"reason=error {type(error).__name__} attempts={attempts}").alias("message"))
                    tables.commit(str(number), {"status": failed}, ids)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
