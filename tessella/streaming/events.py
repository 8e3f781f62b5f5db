"""Streams of events and jobs: roll-ups, windows, ingest without repeats, stateful machines. Every function that is not
about state works on batches as on streams, so one can be held against the other."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.session import shared_dir


def timed(events: DataFrame, at: str = "ts", late: str | None = None) -> DataFrame:
    """Events with their time as a timestamp, in UTC by the session, and, on streams, a watermark."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late) if late else rows


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    of = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return of.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n of runs of a user's events that no gap parts."""
    of = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return of.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def new_documents(incoming: DataFrame, known: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """Incoming documents whose content isn't known, one of each."""
    return incoming.dropDuplicates([content_hash]).join(known.select(content_hash).distinct(), content_hash, "left_anti")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads its result back. Checkpoint and result lie in the shared folder; each
    batch has a folder of its own that a repeated run overwrites, so a batch counts once."""
    import uuid

    spark = stream.sparkSession
    base, written = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        written.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:  # nothing was there, so no batch was run
        return spark.createDataFrame([], stream.schema)
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch")


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A table as a stream, be it one file or a folder of parts: the pattern names the table itself, whatever its parts are called."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


# The moves of a job's state machine.
MOVES = {"queued": {"start": "running", "cancel": "cancelled"}, "running": {"succeed": "succeeded", "fail": "failed", "cancel": "cancelled", "restart": "failed"}, "failed": {"retry": "queued"}, "cancelled": {"retry": "queued"}}


def _advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, moves = state.get if state.exists else ("queued", 0)
    rows = pd.concat(list(batches)).sort_values(["seq"])
    for action in rows["action"]:
        after = MOVES.get(status, {}).get(action)
        if after:
            status, moves = after, moves + 1
    state.update((status, moves))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "moves": [moves]})


def job_states(actions: DataFrame) -> DataFrame:
    """job_id, status, moves after each batch of actions (job_id, seq, action); a move that a state lacks is ignored."""
    kind = actions.schema["job_id"].dataType.simpleString()
    out = f"job_id {kind}, status string, moves int"
    return actions.groupBy("job_id").applyInPandasWithState(_advance, out, "status string, moves int", "update", GroupStateTimeout.NoTimeout)


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what ran has failed, what was queued is queued again in its order."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


TAG_PART = re.compile(r"<[^>]*$")
OPEN, CLOSE = re.compile(r"<think\b[^>]*>", re.IGNORECASE), re.compile(r"</think\s*>", re.IGNORECASE)


class VisibleText:
    """Passes on what stands outside think tags, however the text is cut into pieces."""

    def __init__(self, held: str = "", hidden: bool = False):
        self.held, self.hidden = held, hidden

    def feed(self, piece: str) -> str:
        text, out = self.held + piece, []
        self.held = ""
        while text:
            found = (CLOSE if self.hidden else OPEN).search(text)
            if found:
                if not self.hidden:
                    out.append(text[: found.start()])
                text, self.hidden = text[found.end() :], not self.hidden
                continue
            part = TAG_PART.search(text)
            start = part.start() if part and len(text) - part.start() < 64 else len(text)
            if not self.hidden:
                out.append(text[:start])
            self.held, text = text[start:], ""
        return "".join(out)

    def finish(self) -> str:
        rest, self.held = ("" if self.hidden else self.held), ""
        return rest


def _filter(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, hidden, read = state.get if state.exists else ("", False, None)
    reader, out = VisibleText(held, hidden), []
    rows = pd.concat(list(batches))
    ends = rows["last"] if "last" in rows else [False] * len(rows)
    for seq, piece, last in sorted(zip(rows["seq"], rows["piece"], ends), key=lambda r: r[0]):
        if read is not None and seq <= read:
            continue
        out.append(reader.feed(piece or "") + (reader.finish() if last else ""))
        read = int(seq)
    state.update((reader.held, reader.hidden, read))
    if out:
        yield pd.DataFrame({"stream_id": [key[0]], "text": ["".join(out)]})


def visible_pieces(pieces: DataFrame) -> DataFrame:
    """stream_id, text: what each batch of pieces (stream_id, seq, piece) adds to the visible text of a stream.

    Pieces come in the order of seq, in a batch in any; one that comes again, in its batch or later, counts once. Pieces
    may have last, true for a stream's last one: what looks like the beginning of a tag is held back until then."""
    kind = pieces.schema["stream_id"].dataType.simpleString()
    return pieces.groupBy("stream_id").applyInPandasWithState(_filter, f"stream_id {kind}, text string", "held string, hidden boolean, read bigint", "append", GroupStateTimeout.NoTimeout)
