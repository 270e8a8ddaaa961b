"""Conversations as a stream: keyed state turns messages into requests, and each micro-batch answers its requests as the batch code does."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillon.operators.chat import SPEAKERS
from quillon.streaming.progress import append_json

REQUEST = "id string, conv_id long, turn long, question string, history string, answered int, closed boolean"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Conversation(StatefulProcessor):
    """State of one conversation: its last ``most`` lines and the number of replies.

    A user turn goes out as a request, with the history before it.  A
    conversation without a message for ``idle_ms`` goes out as closed, with its
    state, and begins anew afterwards.
    """

    def __init__(self, most: int = 20, idle_ms: int | None = None) -> None:
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.talk = handle.getValueState("talk", "lines string, answered int")

    def _held(self) -> tuple[list[str], int]:
        if not self.talk.exists():
            return [], 0
        lines, answered = self.talk.get()
        return json.loads(lines), answered

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = pd.concat(list(rows)).sort_values("turn", kind="stable")
        lines, answered = self._held()
        out = []
        for turn, role, text in zip(told["turn"].tolist(), told["role"].tolist(), told["text"].tolist(), strict=True):
            if role == "user":
                out.append((f"{key[0]}:{turn}", key[0], turn, text or "", "\n".join(lines), answered, False))
            answered += role == "assistant"
            if role in SPEAKERS:
                lines = [*lines, SPEAKERS[role] + (text or "")][-self.most :]
        self.talk.update((json.dumps(lines, ensure_ascii=False), answered))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REQUEST.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lines, answered = self._held()
        self.talk.clear()
        yield pd.DataFrame([(f"{key[0]}:closed", key[0], None, None, "\n".join(lines), answered, True)], columns=[c.split()[0] for c in REQUEST.split(", ")])

    def close(self) -> None:
        pass


def stream_requests(turns: DataFrame, most: int = 20, idle_ms: int | None = None) -> DataFrame:
    """Requests, as ``operators.chat.turn_requests`` gives, of a stream of (conv_id, turn, role, text); and ``closed`` rows of idle conversations.

    The turns of a conversation must arrive in their order, those of one
    micro-batch in any.  Needs the RocksDB state store (``STORE``).
    """
    rows = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return rows.transformWithStateInPandas(Conversation(most, idle_ms), outputStructType=REQUEST, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")


def answer_stream(turns: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, most: int = 20, idle_ms: int | None = None) -> StreamingQuery:
    """Answers every user turn of the stream and appends the rows of ``answer`` to the log at ``path``, once for each micro-batch, also if one is run again.

    ``answer`` takes requests and returns rows, as ``operators.agent.answer_turns`` does.
    Without ``idle_ms`` the query ends when all there is has been read; with it
    it waits for timers, and runs until it is stopped.
    """

    def write(requests: DataFrame, number: int) -> None:
        append_json(answer(requests.where("not closed").drop("closed")), path, number)

    out = stream_requests(turns, most, idle_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if idle_ms is None else out.trigger(processingTime="1 second")).start()
