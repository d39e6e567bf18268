"""The device's side of a plot as keyed state: a log of its replies decides what is sent, line by line.

Nothing here opens a port: ``replay`` says which message each reply releases, for a log that is a table or a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the protocol.
READY, OK, END = "READY", "OK", "END"
FAULTS = ("ERROR", "EMERGENCY")
SCHEMA = "device string, seq bigint, reply string, state string, sent bigint"


class Handshake:
    """State of one device: waiting for READY, waiting for OK, done, or failed; ``sent`` commands so far."""

    def __init__(self, state: str = "waiting", sent: int = 0) -> None:
        self.state, self.sent = state, sent

    def reply(self, line: str, commands: int) -> None:
        """Only the exact words READY and OK lead on; an error counts while a command is open; other text is ignored."""
        line = line.strip()
        if self.state == "waiting" and line == READY:
            self.state, self.sent = ("sending", 1) if commands else ("done", 0)
        elif self.state == "sending" and line == OK:
            if self.sent == commands:
                self.state = "done"
            else:
                self.sent += 1
        elif self.state == "sending" and line.startswith(FAULTS):
            self.state = "failed"


def replay(replies: DataFrame, commands: int) -> DataFrame:
    """``(device, seq, reply, state, sent)`` after each reply of ``replies(device, seq, line)``, in order of ``seq``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hand, out = Handshake(), []
        for r in rows.sort_values("seq").itertuples():
            hand.reply(r.line or "", commands)
            out.append((r.device, r.seq, r.line, hand.state, hand.sent))
        return pd.DataFrame(out, columns=["device", "seq", "reply", "state", "sent"])

    return replies.select(F.col("device").cast("string").alias("device"), F.col("seq").cast("long").alias("seq"), "line").groupBy("device").applyInPandas(run, SCHEMA)


def replay_stream(replies: DataFrame, commands: int) -> DataFrame:
    """The same over a stream whose replies arrive in order for each device; state is kept between batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hand, out = Handshake(*state.get) if state.exists else Handshake(), []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            hand.reply(r.line or "", commands)
            out.append((key[0], r.seq, r.line, hand.state, hand.sent))
        state.update((hand.state, hand.sent))
        yield pd.DataFrame(out, columns=["device", "seq", "reply", "state", "sent"])

    rows = replies.select(F.col("device").cast("string").alias("device"), F.col("seq").cast("long").alias("seq"), "line")
    return rows.groupBy("device").applyInPandasWithState(run, SCHEMA, "state string, sent bigint", "append", GroupStateTimeout.NoTimeout)


def send(commands: list[str], read_line, write) -> None:  # noqa: ANN001
    """Send commands over an open connection: wait for READY, then one command an OK, then END; an error reply is raised."""
    hand = Handshake()
    while hand.state == "waiting":
        hand.reply(read_line(), len(commands))
    for i, line in enumerate(commands):
        write(line + "\n")
        while hand.state == "sending" and hand.sent == i + 1:
            reply = read_line()
            hand.reply(reply, len(commands))
            if hand.state == "failed":
                raise RuntimeError(reply.strip())
    write(END + "\n")
