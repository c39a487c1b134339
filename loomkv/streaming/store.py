"""A keyed store as streaming state: every command is answered from the state that its key has by then."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomkv.shipping import ship

REPLIES = "key string, seq bigint, op string, reply double, hit boolean"


class Store(StatefulProcessor):
    """One entry per key: value and expiry in microseconds of event time. An entry is valid up to and including its expiry.

    With expires, a timer clears an entry once the watermark is past its expiry, so state doesn't grow with keys that are gone.
    """

    def __init__(self, expires: bool = False):
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value double, expires_us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        now = self.entry.get() if self.entry.exists() else None
        out = []
        for ts, seq, op, value, ttl in zip(batch["ts"], batch["seq"], batch["op"], batch["value"], batch["ttl_s"]):
            us = ts.value // 1000
            live = now is not None and (now[1] is None or us <= now[1])
            out.append((key[0], seq, op, now[0] if op == "GET" and live else None, live))
            if op == "SET":
                now = (float(value), None if pd.isna(ttl) else us + int(ttl) * 1_000_000)
            elif op == "DEL":
                now = None
        if now is None:
            self.entry.clear()
        else:
            self.entry.update(now)
            if self.expires and now[1] is not None:
                self.handle.registerTimer(now[1] // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "seq", "op", "reply", "hit"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.entry.get() if self.entry.exists() else None
        if now is not None and now[1] is not None and now[1] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():  # else it was set again since
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def replies(commands: DataFrame, late: str | None = None) -> DataFrame:
    """A reply per command of a stream with key, seq, ts, op, value, ttl_s.

    late: how far behind the latest one a command may come; later ones are dropped, and entries that expired before
    that leave the state. Without it all commands are answered and nothing leaves.
    """
    ship(commands.sparkSession)
    stream = commands.withWatermark("ts", late) if late else commands
    mode = "EventTime" if late else "None"
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=Store(late is not None), outputStructType=REPLIES, outputMode="Append", timeMode=mode)
