"""Histories and file ledgers of many sessions as they come in, with keyed state of several kinds.

A session's state is its window (a list of rows), its ledger (a map by path), the places that were
skipped (a map) and four numbers; no part of it is one text.  Places (seq) of a session are dense:
one that is skipped and comes later is put where it belongs while its turn is held, and is told as
"late" once its turn is a summary; one that was there already is a repeated delivery and changes
nothing.  Sessions that are silent for `idle` lose their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .fold import OUT, _summary

_TOUCH = "array<struct<path:string,kind:string>>"
_META = "turn long, next long, pinned int, talked boolean"
_ROW = "turn long, seq long, role string, text string, paths array<string>, kinds array<string>"
_ENTRY = "first_turn long, last_turn long, reads long, writes long"


class _Session(StatefulProcessor):
    def __init__(self, size: int, most_pinned: int, idle: int | None):
        self.size, self.most_pinned, self.idle = size, most_pinned, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", _META, self.idle)
        self.window = handle.getListState("window", _ROW, self.idle)
        self.skipped = handle.getMapState("skipped", "seq long", "turn long", self.idle)
        self.ledger = handle.getMapState("ledger", "path string", _ENTRY, self.idle)

    def close(self) -> None:
        pass

    def _enter(self, turn: int, rows: list[tuple]) -> bool:
        """Brings a finished turn's touches into the ledger."""
        changed = False
        for row in rows:
            for path, kind in zip(row[4], row[5], strict=True):
                first, last, reads, writes = self.ledger.getValue((path,)) if self.ledger.containsKey((path,)) else (turn, turn, 0, 0)
                self.ledger.updateValue((path,), (min(first, turn), max(last, turn), reads + (kind != "write"), writes + (kind == "write")))
                changed = True
        return changed

    def _rendered(self) -> str:
        rows = sorted((k[0], v) for k, v in self.ledger.iterator())
        return "\n".join(["File ledger (files the agent has touched):", *(f"- {path} — (no description yet)  [r{v[2]}/w{v[3]}]" for path, v in rows)])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, following, pinned, talked = self.meta.get() if self.meta.exists() else (0, 0, 0, False)
        turns: dict[int, list[tuple]] = {}
        for r in self.window.get() if self.window.exists() else ():
            turns.setdefault(r[0], []).append(tuple(r))
        out: list[tuple] = []
        told = False
        parts = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, role, text, touched in zip(parts["seq"], parts["role"], parts["text"], parts["touches"], strict=True):
            seq = int(seq)
            found = [t for t in (touched if touched is not None else ()) if t["path"] is not None]
            row = lambda n: (n, seq, role, text, [t["path"] for t in found], [t["kind"] for t in found])  # noqa: B023, E731
            if seq < following:
                if not self.skipped.containsKey((seq,)):
                    continue
                n = self.skipped.getValue((seq,))[0]
                self.skipped.removeKey((seq,))
                if n in turns:
                    turns[n] = sorted([*turns[n], row(n)], key=lambda r: r[1])
                    if n < turn:  # its turn was told in full
                        told = self._enter(n, [row(n)]) or told
                        out.append((key[0], "full_turn", n, seq, role, text))
                else:
                    told = self._enter(n, [row(n)]) or told
                    out.append((key[0], "late", n, seq, role, text))
                continue
            for missing in range(following, seq):
                self.skipped.updateValue((missing,), (max(turn, 1),))
            following = seq + 1
            if role == "system" and not talked and pinned < self.most_pinned:
                pinned += 1
                out.append((key[0], "pinned", None, seq, role, text))
                continue
            talked = talked or role != "system"
            if role == "user" or not turn:
                if role == "user" and turns.get(turn):
                    told = self._enter(turn, turns[turn]) or told
                    if self.size:
                        out += [(key[0], "full_turn", turn, *r[1:4]) for r in turns[turn]]
                    for old in sorted(turns)[: max(0, len(turns) - self.size)]:
                        gone = turns.pop(old)
                        out.append((key[0], "summary", old, gone[0][1], "assistant", _summary(old, [r[1:4] for r in gone])))
                    turn += 1
                elif not turns.get(turn):
                    turn = max(turn, 0) + 1
            turns.setdefault(turn, []).append(row(turn))
        if told:
            out.append((key[0], "ledger", turn, following - 1, "assistant", self._rendered()))
        self.meta.update((turn, following, pinned, talked))
        held = [r for n in sorted(turns) for r in turns[n]]
        if held:
            self.window.put(held)
        elif self.window.exists():
            self.window.clear()
        yield pd.DataFrame(out, columns=["session", "kind", "turn", "seq", "role", "text"]).astype({"session": "int64", "turn": "Int64", "seq": "int64"})


def fold_sessions(messages: DataFrame, size: int, *, most_pinned: int = 4, idle: int | None = None) -> DataFrame:
    """A stream of messages (session, seq, role, text, touches: path and kind) as a changelog of histories and ledgers.

    As fold_stream(), and when turns end, the session's ledger over all ended turns (kind
    "ledger", the last one counts).  With `idle`, state ends after so many seconds without a change;
    such a stream runs until it is stopped.  Wants timers.with_timers().
    """
    rows = messages.select(F.col("session").cast("long").alias("session"), F.col("seq").cast("long").alias("seq"), "role", "text", F.col("touches").cast(_TOUCH).alias("touches")).where("session IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("session").transformWithStateInPandas(_Session(size, most_pinned, None if idle is None else idle * 1000), OUT, "Append", "none" if idle is None else "processingTime")


def current(changes: DataFrame) -> DataFrame:
    """What a changelog stands for: a summary replaces its turn, the last ledger the others."""
    replaced = F.max((F.col("kind") == "summary").cast("int")).over(Window.partitionBy("session", "turn")) == 1
    latest = F.max(F.when(F.col("kind") == "ledger", F.col("seq"))).over(Window.partitionBy("session"))
    rows = changes.withColumn("replaced", replaced).withColumn("latest", latest)
    return rows.where("NOT (replaced AND kind = 'full_turn') AND (kind <> 'ledger' OR seq = latest)").drop("replaced", "latest")
