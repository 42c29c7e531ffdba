"""Folding turns of many sessions as they come in, with state per session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session long, kind string, turn long, seq long, role string, text string"
STATE = "turn long, seq long, pinned int, talked boolean, held string"


def snippet(text: str, size: int = 280) -> str:
    return " ".join(text.split())[:size]


def _summary(turn: int, rows: list[list]) -> str:
    transcript = "\n\n".join(f"[{role}] {text}" for _, role, text in rows if text and text.strip())
    return f"[turn] {snippet(transcript)} (recall: turn-{turn:04d})"


def fold_stream(messages: DataFrame, size: int, *, most_pinned: int = 4) -> DataFrame:
    """A stream of messages (session, seq, role, text) as a changelog of compacted histories.

    A turn is finished when the next user message comes; then it is emitted in full, and the
    turn that leaves the window of `size` turns is emitted as its summary (a summary row of
    (session, turn) replaces the turn's full rows).  The state of a session is its window and
    its open turn only.  Each seq is folded once: repeated deliveries are passed over.
    """

    def fold(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, seen, pinned, talked, held = state.get if state.exists else (0, -1, 0, False, "[]")
        window = json.loads(held)  # [turn, rows] of open and recent turns
        out: list[tuple] = []
        rows = pd.concat(list(parts)).sort_values("seq")
        for seq, role, text in zip(rows["seq"], rows["role"], rows["text"], strict=True):
            seq = int(seq)
            if seq <= seen:
                continue
            seen = seq
            if role == "system" and not talked and pinned < most_pinned:
                pinned += 1
                out.append((key[0], "pinned", None, seq, role, text))
                continue
            talked = talked or role != "system"
            if role == "user":
                if window:
                    done = window[-1]
                    if size:
                        out += [(key[0], "full_turn", done[0], s, r, t) for s, r, t in done[1]]
                    while len(window) > size:
                        old = window.pop(0)
                        out.append((key[0], "summary", old[0], old[1][0][0], "assistant", _summary(old[0], old[1])))
                turn += 1
                window.append([turn, []])
            if not window:
                window.append([turn, []])
            window[-1][1].append([seq, role, text])
        state.update((turn, seen, pinned, talked, json.dumps(window)))
        yield pd.DataFrame(out, columns=["session", "kind", "turn", "seq", "role", "text"]).astype({"turn": "Int64"})

    return messages.groupBy("session").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def current(changes: DataFrame) -> DataFrame:
    """The compacted histories that a changelog stands for: a summary replaces its turn."""
    replaced = F.max((F.col("kind") == "summary").cast("int")).over(Window.partitionBy("session", "turn")) == 1
    return changes.withColumn("replaced", replaced).where("NOT (replaced AND kind = 'full_turn')").drop("replaced")
