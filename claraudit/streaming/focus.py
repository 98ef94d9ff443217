"""Keyboard traps in a log of focus: an automaton over ordered events that Escape resets, as windows and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Focused elements that are remembered.
MEMORY = 4


def focus_traps(log: DataFrame) -> DataFrame:
    """Batch: log (session, seq, key: the focused element, or null for Escape) to session, seq, key, pattern ('stuck' or
    'cycle') and trapped of each row where a pattern shows.

    stuck: the last three are one element and nothing came before them, or the last four are; cycle: A, B, A, B. Escape
    forgets all; the first focus behind it is a probe, which isn't remembered: if it is the element where the pattern showed
    last, just before Escape, the session is trapped there."""
    order = Window.partitionBy("session").orderBy("seq")
    rows = log.withColumn("_part", F.sum(F.when(F.col("key").isNull(), 1).otherwise(0)).over(order))
    rows = rows.filter("key is not null")
    part = Window.partitionBy("session", "_part").orderBy("seq")
    rows = rows.withColumn("_n", F.row_number().over(part) - F.when(F.col("_part") > 0, 1).otherwise(0))  # 0: a probe
    k = [F.col("key"), *[F.lag("key", i).over(part) for i in (1, 2, 3)]]
    rows = rows.withColumns({"_k1": k[1], "_k2": k[2], "_k3": k[3], "_probe": F.lead("key").over(order), "_next": F.lead("_part").over(order)})
    same = (F.col("key") == F.col("_k1")) & (F.col("_k1") == F.col("_k2"))
    stuck = same & ((F.col("_n") == 3) | ((F.col("_n") > 3) & (F.col("_k2") == F.col("_k3"))))
    cycle = (F.col("_n") >= MEMORY) & (F.col("key") == F.col("_k2")) & (F.col("_k1") == F.col("_k3")) & (F.col("key") != F.col("_k1"))
    pattern = F.when(stuck, "stuck").when(cycle, "cycle")
    trapped = F.coalesce((F.col("_next") == F.col("_part") + 1) & (F.col("_probe") == F.col("key")), F.lit(False))
    return rows.withColumn("pattern", pattern).filter("pattern is not null").select("session", "seq", "key", "pattern", trapped.alias("trapped"))


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    recent, shown, waiting = state.get if state.exists else ([], None, False)
    recent, out = list(recent), []
    for seq, focused in pd.concat(frames).sort_values("seq")[["seq", "key"]].itertuples(index=False):
        if focused is None or focused != focused:
            recent, waiting = [], True
            continue
        if waiting:  # the probe behind Escape
            if shown and shown[1] == focused:
                out.append((key[0], int(shown[0]), shown[1], shown[2], True))
            elif shown:
                out.append((key[0], int(shown[0]), shown[1], shown[2], False))
            shown, waiting = None, False
            continue
        if shown:
            out.append((key[0], int(shown[0]), shown[1], shown[2], False))
            shown = None
        recent = [*recent, focused][-MEMORY:]
        pattern = None
        if len(recent) >= 3 and len(set(recent)) == 1:
            pattern = "stuck"
        elif len(recent) == MEMORY and recent[0] == recent[2] != recent[1] == recent[3]:
            pattern = "cycle"
        if pattern:
            shown = (str(seq), focused, pattern)
    state.update((recent, list(shown) if shown else None, waiting))
    yield pd.DataFrame(out, columns=["session", "seq", "key", "pattern", "trapped"])


def focus_traps_stream(log: DataFrame) -> DataFrame:
    """Streaming: the same rows, each when the event behind its pattern has come. State is four keys a session and the pattern
    that waits for its probe."""
    return log.groupBy("session").applyInPandasWithState(_step, "session long, seq long, key string, pattern string, trapped boolean", "recent array<string>, shown array<string>, waiting boolean", "append", GroupStateTimeout.NoTimeout)
