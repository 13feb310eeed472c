"""Reinforcement of records over a log of recalls: a fold in batch, per-key state in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions import memory as M
from tessera.operators import topk

STATE = "stability double, recalled_at long, recalls long"


#: After so many successes nothing within the range of a long is late: 7 days * 1.7 ** 64 are longer.
FIRST = 64


def folded(log: DataFrame, key: str, at: str) -> DataFrame:
    """(key, stability, recalled_at, recalls) after all recalls in order. log: key, at (unix seconds).

    The first event makes the record. A later one strengthens it if it was not forgotten by then; else it leaves it.

    Stability depends on the number of successes alone, and an event that comes too late is followed by later ones: the
    fold ends at the first gap that is too long. Gaps that are allowed grow with each success, so that only the FIRST
    events of a key can have one; of the others their number and the last time are enough. All of that is combined
    before it is shuffled, however many events a key has.
    """
    rows = log.filter(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("long").alias("t"))
    heads = topk.first_k(rows, ["key"], [("t", "ascending")], FIRST)
    per = heads.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.first("total").alias("n"))
    last = rows.groupBy("key").agg(F.max("t").alias("last"))
    per = per.alias("p").join(last.alias("l"), F.col("p.key").eqNullSafe(F.col("l.key"))).select("p.*", "l.last")
    start = F.struct(F.lit(M.BASE_STABILITY).alias("stability"), F.element_at("ts", 1).alias("recalled_at"), F.lit(0).cast("long").alias("recalls"))

    def step(s, t):
        kept = F.exp(-F.greatest((t - s["recalled_at"]) / F.lit(float(M.DAY)), F.lit(0.0)) / F.greatest(s["stability"], F.lit(M.LEAST_STABILITY)))
        grown = F.struct(_grown(s["stability"]).alias("stability"), t.alias("recalled_at"), (s["recalls"] + 1).alias("recalls"))
        return F.when(kept >= M.NEEDS_UPDATE, grown).otherwise(s)

    done = per.select("key", "n", "last", F.aggregate(F.slice("ts", F.lit(2), F.size("ts")), start, step).alias("s"))
    # Nothing was late: all that come after the first ones count too.
    on = (F.col("n") > FIRST) & (F.col("s.recalls") == FIRST - 1)
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - FIRST, F.lit(INFINITE).cast("long"))), F.col("s.stability"), lambda x, _: _grown(x))
    return done.select(
        F.col("key").alias(key),
        F.when(on, more).otherwise(F.col("s.stability")).alias("stability"),
        F.when(on, F.col("last")).otherwise(F.col("s.recalled_at")).alias("recalled_at"),
        F.when(on, F.col("n") - 1).otherwise(F.col("s.recalls")).alias("recalls"),
    )


#: So many successes on, stability is infinite.
INFINITE = 1_400


def _grown(stability: Column) -> Column:
    return F.greatest(stability, F.lit(M.BASE_STABILITY)) * M.GROWTH


class Reinforcement(StatefulProcessor):
    """The same fold, one record's state at a time; late events of a batch are taken in order of their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("record", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import math

        stability, recalled_at, recalls = self.state.get() if self.state.exists() else (None, None, 0)
        for t in sorted(int(x) for part in rows for x in part["at"]):
            if stability is None:
                stability, recalled_at = M.BASE_STABILITY, t
                continue
            kept = math.exp(-max((t - recalled_at) / M.DAY, 0.0) / max(stability, M.LEAST_STABILITY))
            if kept >= M.NEEDS_UPDATE:
                stability, recalled_at, recalls = max(stability, M.BASE_STABILITY) * M.GROWTH, t, recalls + 1
        self.state.update((stability, recalled_at, recalls))
        yield pd.DataFrame({"key": [key[0]], "stability": [stability], "recalled_at": [recalled_at], "recalls": [recalls]})

    def close(self) -> None:
        pass


def streamed(events: DataFrame) -> DataFrame:
    """(key, stability, recalled_at, recalls) updates of a stream of (key long, at long)."""
    return events.groupBy("key").transformWithStateInPandas(Reinforcement(), "key long, " + STATE, "Update", "None")
