"""The most likely sequence of states of long chains, cut into chunks that are worked on apart.

A step has states with a score each and, towards the step before, a matrix of transition scores. Scores are whole numbers
(millionths), so that sums are the same in any order, and NEVER stands for what cannot be. A chain ends at a step without states;
where no state can be reached it ends at the step before and a new one starts. Of equal scores the first state wins.

1. Each chunk is summed up: for each state at its entry (the last step before it) the scores of all states at its exit, the step
   at which nothing that started from that state goes on, and the exit scores if the chain is started anew there.
2. One scan per object over these summaries gives each chunk the scores at its entry.
3. Each chunk finds, for each state at its exit, the state at its entry that the best sequence comes from.
4. One scan back over those gives each chunk its exit state, and the chunks read their sequences off.

A task of 1, 3 or 4 holds one chunk, and of the scans one row for each chunk of an object. Objects of one chunk are read off at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: A score that cannot be, and below which none can.
NEVER = -(1 << 61)
DEAD = NEVER >> 1
SCALE = 1_000_000
#: Steps of a chunk.
CHUNK = 512


def scaled(score: Column) -> Column:
    """A score in millionths; null and infinite ones are NEVER."""
    return F.coalesce(F.when(score > DEAD / SCALE, F.round(score * SCALE).cast("long")), F.lit(NEVER).cast("long"))


def _forward(message: np.ndarray, emission: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the next step's states, and the state that each comes from."""
    total = message[:, None] + move
    back = total.argmax(0)
    best = total[back, np.arange(total.shape[1])]
    return np.where(best > DEAD, best + emission, NEVER), back


class Steps:
    """The steps of one chunk in order: emissions, and the moves from the step before."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("t")
        self.t = pdf.t.tolist()
        self.emission = [np.asarray(e, np.int64) for e in pdf.emission]
        self.move = [np.asarray(m, np.int64).reshape(-1, len(e)) if len(e) and len(m) else np.zeros((0, len(e)), np.int64) for m, e in zip(pdf.move, self.emission, strict=True)]

    def __len__(self) -> int:
        return len(self.t)

    def run(self, message: np.ndarray, at: int = 0, keep: bool = False) -> tuple[np.ndarray, list]:
        """Scores at the exit, and if asked for: of each step whether a chain starts there, its scores and where they come from."""
        kept = []
        for k in range(at, len(self)):
            e, m = self.emission[k], self.move[k]
            ahead = None
            if len(e) and len(message) and len(m) == len(message) and (message > DEAD).any():
                ahead, back = _forward(message, e, m)
            fresh = ahead is None or not (ahead > DEAD).any()
            message = e.copy() if fresh else ahead
            if keep:
                kept.append((fresh, message, None if fresh else back))
        return message, kept

    def summary(self, n_entry: int) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Of each entry state: the step at which it dies (or the number of steps), its exit scores, and the exit scores of a
        chain started anew at that step."""
        died, ends, anew, known = [], [], [], {}
        for i in range(n_entry):
            message = np.full(n_entry, NEVER)
            message[i] = 0
            k = 0
            while k < len(self):
                e, m = self.emission[k], self.move[k]
                if not len(e) or len(m) != len(message):
                    break
                ahead, _ = _forward(message, e, m)
                if not (ahead > DEAD).any():
                    break
                message, k = ahead, k + 1
            died.append(k)
            ends.append(message.tolist() if k == len(self) else [])
            if k < len(self) and k not in known:
                known[k] = self.run(np.zeros(0, np.int64), k)[0].tolist()
            anew.append(known.get(k, []))
        if not n_entry:
            died, ends, anew = [0], [[]], [self.run(np.zeros(0, np.int64))[0].tolist()]
        return died, ends, anew


def passed(message: np.ndarray, died: list[int], ends: list, anew: list) -> np.ndarray:
    """Scores at the exit of a chunk from those at its entry and its summary."""
    live = [i for i in range(len(message)) if message[i] > DEAD]
    through = [i for i in live if len(ends[i])]
    if through:
        rows = np.array([ends[i] for i in through], np.int64)
        return np.where(rows > DEAD, rows + message[through][:, None], NEVER).max(0)
    if not live:
        return np.asarray(anew[0], np.int64) if not len(message) else np.zeros(0, np.int64)
    return np.asarray(anew[max(live, key=lambda i: died[i])], np.int64)


def _traced(steps: Steps, message: np.ndarray, kept: list, exit_state: int) -> tuple[list[int], int]:
    """State of each step (-1 without states), and the entry state (-1 for none), if the chunk is left in exit_state."""
    out, state = [-1] * len(steps), exit_state
    first = lambda scores: int(scores.argmax()) if len(scores) and (scores > DEAD).any() else -1
    for k in range(len(steps) - 1, -1, -1):
        fresh, _, back = kept[k]
        out[k] = state
        before = kept[k - 1][1] if k else message
        state = first(before) if fresh or state < 0 else int(back[state])
    return out, state


def most_likely(steps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """oid, t, state: the place of the chosen state in emission (from 0), null at steps without states.

    steps: oid long, t long (0, 1, ... in each object), n_before int (number of states of the step before, 0 at the first one),
    emission array<long>, move array<long> (n_before rows by as many columns as emission, row by row; empty if either is).
    """
    parts = stored(steps.withColumn("chunk", F.floor(F.col("t") / chunk).cast("long")), "steps")
    long = stored(parts.where("chunk > 0").select("oid").distinct(), "long")
    kind = "oid long, t long, state int"

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Steps(pdf)
        last, kept = s.run(np.zeros(0, np.int64), keep=True)
        states, _ = _traced(s, np.zeros(0, np.int64), kept, int(last.argmax()) if len(last) else -1)
        return pd.DataFrame({"oid": int(pdf.oid.iloc[0]), "t": s.t, "state": pd.array([None if x < 0 else x for x in states], "Int32")})

    # An object of one chunk needs no scans.
    short = parts.join(long, "oid", "left_anti").groupBy("oid").applyInPandas(alone, kind)
    if long.isEmpty():
        return short
    parts = parts.join(long, "oid", "left_semi")
    first = parts.groupBy("oid", "chunk").agg(F.min_by("n_before", "t").alias("n_entry"))
    nested = "array<array<long>>"

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        died, ends, anew = Steps(pdf).summary(int(pdf.sort_values("t").n_before.iloc[0]))
        return pd.DataFrame([(int(pdf.oid.iloc[0]), int(pdf.chunk.iloc[0]), died, ends, anew)], columns=["oid", "chunk", "died", "ends", "anew"])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        message, rows = np.zeros(0, np.int64), []
        for oid, c, died, ends, anew in pdf.sort_values("chunk").itertuples(index=False):
            rows.append((oid, c, message.tolist()))
            message = passed(message, list(died), list(ends), list(anew))
        return pd.DataFrame(rows, columns=["oid", "chunk", "entry"])

    sums = parts.groupBy("oid", "chunk").applyInPandas(summarise, f"oid long, chunk long, died array<int>, ends {nested}, anew {nested}")
    entries = stored(sums.groupBy("oid").applyInPandas(enter, "oid long, chunk long, entry array<long>"), "entries")
    with_entry = parts.join(entries, ["oid", "chunk"])

    def origins(pdf: pd.DataFrame) -> pd.DataFrame:
        s, message = Steps(pdf), np.asarray(pdf.entry.iloc[0], np.int64)
        last, kept = s.run(message, keep=True)
        come = [_traced(s, message, kept, j)[1] for j in range(len(last))] or [_traced(s, message, kept, -1)[1]]
        best = int(last.argmax()) if len(last) else -1
        return pd.DataFrame([(int(pdf.oid.iloc[0]), int(pdf.chunk.iloc[0]), come, best)], columns=["oid", "chunk", "come", "best"])

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, state = [], None
        for oid, c, come, best in pdf.sort_values("chunk", ascending=False).itertuples(index=False):
            state = best if state is None else state
            rows.append((oid, c, state))
            state = int(come[state if state >= 0 else 0])
        return pd.DataFrame(rows, columns=["oid", "chunk", "exit"])

    maps = with_entry.groupBy("oid", "chunk").applyInPandas(origins, "oid long, chunk long, come array<int>, best int")
    exits = stored(maps.groupBy("oid").applyInPandas(leave, "oid long, chunk long, exit int"), "exits")

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        s, message = Steps(pdf), np.asarray(pdf.entry.iloc[0], np.int64)
        _, kept = s.run(message, keep=True)
        states, _ = _traced(s, message, kept, int(pdf.exit.iloc[0]))
        return pd.DataFrame({"oid": int(pdf.oid.iloc[0]), "t": s.t, "state": pd.array([None if x < 0 else x for x in states], "Int32")})

    return short.unionByName(with_entry.join(exits, ["oid", "chunk"]).groupBy("oid", "chunk").applyInPandas(read, kind))
