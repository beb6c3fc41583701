"""Sequences of symbols against a table of transitions (state, symbol, target), in one go or symbol by symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Transitions = dict[tuple[str, str], str]


def end_state(symbols: Column, transitions: Transitions, start: str) -> Column:
    """The state after an array of symbols; null once a symbol isn't expected."""
    table = F.create_map(*(F.lit(x) for (s, c), t in transitions.items() for x in (f"{s}\t{c}", t)))
    return F.aggregate(symbols, F.lit(start), lambda s, c: F.try_element_at(table, F.concat(s, F.lit("\t"), c)))


def accepted(symbols: Column, transitions: Transitions, start: str, final: list[str]) -> Column:
    return F.coalesce(end_state(symbols, transitions, start).isin(*final), F.lit(False))


def end_states(rows: DataFrame, key: str, order: list[str], symbol: str, transitions: Transitions, start: str, chunk: int = 1000) -> DataFrame:
    """key, state: the state after all symbols of a key in their order; null once a symbol isn't expected.

    A key's symbols are cut into chunks, and a chunk is reduced to the states it leads to from
    each state, so that no more than chunk symbols, or the maps of one key's chunks, are gathered.
    """
    states = sorted({start} | {x for (s, _), t in transitions.items() for x in (s, t)})
    place = F.create_map(*(F.lit(x) for k, s in enumerate(states) for x in (s, k)))
    numbered = rows.select(key, F.col(symbol).alias("c"), F.row_number().over(W.partitionBy(key).orderBy(*order)).alias("k"))
    symbols = F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])
    chunks = numbered.groupBy(key, F.expr(f"(k - 1) div {chunk}").alias("part")).agg(symbols.alias("symbols"))
    leads = chunks.select(key, "part", F.array(*(end_state(F.col("symbols"), transitions, s) for s in states)).alias("to"))
    maps = F.transform(F.sort_array(F.collect_list(F.struct("part", "to"))), lambda x: x["to"])
    joined = leads.groupBy(key).agg(maps.alias("maps"))
    return joined.select(key, F.aggregate("maps", F.lit(start), lambda s, m: F.get(m, F.try_element_at(place, s))).alias("state"))


def expected(transitions: Transitions, state: str) -> list[str]:
    """The symbols that may follow, sorted."""
    return sorted({c for s, c in transitions if s == state})


def follow(stream: DataFrame, key: str, symbol: str, transitions: Transitions, start: str, final: list[str], time: str | None = None, idle_seconds: int = 0, late: str = "0 seconds") -> DataFrame:
    """key, accepted_n, state, complete, error for a stream of symbols, updated with each batch. After an error a key stays in it.

    The rows of a batch must come in order for each key; the state is one string and one number.
    With a column `time`, a key from which nothing has come for idle_seconds of event time is told
    once more, as `expired` with what was expected next unless it is complete or in error, and its
    state is dropped: what comes later begins anew. The watermark is `late` behind the latest event.
    """
    timed = time is not None

    def step(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, n, error, last = held.get if held.exists else (start, 0, "", 0)
        if held.hasTimedOut:
            held.remove()
            if not error and state not in final:
                error = f"expired after {n} symbols; expected: {', '.join(expected(transitions, state))}"
            yield pd.DataFrame({key: [name[0]], "accepted_n": [n], "state": [state], "complete": [not error and state in final], "error": [error], "expired": [True]})
            return
        for batch in batches:
            if timed and len(batch):
                last = max(last, int(batch[time].max().timestamp() * 1000))
            for c in batch[symbol]:
                if error:
                    break
                target = transitions.get((state, c))
                if target is None:
                    error = f"{c} after {n} symbols; expected: {', '.join(expected(transitions, state))}"
                else:
                    state, n = target, n + 1
        held.update((state, n, error, last))
        if timed:
            held.setTimeoutTimestamp(max(last + 1000 * idle_seconds, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]], "accepted_n": [n], "state": [state], "complete": [not error and state in final], "error": [error], "expired": [False]})

    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, accepted_n long, state string, complete boolean, error string, expired boolean"
    rows = stream.withWatermark(time, late) if timed else stream
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(step, out, "state string, n long, error string, last long", "update", timeout)
