"""Queries of one or two events over streams of steps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import CompilationError
from ..functions.expressions import action_text, column
from ..operators.match import extend, steps_of
from ..plans.validate import Checked, Event, names, walk
from ..sources.trace import Trace


def stream_query(steps: DataFrame, c: Checked) -> DataFrame:
    """The query's rows as steps arrive: filter, explode and project, without state.

    Only patterns of modifications and rules and event measures: what depends on
    the state of agents needs the batch tables. With ``every``, see ``throttled``.
    """
    e = c.path[0]
    if not c.single or any(s.int_test or s.lnk_test for a in e.defining.agents for s in a.sites):
        raise CompilationError("only single events and modifications can be streamed")
    if any(x.op == "measure" and x.side for r in (*c.query.returns, c.query.when) for x in walk(r)):
        raise CompilationError("state measures cannot be streamed")
    rows = _matched(steps, e)

    def measure(x):
        if x.op == "agent_id":
            return F.col(f"a_{x.agent}")
        if x.op == "event_id":
            return F.col("step")
        return action_text(F.col("actions")) if x.name == "debug_event" else F.col({"time": "time", "rule": "rule", "sim_event_id": "sim"}[x.name])

    labels = c.query.legend or [f"c{k}" for k in range(len(c.query.returns))]
    kept = F.lit(True) if c.query.when is None else column(c.query.when, measure).cast("boolean")
    out = rows.select("trace_id", "step", "time", kept.alias("_kept"), *[column(x, measure).alias(n) for x, n in zip(c.query.returns, labels)])
    if c.query.every is not None:
        out = throttled(out, c.query.every)
    null = F.raise_error(F.lit("the condition of 'when' is null")).cast("boolean")
    return out.where(F.when(F.col("_kept").isNull(), null).otherwise(F.col("_kept"))).select(*labels)


def _matched(steps: DataFrame, e: Event) -> DataFrame:
    trace = Trace(steps)
    return extend(trace, steps_of(trace), e.defining, tag="d")


def stream_pair(steps: DataFrame, c: Checked) -> DataFrame:
    """Rows of a query of two events, ``first b after a`` or ``last b before a``, as steps arrive.

    Only patterns of modifications and rules, without auxiliary patterns, and event
    measures. For each tuple of link agents the state holds the matches of the
    latest candidate step (``last``), or the anchors that wait for their first
    candidate (``first``; these stay until one comes). Steps of a trace must arrive
    in order between batches.
    """
    if len(c.path) != 2 or any(e.auxiliary is not None or any(s.int_test or s.lnk_test for a in e.defining.agents for s in a.sites) for e in c.path):
        raise CompilationError("only pairs of events and modifications can be streamed")
    if any(x.op == "measure" and x.side for r in (*c.query.returns, c.query.when) if r is not None for x in walk(r)):
        raise CompilationError("state measures cannot be streamed")
    root, other = c.path
    back = other.relation == "last"

    def side(e: Event, turn: int) -> DataFrame:
        rows = _matched(steps, e)
        link = F.concat_ws(" ", *[F.col(f"a_{a}").cast("string") for a in other.link]) if other.link else F.lit("")
        held = F.to_json(F.struct("step", "time", "rule", "sim", action_text(F.col("actions")).alias("text"), *[f"a_{a}" for a in names(e.defining)]))
        return rows.select("trace_id", link.alias("link"), F.col("step").alias("at"), F.lit(turn).alias("turn"), held.alias("held"))

    def pick(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["at", "turn"], kind="stable")
        held = json.loads(state.get[0]) if state.exists else []
        out = []
        for _, now in pdf.groupby("at", sort=True):
            anchors, found = now["held"][now["turn"] == 0].tolist(), now["held"][now["turn"] == 1].tolist()
            if back:
                out += [(a, b) for a in anchors for b in held]
                held = found or held
            else:
                out += [(a, b) for a in held for b in found]
                held = ([] if found else held) + anchors
        state.update((json.dumps(held),))
        yield pd.DataFrame({"trace_id": key[0], "a": [a for a, _ in out], "b": [b for _, b in out]})

    both = side(root, 0).unionByName(side(other, 1))
    pairs = both.groupBy("trace_id", "link").applyInPandasWithState(pick, "trace_id string, a string, b string", "held string", "append", GroupStateTimeout.NoTimeout)

    def typed(e: Event) -> str:
        return "step bigint, time double, rule string, sim bigint, text string" + "".join(f", a_{a} bigint" for a in names(e.defining))

    rows = pairs.select("trace_id", F.from_json("a", typed(root)).alias(f"e_{root.name}"), F.from_json("b", typed(other)).alias(f"e_{other.name}"))

    def measure(x):
        if x.op == "agent_id":
            e = root if x.agent in names(root.defining) else other
            return F.col(f"e_{e.name}.a_{x.agent}")
        field = "step" if x.op == "event_id" else {"time": "time", "rule": "rule", "sim_event_id": "sim", "debug_event": "text"}[x.name]
        return F.col(f"e_{x.event}.{field}")

    labels = c.query.legend or [f"c{k}" for k in range(len(c.query.returns))]
    kept = F.lit(True) if c.query.when is None else column(c.query.when, measure).cast("boolean")
    null = F.raise_error(F.lit("the condition of 'when' is null")).cast("boolean")
    return rows.where(F.when(kept.isNull(), null).otherwise(kept)).select(*[column(x, measure).alias(n) for x, n in zip(c.query.returns, labels)])


def throttled(rows: DataFrame, delay: float) -> DataFrame:
    """Rows of events at least ``delay`` after the last accepted one of their trace; the state is one time and step a trace.

    Steps of a trace must arrive in order between batches.
    """
    cols = rows.columns

    def pick(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("step")
        last, accepted = state.get if state.exists else (float("-inf"), -1)
        keep = []
        for step, t in zip(pdf["step"], pdf["time"]):
            if step != accepted and t - last >= delay:
                last, accepted = float(t), int(step)
            keep.append(step == accepted)
        state.update((last, accepted))
        yield pdf[keep][cols]

    return rows.groupBy("trace_id").applyInPandasWithState(pick, rows.schema, "last double, step bigint", "append", GroupStateTimeout.NoTimeout)
