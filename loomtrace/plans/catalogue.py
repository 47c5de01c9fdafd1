"""The registered queries over the driver's tables, each with equivalent SQL.

``events`` is read as a trace of users whose site ``did`` holds the type of
their last event; regions, nations and customers form a trace of bonds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.match import steps_of
from ..operators.state import state_at
from ..sources.trace import ACTION, Trace, action, from_events, unique_ids
from .engine import TraceEngine


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_trace(spark: SparkSession, sf_dir: str) -> Trace:
    return Trace(from_events(_read(spark, sf_dir, "events")))


def places_trace(spark: SparkSession, sf_dir: str) -> Trace:
    """Regions, nations bound to them, customers bound to nations; then each nation is closed."""
    region, nation, customer = (_read(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    r = lambda c: c.cast("bigint")
    n = lambda c: (c + 100).cast("bigint")
    c_ = lambda c: (c + 1000).cast("bigint")

    def steps(df, at, rule, *actions):
        return df.select(F.lit("places").alias("trace_id"), at.cast("bigint").alias("step_id"), F.lit("rule").alias("step_kind"), F.lit(rule).alias("rule"), at.cast("double").alias("time"), at.cast("bigint").alias("sim_event_id"), F.array(*actions).cast(f"array<{ACTION}>").alias("actions"))

    site = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rk, nk, ck = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    parts = [
        steps(region, rk, "region", action("create", r(rk), F.lit("Region"))),
        steps(nation, nk + 100, "nation", action("create", n(nk), F.lit("Nation")), action("bind", n(nk), F.lit("Nation"), F.lit("r"), None, r(F.col("n_regionkey")), F.lit("Region"), site("n", nk))),
        steps(customer, ck + 1000, "customer", action("create", c_(ck), F.lit("Customer")), action("bind", c_(ck), F.lit("Customer"), F.lit("n"), None, n(F.col("c_nationkey")), F.lit("Nation"), site("c", ck))),
        steps(nation, nk + F.lit(1 << 40), "close", action("mod", n(nk), F.lit("Nation"), F.lit("open"), F.lit("done"))),
    ]
    return Trace(reduce(DataFrame.unionByName, parts))


_LATER = 1 << 40


def orders_trace(spark: SparkSession, sf_dir: str) -> Trace:
    """Customers, whose slot holds their last order: placing an order frees the one before; an order with status F is shipped, and gone, at once."""
    customer, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    # a given number of partitions is kept: an order is a few bytes, but much work follows, and by its bytes Spark would deal it to one task
    orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    c, k = F.col("o_custkey").cast("bigint"), F.col("o_orderkey").cast("bigint")
    held = F.when(F.lag("o_orderstatus").over(w) != "F", F.lag("o_orderkey").over(w)).cast("bigint")
    o = orders.select(c.alias("c"), (k + _LATER).alias("o"), (2 * k + _LATER).alias("at"), F.col("o_orderstatus").alias("status"), (held + _LATER).alias("held"))
    kinds = F.lit("Customer"), F.lit("Order")
    slot, cust = F.lit("slot"), F.lit("cust")

    def steps(df, at, kind, rule, actions):
        return df.select(F.lit("orders").alias("trace_id"), at.alias("step_id"), F.lit(kind).alias("step_kind"), F.lit(rule).alias("rule"), (at % _LATER).cast("double").alias("time"), at.alias("sim_event_id"), actions.cast(f"array<{ACTION}>").alias("actions"))

    ck = F.col("c_custkey").cast("bigint")
    new = F.array(action("create", ck, kinds[0]), action("mod", ck, kinds[0], F.lit("seg"), F.col("c_mktsegment")), action("free", ck, kinds[0], slot))
    cleared = F.when(F.col("held").isNotNull(), F.array(action("free", F.col("c"), kinds[0], slot), action("free", F.col("held"), kinds[1], cust))).otherwise(F.array().cast(f"array<{ACTION}>"))
    placed = F.concat(cleared, F.array(action("create", F.col("o"), kinds[1]), action("mod", F.col("o"), kinds[1], F.lit("status"), F.col("status")), action("bind", F.col("o"), kinds[1], cust, None, F.col("c"), kinds[0], slot)))
    shipped = F.array(action("remove", F.col("o"), kinds[1]), action("free", F.col("o"), kinds[1], cust, origin="side_src"), action("free", F.col("c"), kinds[0], slot, origin="side_dst"))
    parts = [steps(customer, ck, "init", "_init_", new), steps(o, F.col("at"), "rule", "place", placed), steps(o.where("status = 'F'"), F.col("at") + 1, "rule", "ship", shipped)]
    return Trace(reduce(DataFrame.unionByName, parts))


#: name -> (trace, query text)
TEXTS: dict[str, tuple[str, str]] = {
    "scan_single_event": ("events", "match e:{ u:User(did{/purchase}) } return {'step': event_id{e}, 'user': agent_id{u}, 'at': time[e]}"),
    "any_event": ("events", "match e:{ } return {'step': event_id{e}, 'rule': rule[e], 'sim': sim_event_id[e]}"),
    "rule_disjunction": ("events", "match e:{ 'click'|'view' u:User(did{#/view}) } return {'step': event_id{e}, 'rule': rule[e], 'user': agent_id{u}}"),
    "state_test_before": ("events", "match e:{ u:User(did{view/purchase}) } return {'step': event_id{e}, 'user': agent_id{u}}"),
    "state_before_after": ("events", "match e:{ u:User(did{/error}) } return {'step': event_id{e}, 'was': int_state[.e]{u.did}, 'now': int_state[e.]{u.did}}"),
    "created_agents": ("events", "match e:{ +u:User(did{signup}) } return {'step': event_id{e}, 'user': agent_id{u}}"),
    "debug_event": ("events", "match e:{ +u:User } return {'step': event_id{e}, 'text': debug_event[e]}"),
    "first_after": ("events", "match b:{ u:User(did{/signup}) } and first p:{ u:User(did{/purchase}) } after b return {'user': agent_id{u}, 'signup': event_id{b}, 'purchase': event_id{p}, 'wait': time[p] - time[b]}"),
    "last_before": ("events", "match p:{ u:User(did{/purchase}) } and last b:{ u:User(did{/signup}) } before p return {'user': agent_id{u}, 'purchase': event_id{p}, 'signup': event_id{b}}"),
    "first_after_aux": ("events", "match b:{ u:User(did{/signup}) } and first p:{ u:User(did{/purchase}) } after b and p:{ u:User(did{view}) } return {'user': agent_id{u}, 'signup': event_id{b}, 'purchase': event_id{p}}"),
    "chain_three_events": ("events", "match a:{ u:User(did{/signup}) } and first b:{ u:User(did{/view}) } after a and first c:{ u:User(did{/purchase}) } after b return {'a': event_id{a}, 'b': event_id{b}, 'c': event_id{c}}"),
    "fork_tree": ("events", "match a:{ u:User(did{/purchase}) } and first b:{ u:User(did{/click}) } after a and last c:{ u:User(did{/view}) } before a return {'a': event_id{a}, 'b': event_id{b}, 'c': event_id{c}}"),
    "no_link_first_after": ("events", "match a:{ u:User(did{/error}) } and first b:{ v:User(did{/signup}) } after a return {'a': event_id{a}, 'b': event_id{b}, 'u': agent_id{u}, 'v': agent_id{v}}"),
    "no_link_last_before": ("events", "match a:{ u:User(did{/error}) } and last b:{ } before a return {'a': event_id{a}, 'b': event_id{b}, 'rule': rule[b]}"),
    "dag_same_event": ("events", "match a:{ u:User(did{/purchase}) } and last b:{ u:User(did{/view}) } before a and last c:{ v:User(did{/view}) } before a when event_id{b} = event_id{c} return {'a': event_id{a}, 'b': event_id{b}}"),
    "when_filter": ("events", "match e:{ u:User(did{/click}) } when not (int_state[.e]{u.did} = 'click') && time[e] > 0 return {'step': event_id{e}, 'double': 2 * agent_id{u} + 1.5}"),
    "null_strict_and": ("events", "match e:{ u:User(did{/view}) } return {'step': event_id{e}, 'both': (sim_event_id[e] > 10) && ((size{component[.e]{u}} = 1) || (size{component[.e]{u}} > 5)), 'lost': (size{component[.e]{u}} > 0) && (1 = 2)}"),
    "null_safe_eq": ("events", "match e:{ u:User(did{/view}) } return {'step': event_id{e}, 'first': int_state[.e]{u.did} = null, 'same': int_state[.e]{u.did} = int_state[e.]{u.did}}"),
    "every_throttle": ("events", "match e:{ 'purchase' } every 21600 seconds return {'step': event_id{e}, 'at': time[e]}"),
    "component_size": ("places", "match e:{ n:Nation(open{/done}) } return {'nation': agent_id{n}, 'size': size{component[.e]{n}}, 'customers': count{'Customer'}{component[.e]{n}}}"),
    "component_similarity": ("places", "match e:{ n:Nation(open{/done}) } and last f:{ m:Nation(open{/done}) } before e return {'nation': agent_id{n}, 'other': agent_id{m}, 'alike': similarity{component[.e]{n}}{component[.f]{m}}}"),
    "bond_created": ("places", "match e:{ +c:Customer(n[_]) } return {'step': event_id{e}, 'customer': agent_id{c}}"),
    "bond_to_type": ("places", "match e:{ n:Nation(r[/n3.Region]) } return {'step': event_id{e}, 'nation': agent_id{n}}"),
    "destroyed_tested": ("orders", "match e:{ -o:Order(status{F}, cust[_]) } return {'step': event_id{e}, 'order': agent_id{o}}"),
    "free_tested": ("orders", "match e:{ c:Customer(slot[./1]), +o:Order(cust[1]) } return {'step': event_id{e}, 'customer': agent_id{c}, 'order': agent_id{o}}"),
    "bond_type_tested": ("orders", "match e:{ c:Customer(slot[cust.Order/.]) } return {'step': event_id{e}, 'customer': agent_id{c}, 'rule': rule[e]}"),
    "bond_pair_tested": ("orders", "match e:{ -o:Order(cust[1]), c:Customer(slot[1], seg{BUILDING}) } return {'step': event_id{e}, 'order': agent_id{o}, 'customer': agent_id{c}}"),
    "site_freed": ("orders", "match e:{ 'place' c:Customer(slot[/.]) } return {'step': event_id{e}, 'customer': agent_id{c}}"),
    "site_freed_at_start": ("orders", "match e:{ '_init_' c:Customer(slot[/.]) } return {'step': event_id{e}, 'customer': agent_id{c}}"),
    "bond_pair_made": ("orders", "match e:{ +o:Order(cust[1]), c:Customer(slot[/1]) } return {'step': event_id{e}, 'order': agent_id{o}, 'customer': agent_id{c}}"),
    "bond_replaced": ("orders", "match e:{ c:Customer(slot[_/1]), +o:Order(cust[1]) } return {'step': event_id{e}, 'customer': agent_id{c}, 'order': agent_id{o}}"),
    "bond_to_site_of_kind": ("orders", "match e:{ o:Order(cust[/slot.Customer]) } return {'step': event_id{e}, 'order': agent_id{o}}"),
    "init_rule": ("orders", "match e:{ '_init_' +c:Customer(seg{BUILDING}) } return {'step': event_id{e}, 'customer': agent_id{c}}"),
    "late_agent": ("orders", "match a:{ 'place' +o:Order(cust[1]), c:Customer(slot[/1]) } and last b:{ -p:Order } before a and b:{ p:Order(cust[1]), c:Customer(slot[1]) } return {'a': event_id{a}, 'b': event_id{b}, 'customer': agent_id{c}}"),
    "last_order_before": ("orders", "match a:{ -o:Order(cust[1]), c:Customer(slot[1]) } and last b:{ c:Customer(slot[/.]) } before a return {'a': event_id{a}, 'b': event_id{b}, 'customer': agent_id{c}}"),
    "order_component": ("orders", "match e:{ -o:Order } return {'order': agent_id{o}, 'size': size{component[.e]{o}}, 'customers': count{'Customer'}{component[.e]{o}}}"),
    "printed_component": ("orders", "match e:{ -o:Order } return {'step': event_id{e}, 'text': print_cc[.e]{o}}"),
    "bond_tested": ("places", "match e:{ n:Nation(open{/done}, r[_]) } and last b:{ +n:Nation(r[_]) } before e return {'nation': agent_id{n}, 'born': event_id{b}}"),
}
_TRACES = {"events": events_trace, "places": places_trace, "orders": orders_trace}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    trace, text = TEXTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return TraceEngine(_TRACES[trace](spark, sf_dir)).run(f"query '{name}' {text}")

    run.__name__ = name
    run.__doc__ = text
    return run


def event_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many matches each entry of the event cache of ``first_after_aux`` holds."""
    engine = TraceEngine(events_trace(spark, sf_dir))
    return engine.event_cache(f"query 'c' {TEXTS['first_after_aux'][1]}").select("event", "link", "step", F.size("others").cast("bigint").alias("n"))


def snapshot_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all users just before each creation of a user."""
    trace = events_trace(spark, sf_dir)
    asked = TraceEngine(trace).matchings("query 's' match e:{ +u:User } return 1").select("trace_id", F.col("ev_e").alias("step")).distinct()
    return state_at(asked, trace, "before", "int").select("step", "uid", "state")


def recycled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event replaces its user's agent, with a simulator id that is used again: unique ids of the new and the old agent."""
    e = _read(spark, sf_dir, "events")
    old = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    new = action("create", F.col("user_id"), F.lit("User"))
    gone = action("remove", F.col("user_id"), F.lit("User"))
    steps = e.withColumn("_old", old).select(F.lit("r").alias("trace_id"), F.col("event_id").alias("step_id"), F.lit("rule").alias("step_kind"), F.col("event_type").alias("rule"), F.lit(0.0).alias("time"), F.col("event_id").alias("sim_event_id"), F.when(F.col("_old").isNotNull(), F.array(gone, new)).otherwise(F.array(new)).cast(f"array<{ACTION}>").alias("actions"))
    found = unique_ids(steps)
    pick = lambda op: F.get(F.filter("actions", lambda a: a["op"] == op), F.lit(0))["uid"]
    return found.select(F.col("step_id").alias("step"), pick("create").alias("made"), pick("remove").alias("gone"))


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each rule: the scan that all patterns share."""
    return steps_of(events_trace(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("steps"), F.sum(F.size("actions")).cast("bigint").alias("actions"))


def parity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``null_safe_eq`` as result files print them."""
    engine = TraceEngine(events_trace(spark, sf_dir))
    return engine.run(f"query 'p' {TEXTS['null_safe_eq'][1]}", typed=False).select(F.col("value").alias("line"))


def parity_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each type as result files print them."""
    engine = TraceEngine(events_trace(spark, sf_dir))
    return engine.run("query 'p' match e:{ u:User(did{/error}) } return event_id{e}, 0.5 * agent_id{u} + 0.25, rule[e], null, component[e]{u}, int_state[.e]{u.did}, agent_id{u} > 3", typed=False).select(F.col("value").alias("line"))


def nan_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that are not a number equal themselves."""
    steps = from_events(_read(spark, sf_dir, "events")).withColumn("time", F.when(F.col("step_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("time")))
    return TraceEngine(Trace(steps)).run("query 'n' match e:{ u:User(did{/error}) } return {'step': event_id{e}, 'self': time[e] = time[e], 'sum': (time[e] + 1) = time[e]}")


def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the snapshots just before each creation of a user."""
    engine = TraceEngine(events_trace(spark, sf_dir))
    return engine.snapshots_of("query 's' match e:{ +u:User } return snapshot[.e]").select("step", "document")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in TEXTS} | {f.__name__: f for f in (event_cache, snapshot_at, recycled_ids, trace_summary, parity_csv, parity_values, nan_equal, snapshot_documents)}
first_after = QUERIES["first_after"]

_EV = "e AS (SELECT event_id AS s, user_id AS u, event_type AS k, epoch_us(ts) / 1e6 AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)"
_OR = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, lag(o_orderkey) OVER w AS pk, lag(o_orderstatus) OVER w AS ps FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), p AS (SELECT c, st, CASE WHEN ps <> 'F' THEN pk END AS b, 1099511627776 + 2 * k AS s, 1099511627776 + k AS o FROM o)"
SQL: dict[str, str] = {
    "destroyed_tested": f"WITH {_OR} SELECT s + 1 AS step, o AS \"order\" FROM p WHERE st = 'F'",
    "free_tested": f"WITH {_OR} SELECT s AS step, c AS customer, o AS \"order\" FROM p WHERE b IS NULL",
    "bond_type_tested": f"WITH {_OR} SELECT s + 1 AS step, c AS customer, 'ship' AS rule FROM p WHERE st = 'F' UNION ALL SELECT s, c, 'place' FROM p WHERE b IS NOT NULL",
    "bond_pair_tested": f"WITH {_OR} SELECT s + 1 AS step, o AS \"order\", c AS customer FROM p JOIN customer ON c = c_custkey WHERE st = 'F' AND c_mktsegment = 'BUILDING'",
    "site_freed": f"WITH {_OR} SELECT s AS step, c AS customer FROM p WHERE b IS NOT NULL",
    "site_freed_at_start": "SELECT c_custkey AS step, c_custkey AS customer FROM customer",
    "bond_pair_made": f"WITH {_OR} SELECT s AS step, o AS \"order\", c AS customer FROM p",
    "bond_replaced": f"WITH {_OR} SELECT s AS step, c AS customer, o AS \"order\" FROM p WHERE b IS NOT NULL",
    "bond_to_site_of_kind": f"WITH {_OR} SELECT s AS step, o AS \"order\" FROM p",
    "init_rule": "SELECT c_custkey AS step, c_custkey AS customer FROM customer WHERE c_mktsegment = 'BUILDING'",
    "late_agent": f"WITH {_OR} SELECT a.s AS a, b.s AS b, a.c AS customer FROM p a ASOF JOIN (SELECT s + 1 AS s, c FROM p WHERE st = 'F') b ON a.s > b.s WHERE a.c = b.c",
    "last_order_before": f"WITH {_OR}, f AS (SELECT s + 1 AS s, c FROM p WHERE st = 'F' UNION ALL SELECT s, c FROM p WHERE b IS NOT NULL UNION ALL SELECT c_custkey, c_custkey FROM customer) SELECT a.s AS a, b.s AS b, a.c AS customer FROM (SELECT s + 1 AS s, c FROM p WHERE st = 'F') a ASOF JOIN f b ON a.c = b.c AND a.s > b.s",
    "order_component": f"WITH {_OR} SELECT o AS \"order\", CAST(2 AS BIGINT) AS size, CAST(1 AS BIGINT) AS customers FROM p WHERE st = 'F'",
    "printed_component": f"WITH {_OR} SELECT s + 1 AS step, 'x' || o || ':Order(cust[1] status{{F}}[.]), x' || c || ':Customer(seg{{' || c_mktsegment || '}}[.] slot[1])' AS text FROM p JOIN customer ON c = c_custkey WHERE st = 'F'",
    "parity_values": f"WITH {_EV} SELECT s || ', ' || CAST(CAST(0.5 AS DOUBLE) * u + 0.25 AS VARCHAR) || ', \"error\", null, <agents>, ' || CASE WHEN was IS NULL THEN 'null' ELSE '\"' || was || '\"' END || ', ' || CASE WHEN u > 3 THEN '1' ELSE '0' END AS line FROM e WHERE k = 'error'",
    "nan_equal": f"WITH {_EV} SELECT s AS step, true AS self, s % 2 = 0 AS sum FROM e WHERE k = 'error'",
    "snapshot_documents": f"WITH {_EV}, f AS (SELECT s FROM e WHERE was IS NULL), x AS (SELECT f.s AS step, e.u AS uid, max(e.s) AS at FROM f JOIN e ON e.s < f.s GROUP BY ALL), d AS (SELECT step, string_agg('{{\"id\":' || uid || ',\"kind\":\"User\",\"states\":{{\"did\":\"' || e.k || '\"}},\"bonds\":[]}}', ',' ORDER BY uid) AS a FROM x JOIN e ON x.at = e.s GROUP BY step) SELECT f.s AS step, '{{\"agents\":[' || coalesce(a, '') || ']}}' AS document FROM f LEFT JOIN d ON f.s = d.step",
    "scan_single_event": f"WITH {_EV} SELECT s AS step, u AS \"user\", t AS \"at\" FROM e WHERE k = 'purchase'",
    "any_event": "SELECT event_id AS step, event_type AS rule, event_id AS sim FROM events",
    "rule_disjunction": f"WITH {_EV} SELECT s AS step, k AS rule, u AS \"user\" FROM e WHERE k = 'view'",
    "state_test_before": f"WITH {_EV} SELECT s AS step, u AS \"user\" FROM e WHERE k = 'purchase' AND was = 'view'",
    "state_before_after": f"WITH {_EV} SELECT s AS step, was, k AS now FROM e WHERE k = 'error'",
    "created_agents": f"WITH {_EV} SELECT s AS step, u AS \"user\" FROM e WHERE k = 'signup' AND was IS NULL",
    "debug_event": f"WITH {_EV} SELECT s AS step, 'new(User.' || u || ') mod(User.' || u || '.did, ' || k || ')' AS text FROM e WHERE was IS NULL",
    "first_after": f"WITH {_EV} SELECT b.u AS \"user\", b.s AS signup, p.s AS purchase, p.t - b.t AS wait FROM (SELECT * FROM e WHERE k = 'signup') b ASOF JOIN (SELECT * FROM e WHERE k = 'purchase') p ON b.u = p.u AND b.s < p.s",
    "last_before": f"WITH {_EV} SELECT p.u AS \"user\", p.s AS purchase, b.s AS signup FROM (SELECT * FROM e WHERE k = 'purchase') p ASOF JOIN (SELECT * FROM e WHERE k = 'signup') b ON b.u = p.u AND p.s > b.s",
    "first_after_aux": f"WITH {_EV} SELECT b.u AS \"user\", b.s AS signup, p.s AS purchase FROM (SELECT * FROM e WHERE k = 'signup') b ASOF JOIN (SELECT * FROM e WHERE k = 'purchase') p ON b.u = p.u AND b.s < p.s WHERE p.was = 'view'",
    "chain_three_events": f"WITH {_EV}, x AS (SELECT a.u, a.s AS a, b.s AS b FROM (SELECT * FROM e WHERE k = 'signup') a ASOF JOIN (SELECT * FROM e WHERE k = 'view') b ON a.u = b.u AND a.s < b.s) SELECT x.a, x.b, c.s AS c FROM x ASOF JOIN (SELECT * FROM e WHERE k = 'purchase') c ON x.u = c.u AND x.b < c.s",
    "fork_tree": f"WITH {_EV}, x AS (SELECT a.u, a.s AS a, b.s AS b FROM (SELECT * FROM e WHERE k = 'purchase') a ASOF JOIN (SELECT * FROM e WHERE k = 'click') b ON a.u = b.u AND a.s < b.s) SELECT x.a, x.b, c.s AS c FROM x ASOF JOIN (SELECT * FROM e WHERE k = 'view') c ON x.u = c.u AND x.a > c.s",
    "no_link_first_after": f"WITH {_EV} SELECT a.s AS a, b.s AS b, a.u, b.u AS v FROM (SELECT * FROM e WHERE k = 'error') a ASOF JOIN (SELECT * FROM e WHERE k = 'signup') b ON a.s < b.s",
    "no_link_last_before": f"WITH {_EV} SELECT a.s AS a, b.s AS b, b.k AS rule FROM (SELECT * FROM e WHERE k = 'error') a ASOF JOIN e b ON a.s > b.s",
    "dag_same_event": f"WITH {_EV}, x AS (SELECT a.u, a.s AS a, b.s AS b FROM (SELECT * FROM e WHERE k = 'purchase') a ASOF JOIN (SELECT * FROM e WHERE k = 'view') b ON a.u = b.u AND a.s > b.s) SELECT x.a, x.b FROM x ASOF JOIN (SELECT * FROM e WHERE k = 'view') c ON x.a > c.s WHERE x.b = c.s",
    "when_filter": f"WITH {_EV} SELECT s AS step, 2 * u + CAST(1.5 AS DOUBLE) AS double FROM e WHERE k = 'click' AND NOT (was IS NOT DISTINCT FROM 'click') AND t > 0",
    "null_strict_and": f"WITH {_EV} SELECT s AS step, CASE WHEN was IS NOT NULL THEN s > 10 END AS both, CASE WHEN was IS NOT NULL THEN false END AS lost FROM e WHERE k = 'view'",
    "null_safe_eq": f"WITH {_EV} SELECT s AS step, was IS NULL AS first, was IS NOT DISTINCT FROM k AS same FROM e WHERE k = 'view'",
    "every_throttle": f"WITH RECURSIVE {_EV}, p AS (SELECT s, t FROM e WHERE k = 'purchase'), r AS (SELECT s, t FROM (SELECT * FROM p ORDER BY s LIMIT 1) UNION ALL SELECT n.s, n.t FROM r, LATERAL (SELECT s, t FROM p WHERE p.t - r.t >= 21600 ORDER BY s LIMIT 1) n) SELECT s AS step, t AS \"at\" FROM r",
    "component_size": "WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation), g AS (SELECT r, count(*) AS n, CAST(sum(c) AS BIGINT) AS c FROM n GROUP BY r) SELECT CAST(k + 100 AS BIGINT) AS nation, 1 + g.n + g.c AS size, g.c AS customers FROM n JOIN g ON n.r = g.r",
    "component_similarity": "WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, lag(n_nationkey) OVER (ORDER BY n_nationkey) AS o, lag(n_regionkey) OVER (ORDER BY n_nationkey) AS q FROM nation) SELECT CAST(k + 100 AS BIGINT) AS nation, CAST(o + 100 AS BIGINT) AS other, CASE WHEN r = q THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS alike FROM n WHERE o IS NOT NULL",
    "bond_created": "SELECT c_custkey + 1000 AS step, c_custkey + 1000 AS customer FROM customer",
    "bond_to_type": "SELECT CAST(n_nationkey + 100 AS BIGINT) AS step, CAST(n_nationkey + 100 AS BIGINT) AS nation FROM nation WHERE n_nationkey = 3",
    "bond_tested": "SELECT CAST(n_nationkey + 100 AS BIGINT) AS nation, CAST(n_nationkey + 100 AS BIGINT) AS born FROM nation",
    "event_cache": f"WITH {_EV} SELECT 'b' AS event, '' AS link, s AS step, CAST(1 AS BIGINT) AS n FROM e WHERE k = 'signup' UNION ALL SELECT 'p', 'u:' || u, s, CAST(CASE WHEN was = 'view' THEN 1 ELSE 0 END AS BIGINT) FROM e WHERE k = 'purchase'",
    "snapshot_at": f"WITH {_EV}, f AS (SELECT s FROM e WHERE was IS NULL), x AS (SELECT f.s AS step, e.u AS uid, max(e.s) AS at FROM f JOIN e ON e.s < f.s GROUP BY ALL) SELECT step, uid, e.k AS state FROM x JOIN e ON x.at = e.s",
    "recycled_ids": "WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS made, user_id FROM events) SELECT event_id AS step, made, lag(made) OVER (PARTITION BY user_id ORDER BY event_id) AS gone FROM o",
    "trace_summary": f"WITH {_EV} SELECT k AS rule, count(*) AS steps, CAST(sum(CASE WHEN was IS NULL THEN 2 ELSE 1 END) AS BIGINT) AS actions FROM e GROUP BY k",
    "parity_csv": f"WITH {_EV} SELECT s || ', ' || CASE WHEN was IS NULL THEN '1' ELSE '0' END || ', ' || CASE WHEN was IS NOT DISTINCT FROM k THEN '1' ELSE '0' END AS line FROM e WHERE k = 'view'",
}
