"""Queries of exploration, checking, steps, traces and slicing on small models, and DuckDB SQL that explores them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.exprs import Scope, true
from tidegraph.model import Model, parse_model
from tidegraph.operators import ctl, steps, traces
from tidegraph.operators.explore import Explorer, Graph, explore
from tidegraph.plans import check as checks
from tidegraph.plans import slicing
from tidegraph.queries import GRAPH, REACH, counter_starts, counters, event_graph, kind_is, kind_not, lit, op, put, query, read, table
from tidegraph.sources.rows import with_state

BOOL = {"kind": "bool"}


def enum(*values) -> dict:
    return {"kind": "enum", "values": list(values)}


def whole(most: int, overflow: str = "forbid") -> dict:
    return {"kind": "boundedInt", "min": 0, "max": most, "overflow": overflow}


def var(name: str, domain: dict, initial, **more) -> dict:
    return {"id": name, "domain": domain, "origin": "system", "scope": {"kind": "global"}, "initial": initial, **more}


def rule(name: str, guard, effect: dict, cls: str = "user", **more) -> dict:
    return {"id": name, "cls": cls, "label": {"kind": "click"}, "source": [], "guard": guard if isinstance(guard, dict) else lit(guard), "effect": effect, "reads": [], "writes": [], "confidence": "exact", **more}


def model(name: str, variables: list[dict], rules: list[dict], depth: int = 30, pending: int = 2, internal: int = 4) -> Model:
    return parse_model({"schemaVersion": 1, "id": name, "vars": variables, "transitions": rules, "bounds": {"maxDepth": depth, "maxPending": pending, "maxInternalSteps": internal}})


def seq(*effects: dict) -> dict:
    return {"kind": "seq", "effects": list(effects)}


def from_orders(**columns: str):
    """Start states of the orders: a variable for each SQL expression."""
    return lambda spark, sf_dir: table(spark, sf_dir, "orders").select(*(F.expr(e).alias(k) for k, e in columns.items()))


STARTS = {
    "tickets": from_orders(n="o_custkey % 2"), "counters": counter_starts, "lamp": from_orders(color="CASE o_orderstatus WHEN 'F' THEN 'red' ELSE 'green' END"), "red": from_orders(color="'red'"),
    "switches": from_orders(b="o_orderstatus = 'F'", c="o_custkey % 5"), "chain": from_orders(a="o_custkey % 2"), "conflict": from_orders(a="CAST(o_orderstatus = 'P' AS INT)"), "spin": from_orders(b="o_custkey % 5"),
    "mount": from_orders(route="CASE o_orderstatus WHEN 'F' THEN 'home' ELSE 'form' END"), "fresh": from_orders(**dict.fromkeys("abc", "concat('tok', o_custkey % 3 + 1)")),
}
ANY = "EXISTS (SELECT 1 FROM orders)"


_explored: dict[tuple[str, str, str], tuple[Explorer, Graph]] = {}


def explored(spark: SparkSession, m: Model, sf_dir: str) -> tuple[Explorer, Graph]:
    """A model's graph from the start states in orders, explored once in a session."""
    at = (spark.sparkContext.applicationId, m.id, sf_dir)
    if at not in _explored:
        e = Explorer(spark, m, STARTS[m.id](spark, sf_dir))
        _explored[at] = (e, e.run())
    return _explored[at]


# -- a counter whose value is handed to jobs in a queue

def tickets() -> Model:
    job = {"kind": "record", "fields": {"opId": enum("JOB"), "continuation": enum("k"), "args": {"kind": "record", "fields": {"n": whole(2)}}}}
    variables = [var("n", whole(2), 0), var("last", whole(2), 0), var("sys:pending", {"kind": "boundedList", "inner": job, "maxLen": 2}, [], role={"kind": "pending-queue"})]
    rules = [
        rule("next", True, put("n", op("mod", op("add", read("n"), 1), 3))),
        rule("submit", op("neq", {"kind": "lenCat", "arg": read("sys:pending")}, "many"), {"kind": "enqueue", "op": "JOB", "continuation": "k", "args": {"n": read("n")}}),
        rule("done", op("eq", read("sys:pending", "0", "opId"), "JOB"), seq({"kind": "dequeue", "index": 0}, put("last", {"kind": "readOpArg", "key": "n"})), "env", label={"kind": "resolve", "op": "JOB", "outcome": "ok"}),
    ]
    return model("tickets", variables, rules)


AHEAD = "(SELECT 'next' AS t, (r.n + 1) % 3 AS n, r.last AS last, r.q AS q UNION ALL SELECT 'submit', r.n, r.last, list_append(r.q, r.n) WHERE len(r.q) < 2 UNION ALL SELECT 'done', r.n, r.q[1], r.q[2:] WHERE len(r.q) > 0)"
TICKETS = f"""d(n, last, q, depth) AS (SELECT DISTINCT CAST(o_custkey % 2 AS INTEGER), 0, CAST([] AS INTEGER[]), 0 FROM orders UNION SELECT x.n, x.last, x.q, r.depth + 1 FROM d r, LATERAL {AHEAD} x WHERE r.depth < 14),
s AS (SELECT n, last, q, min(depth) AS depth FROM d GROUP BY ALL),
e AS (SELECT r.n AS pn, r.last AS plast, r.q AS pq, r.depth, x.t, x.n, x.last, x.q FROM s r, LATERAL {AHEAD} x),
f AS (SELECT *, t = 'submit' AND NOT list_contains(pq, pn) AS fresh, t = 'done' AND NOT list_contains(q, pq[1]) AS gone FROM e)"""
ROW = "CAST(n AS BIGINT) AS n, CAST(last AS BIGINT) AS last, array_to_string(q, ',') AS q"
EDGE = f"t, CAST(pn AS BIGINT) AS pn, CAST(plast AS BIGINT) AS plast, array_to_string(pq, ',') AS pq, {ROW}"


def jobs(state: str):
    return F.array_join(F.transform(F.col(f"{state}.v2"), lambda x: x.args.n.cast("string")), ",")


def state_columns(state: str = "s", prefix: str = "") -> list:
    return [F.col(f"{state}.v0").alias(prefix + "n"), F.col(f"{state}.v1").alias(prefix + "last"), jobs(state).alias(prefix + "q")]


def edge_columns(g: Graph, edges: DataFrame) -> tuple[DataFrame, list]:
    return traces.named(g, edges), [F.col("transition_id").alias("t"), *state_columns("pre_s", "p"), *state_columns("post_s")]


@query(f"WITH RECURSIVE {TICKETS} SELECT {ROW}, depth FROM s")
def explore_queue_states(spark, sf_dir):
    _, g = explored(spark, tickets(), sf_dir)
    return g.states.select(*state_columns(), "depth")


@query(f"WITH RECURSIVE {TICKETS} SELECT {EDGE} FROM e")
def explore_queue_edges(spark, sf_dir):
    _, g = explored(spark, tickets(), sf_dir)
    edges, columns = edge_columns(g, g.edges)
    return edges.select(*columns)


@query("WITH r AS (SELECT o_orderkey AS k, o_custkey % 3 AS n, o_orderkey % 3 AS last, CASE o_orderstatus WHEN 'F' THEN CAST([] AS BIGINT[]) WHEN 'O' THEN [o_custkey % 3] ELSE [o_custkey % 3, o_orderkey % 3] END AS q FROM orders) SELECT o_orderkey, " + ROW + f", t FROM (SELECT r.k AS o_orderkey, x.* FROM r, LATERAL {AHEAD} x)")
def model_successors(spark, sf_dir):
    """All steps from the state of every order."""
    m = tickets()
    work = lambda e: f"named_struct('args', named_struct('n', {e}), 'continuation', 'k', 'opId', 'JOB')"
    waiting = F.expr(f"CASE o_orderstatus WHEN 'F' THEN slice(array({work('o_custkey % 3')}), 1, 0) WHEN 'O' THEN array({work('o_custkey % 3')}) ELSE array({work('o_custkey % 3')}, {work('o_orderkey % 3')}) END")
    rows = with_state(table(spark, sf_dir, "orders"), m, {"n": F.col("o_custkey") % 3, "last": F.col("o_orderkey") % 3, "sys:pending": waiting})
    out = Explorer(spark, m).expand(rows.select(F.col("o_orderkey").alias("key"), "s"))
    ids = F.array(*(F.lit(t["id"]) for t in m.sorted_transitions))
    return out.select(F.col("pre").alias("o_orderkey"), *state_columns("post_s"), F.get(ids, F.col("tid")).alias("t"))


@query(f"""WITH RECURSIVE {TICKETS} SELECT {EDGE}, t = 'next' AS by_id, t = 'done' AS by_class, t = 'done' AS by_label, fresh AS enqueued, t = 'done' AS resolved, false AS failed,
last <> plast AS changed, last <> plast AND last = 2 AS changed_to, fresh OR gone AS op_id, (fresh AND pn = 1) OR (gone AND pq[1] = 1) AS op_args,
t = 'done' AND plast = 0 AND coalesce(last = CASE WHEN gone THEN pq[1] END, false) AND n = pn AS composite, NOT (t = 'submit' AND pn = 2) AS negated FROM f""")
def step_predicates(spark, sf_dir):
    """Every kind of step predicate, on every step."""
    _, g = explored(spark, tickets(), sf_dir)
    s = steps.Steps(g.model)
    flat = {
        "by_id": steps.step_transition("next"), "by_class": {"transitionClass": "env"}, "by_label": {"labelKind": "resolve"}, "enqueued": steps.step_enqueued("JOB"), "resolved": steps.step_resolved("JOB", "ok"),
        "failed": steps.step_resolved("JOB", "error"), "changed": steps.step_changed("last"), "changed_to": steps.step_changed_to("last", 2), "op_id": {"opId": "JOB"}, "op_args": {"opArgs": {"n": 1}},
        "composite": {"pre": op("eq", read("last"), 0), "step": steps.step_resolved("JOB"), "post": op("and", op("eq", read("last"), {"kind": "readOpArg", "key": "n"}), op("eq", read("n"), {"kind": "readPre", "var": "n"}))},
        "negated": {"step": steps.step_transition("submit"), "pre": op("eq", read("n"), 2), "negate": True},
    }
    edges, columns = edge_columns(g, g.edges)
    return edges.select(*columns, *(F.coalesce(s.matches(p), F.lit(False)).alias(k) for k, p in flat.items()))


@query(f"WITH RECURSIVE {TICKETS} SELECT {EDGE} FROM e WHERE last <> plast AND last = 2")
def always_step(spark, sf_dir):
    """The steps that break a step property."""
    _, g = explored(spark, tickets(), sf_dir)
    bad = steps.step_violations(g, checks.always_step("calm", {"step": steps.step_changed("last"), "post": op("eq", read("last"), 2), "negate": True}))
    edges, columns = edge_columns(g, bad)
    return edges.select(*columns)


@query(f"WITH RECURSIVE {TICKETS} SELECT {EDGE} FROM f WHERE fresh")
def step_triggers(spark, sf_dir):
    _, g = explored(spark, tickets(), sf_dir)
    edges, columns = edge_columns(g, steps.triggers(g, checks.leads_to_within("empties", steps.step_enqueued("JOB"), lit(True), 1)))
    return edges.select(*columns)


@query(f"WITH RECURSIVE {TICKETS}, w AS (SELECT DISTINCT n, last, q FROM f WHERE fresh) SELECT {ROW}, 1 AS steps FROM w WHERE len(q) > 1")
def leads_to_missed(spark, sf_dir):
    """States after a submission from which the scheduler alone does not empty the queue in one step, and the way missed."""
    e, g = explored(spark, tickets(), sf_dir)
    fired = steps.triggers(g, checks.leads_to_within("empties", steps.step_enqueued("JOB"), lit(True), 1))
    starts = fired.select(F.col("post").alias("key"), F.col("post_s").alias("s"))
    missed = steps.leads_to(e, starts, op("eq", {"kind": "lenCat", "arg": read("sys:pending")}, "0"), 1)
    return missed.join(g.states.select("key", "s"), "key").select(*state_columns(), F.size("path").alias("steps"))


def ticket_properties() -> list[dict]:
    last = lambda n: op("eq", read("last"), n)
    empty = op("eq", {"kind": "lenCat", "arg": read("sys:pending")}, "0")
    return [
        checks.always("small", op("lt", read("n"), 3)), checks.always("below", op("lt", read("last"), 2)), checks.reachable("two", last(2)), checks.reachable("seven", last(7)),
        checks.reachable_from("again", last(2), last(0)), checks.temporal("served", ctl.AF(ctl.atom(last(1)))), checks.temporal("idle", ctl.EG(ctl.atom(last(0)))), checks.temporal("until", ctl.EU(ctl.atom(last(0)), ctl.atom(last(1)))),
        checks.temporal("both", ctl.fand(ctl.EF(ctl.atom(last(1))), ctl.EX(ctl.atom(op("eq", read("n"), 1))))), checks.temporal("next", ctl.AX(ctl.atom(last(0)))),
        checks.always_step("calm", {"step": steps.step_changed("last"), "post": last(2), "negate": True}), checks.always_step("ever", steps.step_any()),
        checks.leads_to_within("once", steps.step_enqueued("JOB"), empty, 1), checks.leads_to_within("twice", steps.step_enqueued("JOB"), empty, 2), checks.leads_to_within("never", steps.step_enqueued("OTHER"), empty, 2),
    ]


@query(f"""WITH RECURSIVE {TICKETS}, v(property, ok, good, bad) AS (
SELECT 'small', NOT EXISTS (SELECT 1 FROM s WHERE n >= 3), 'verified', 'violated' UNION ALL SELECT 'below', NOT EXISTS (SELECT 1 FROM s WHERE last >= 2), 'verified', 'violated'
UNION ALL SELECT 'two', EXISTS (SELECT 1 FROM s WHERE last = 2), 'verified', 'vacuous-warning' UNION ALL SELECT 'seven', EXISTS (SELECT 1 FROM s WHERE last = 7), 'verified', 'vacuous-warning'
UNION ALL SELECT 'again', true, 'verified', 'violated' UNION ALL SELECT 'served', NOT EXISTS (SELECT 1 FROM e WHERE depth = 0 AND t = 'next'), 'verified', 'violated'
UNION ALL SELECT 'idle', EXISTS (SELECT 1 FROM e WHERE depth = 0 AND t = 'next' AND last = 0), 'verified', 'vacuous-warning' UNION ALL SELECT 'until', EXISTS (SELECT 1 FROM s WHERE last = 1), 'verified', 'vacuous-warning'
UNION ALL SELECT 'both', EXISTS (SELECT 1 FROM s WHERE last = 1) AND EXISTS (SELECT 1 FROM e WHERE depth = 0 AND n = 1), 'verified', 'violated' UNION ALL SELECT 'next', NOT EXISTS (SELECT 1 FROM e WHERE depth = 0 AND last <> 0), 'verified', 'violated'
UNION ALL SELECT 'calm', NOT EXISTS (SELECT 1 FROM e WHERE last <> plast AND last = 2), 'verified-within-bounds', 'violated' UNION ALL SELECT 'ever', true, 'verified-within-bounds', 'violated'
UNION ALL SELECT 'once', NOT EXISTS (SELECT 1 FROM f WHERE fresh AND len(q) > 1), 'verified-within-bounds', 'violated' UNION ALL SELECT 'twice', NOT EXISTS (SELECT 1 FROM f WHERE fresh AND len(q) > 2), 'verified-within-bounds', 'violated'
UNION ALL SELECT 'never', false, 'verified-within-bounds', 'vacuous-warning')
SELECT property, CASE WHEN ok THEN good ELSE bad END AS status,
CAST(CASE property WHEN 'below' THEN (SELECT min(depth) FROM s WHERE last >= 2) WHEN 'calm' THEN (SELECT min(depth) + 1 FROM e WHERE last <> plast AND last = 2) END AS INTEGER) AS steps FROM v""")
def check_verdicts(spark, sf_dir):
    """check() on properties of every kind; the length of the trace where it is the shortest one."""
    found = checks.check(spark, tickets(), ticket_properties(), starts=STARTS["tickets"](spark, sf_dir)).frame(spark)
    return found.select("property", "status", F.when(F.col("property").isin("below", "calm"), F.size("trace")).alias("steps"))


@query(f"WITH RECURSIVE {TICKETS} SELECT {ROW}, CAST(depth AS BIGINT) AS steps, true AS joined FROM s WHERE depth > 0")
def trace_to(spark, sf_dir):
    """The parent chain of every state: as long as the state is deep, made of steps that follow each other."""
    _, g = explored(spark, tickets(), sf_dir)
    chain = traces.trace_to(g, g.states.select("key"))
    real = g.edges.select("pre", "tid", "post").distinct().withColumn("is_edge", F.lit(True))
    follows = chain.select("target", (F.col("step") + 1).alias("step"), F.col("post").alias("came_from"))
    chain = chain.join(real, ["pre", "tid", "post"], "left").join(follows, ["target", "step"], "left")
    good = F.col("is_edge").isNotNull() & ((F.col("step") == 1) | F.col("came_from").eqNullSafe(F.col("pre")))
    found = chain.groupBy(F.col("target").alias("key")).agg(F.count("*").alias("steps"), F.bool_and(good).alias("joined"))
    return found.join(g.states.select("key", "s"), "key").select(*state_columns(), "steps", "joined")


@query(f"WITH RECURSIVE {TICKETS}, c AS (SELECT e.*, unnest(list_filter(['n', 'last', 'sys:pending'], lambda v: (v = 'n' AND n <> pn) OR (v = 'last' AND last <> plast) OR (v = 'sys:pending' AND q <> pq))) AS var FROM e) SELECT t, var, count(*) AS n FROM c GROUP BY ALL")
def trace_diff(spark, sf_dir):
    """How often each transition changes each variable."""
    _, g = explored(spark, tickets(), sf_dir)
    rows = traces.named(g, g.edges).select(F.col("transition_id").alias("t"), F.explode(traces.diff(g.model, F.col("pre_s"), F.col("post_s"))).alias("d"))
    return rows.groupBy("t", F.col("d.var").alias("var")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(w AS BIGINT) AS walk, CAST(6 AS BIGINT) AS steps, true AS joined FROM range(12) r(w) WHERE {ANY}")
def random_walks(spark, sf_dir):
    """Walks of six steps: every step is one of the graph, and goes on where the one before ended."""
    e, g = explored(spark, tickets(), sf_dir)
    walks = traces.random_walks(e, 12, 6)
    real = g.edges.select("pre", "tid", "post").distinct().withColumn("is_edge", F.lit(True))
    before = walks.select("walk", (F.col("step") + 1).alias("step"), F.col("post").alias("came_from"))
    rows = walks.join(real, ["pre", "tid", "post"], "left").join(before, ["walk", "step"], "left")
    good = F.col("is_edge").isNotNull() & ((F.col("step") == 1) | F.col("came_from").eqNullSafe(F.col("pre")))
    return rows.groupBy("walk").agg(F.count("*").alias("steps"), F.bool_and(good).alias("joined"))


@query(f"WITH RECURSIVE {TICKETS} SELECT 'n' AS var, count(DISTINCT n) AS n FROM s UNION ALL SELECT 'last', count(DISTINCT last) FROM s UNION ALL SELECT 'sys:pending', count(DISTINCT q) FROM s")
def dominant_vars(spark, sf_dir):
    _, g = explored(spark, tickets(), sf_dir)
    return checks.dominant_vars(g).select("var", F.col("values").alias("n"))


# -- guards that ask about transitions, on two counters

@query("WITH RECURSIVE c(x, y) AS (SELECT DISTINCT o_custkey % 5, 0 FROM orders UNION SELECT n.x, n.y FROM c r, LATERAL (SELECT (r.x + 3) % 10 AS x, r.y AS y UNION ALL SELECT r.x, r.y + 1 WHERE r.y < r.x AND r.y < 6 UNION ALL SELECT r.x, v FROM (VALUES (0), (1)) t(v) WHERE r.y > 3) n) SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, y > 3 AS may_reset, y < x AS may_rise FROM c")
def transition_enabled(spark, sf_dir):
    _, g = explored(spark, counters(), sf_dir)
    asks = lambda e: true(Scope(g.model, F.col("s")).eval(e))
    return g.states.select(F.col("s.v0").alias("x"), F.col("s.v1").alias("y"), asks({"kind": "transitionEnabled", "transitionId": "reset"}).alias("may_reset"), asks({"kind": "transitionEnabledPrefix", "prefix": "u"}).alias("may_rise"))


# -- what never happens, and what a bound cuts off

def lamp(depth: int) -> Model:
    is_ = lambda c: op("eq", read("color"), c)
    return model("lamp", [var("color", enum("red", "green", "blue"), "red")], [rule("turn", is_("red"), put("color", "green")), rule("back", is_("green"), put("color", "red")), rule("fade", is_("blue"), put("color", "red"))], depth)


@query("WITH RECURSIVE s(c) AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'red' ELSE 'green' END FROM orders UNION SELECT CASE c WHEN 'red' THEN 'green' ELSE 'red' END FROM s) SELECT 'enum value never inhabited: color=' || v AS warning FROM (VALUES ('red'), ('green'), ('blue')) t(v) WHERE v NOT IN (SELECT c FROM s) UNION ALL SELECT 'transition never enabled: ' || n FROM (VALUES ('turn', 'red'), ('back', 'green'), ('fade', 'blue')) t(n, v) WHERE v NOT IN (SELECT c FROM s)")
def vacuity(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in checks.vacuity(explore(spark, lamp(9), starts=STARTS["lamp"](spark, sf_dir)))], "warning string")


@query(f"SELECT 'maxDepth reached before ' || n AS hit FROM (VALUES ('turn', 'red'), ('back', 'green'), ('fade', 'blue')) t(n, v) WHERE v = 'green' AND {ANY}")
def bound_hits(spark, sf_dir):
    """One step deep, the frontier is green."""
    return spark.createDataFrame([(h,) for h in checks.bound_hits(explore(spark, lamp(1), starts=STARTS["red"](spark, sf_dir)))], "hit string")


@query(f"SELECT 'error' AS status, 'maxStates' AS stopped WHERE {ANY}")
def search_limit(spark, sf_dir):
    """A search that meets a limit gives no verdict but an error."""
    from tidegraph.operators.explore import Limits

    found = checks.check(spark, lamp(9), [checks.always("any", lit(True))], Limits(states=1), starts=STARTS["lamp"](spark, sf_dir))
    return found.frame(spark).select("status", F.element_at(F.split("message", " "), -1).alias("stopped"))


# -- slices

def switches() -> tuple[Model, list[dict]]:
    flip = lambda n: rule("flip_" + n, True, put(n, op("not", read(n))))
    m = model("switches", [var("a", BOOL, False), var("b", BOOL, False), var("c", whole(4, "wrap"), 0)], [flip("a"), flip("b"), rule("turn", read("b"), put("c", op("add", read("c"), 1)))])
    return m, [checks.always("a", op("not", read("a"))), checks.always("c", op("lt", read("c"), 5)), checks.reachable("four", op("eq", read("c"), 4))]


@query("SELECT p AS property, CAST(v AS BIGINT) AS variables, CAST(t AS BIGINT) AS transitions, CAST(n AS BIGINT) AS states, round(b, 2) AS kept_bits, round(2 + log2(5) - b, 2) AS pruned_bits FROM (VALUES ('a', 1, 1, 2, 1.0), ('c', 2, 2, 10, 1 + log2(5)), ('four', 2, 2, 10, 1 + log2(5))) x(p, v, t, n, b) WHERE EXISTS (SELECT 1 FROM orders)")
def slice_economics(spark, sf_dir):
    """What each property's slice keeps, and the states that it has."""
    m, props = switches()
    rows = []
    for part, own in slicing.groups(m, props):
        n, bits = explore(spark, part, starts=STARTS["switches"](spark, sf_dir)).n_states, slicing.compare_economics(m, part)
        rows += [(p["name"], len(part.vars), len(part.transitions), n, float(bits["retainedBits"]), float(bits["prunedBits"])) for p in own]
    return spark.createDataFrame(rows, "property string, variables long, transitions long, states long, kept_bits double, pruned_bits double")


@query("SELECT p AS property, s AS status, true AS alike FROM (VALUES ('a', 'violated'), ('c', 'verified'), ('four', 'verified')) x(p, s) WHERE EXISTS (SELECT 1 FROM orders)")
def check_sliced(spark, sf_dir):
    """Verdicts of the slices are those of the whole model."""
    m, props = switches()
    one, other = (checks.check(spark, m, props, slicing=x, starts=STARTS["switches"](spark, sf_dir)).frame(spark).select("property", "status") for x in (True, False))
    return one.join(other.withColumnRenamed("status", "whole"), "property").select("property", "status", (F.col("status") == F.col("whole")).alias("alike"))


# -- internal transitions, mounted variables, tokens

INNER = {"cls": "internal", "label": {"kind": "internal", "text": ""}}


@query("SELECT CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) AS b, CAST(2 * a AS BIGINT) AS c, CAST(CASE WHEN a IN (SELECT o_custkey % 2 FROM orders) THEN 0 ELSE a - 1 END AS INTEGER) AS depth FROM range(5) r(a)")
def stabilize_chain(spark, sf_dir):
    """b follows a and c is twice b whenever a state is at rest."""
    rules = [rule("tick", op("lt", read("a"), 4), put("a", op("add", read("a"), 1))), rule("copy", op("neq", read("b"), read("a")), put("b", read("a")), triggeredBy=["a"], **INNER), rule("double", op("neq", read("c"), op("add", read("b"), read("b"))), put("c", op("add", read("b"), read("b"))), triggeredBy=["b"], **INNER)]
    g = explore(spark, model("chain", [var("a", whole(4), 0), var("b", whole(4), 0), var("c", whole(8), 0)], rules), starts=STARTS["chain"](spark, sf_dir))
    return g.states.select(F.col("s.v0").alias("a"), F.col("s.v1").alias("b"), F.col("s.v2").alias("c"), "depth")


@query("SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES (0, 0), (1, 1), (1, 2)) t(a, b) WHERE EXISTS (SELECT 1 FROM orders)")
def stabilize_conflict(spark, sf_dir):
    """Two internal transitions write one variable: both orders count."""
    inner = lambda n, x: rule(n, op("eq", read("a"), 1), put("b", x), triggeredBy=["a"], writes=["b"], **INNER)
    g = explore(spark, model("conflict", [var("a", whole(1), 0), var("b", whole(2), 0)], [rule("go", op("eq", read("a"), 0), put("a", 1)), inner("x", 1), inner("y", 2)]), starts=STARTS["conflict"](spark, sf_dir))
    return g.states.select(F.col("s.v0").alias("a"), F.col("s.v1").alias("b"))


@query(f"SELECT 'maxInternalSteps reached' AS hit WHERE {ANY}")
def stabilize_over_run(spark, sf_dir):
    """An internal transition that never comes to rest."""
    spin = rule("spin", op("eq", read("a"), 1), put("b", op("mod", op("add", read("b"), 1), 5)), writes=["b"], **INNER)
    g = explore(spark, model("spin", [var("a", whole(1), 0), var("b", whole(4), 0)], [rule("go", op("eq", read("a"), 0), put("a", 1)), spin], internal=3), starts=STARTS["spin"](spark, sf_dir))
    return spark.createDataFrame([(h,) for h in g.bound_hits], "hit string")


@query("SELECT r AS route, d AS draft, n AS depth FROM (VALUES ('home', NULL, 0), ('form', 'empty', 0), ('form', 'full', 1)) t(r, d, n) WHERE EXISTS (SELECT 1 FROM orders)")
def mount_scopes(spark, sf_dir):
    """A draft that is only there on its form, and new each time."""
    on = lambda r: op("eq", read("route"), r)
    draft = var("draft", enum("empty", "full"), "empty") | {"scope": {"kind": "mount-local", "id": "form", "when": on("form")}}
    rules = [rule("go", on("home"), put("route", "form")), rule("leave", on("form"), put("route", "home")), rule("fill", op("eq", read("draft"), "empty"), put("draft", "full"), reads=["draft"], writes=["draft"])]
    g = explore(spark, model("mount", [var("route", enum("home", "form"), "home"), draft], rules), starts=STARTS["mount"](spark, sf_dir))
    return g.states.select(F.col("s.v0").alias("route"), F.col("s.v1").alias("draft"), "depth")


@query("SELECT ab, ac, bc, depth FROM (VALUES (true, true, true, 0), (false, true, false, 1), (true, false, false, 1), (false, false, false, 2)) t(ab, ac, bc, depth) WHERE EXISTS (SELECT 1 FROM orders)")
def fresh_tokens(spark, sf_dir):
    """Three interchangeable tokens: only which variables are equal counts, and with all three in use none is fresh."""
    t, new = {"kind": "tokens", "count": 3}, {"kind": "freshToken", "domainOf": "a"}
    g = explore(spark, model("fresh", [var(n, t, "tok1") for n in "abc"], [rule("f", True, put("b", new)), rule("g", True, put("c", new))]), starts=STARTS["fresh"](spark, sf_dir))
    a, b, c = (F.col(f"s.v{i}") for i in range(3))
    return g.states.select((a == b).alias("ab"), (a == c).alias("ac"), (b == c).alias("bc"), "depth")


# -- formulas over the observed graph

@query(f"WITH RECURSIVE {GRAPH}, r(key) AS (SELECT key FROM p UNION SELECT e.pre FROM edges e JOIN r ON e.post = r.key) SELECT key FROM r WHERE key LIKE '%|view' AND key IN (SELECT pre FROM edges)")
def ctl_fand(spark, sf_dir):
    """Views with a next step from which a purchase can be reached."""
    g = event_graph(spark, sf_dir)
    named = {"view": lambda: kind_is(g, "view"), "purchase": lambda: kind_is(g, "purchase"), "any": lambda: g.nodes}
    return g.label(ctl.fand(ctl.atom("view"), ctl.EF(ctl.atom("purchase")), ctl.EX(ctl.atom("any"))), lambda p: named[p]())


@query(f"""WITH RECURSIVE {GRAPH}, z AS (SELECT key FROM ne), {REACH},
q AS (SELECT key FROM z WHERE key IN (SELECT key FROM p) UNION SELECT a FROM reach WHERE b IN (SELECT key FROM p)),
c AS (SELECT key FROM cyc WHERE key IN (SELECT key FROM q)) SELECT key FROM c UNION SELECT a FROM reach WHERE b IN (SELECT key FROM c)""")
def ctl_eg_fair_default(spark, sf_dir):
    """EG with fairness as it is by default: a state counts as reaching itself."""
    g = event_graph(spark, sf_dir)
    return g.eg_fair(kind_not(g, "error"), [kind_is(g, "purchase")])
