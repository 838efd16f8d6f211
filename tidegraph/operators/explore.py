"""State-space exploration as a layered recursive query.

Each layer is one job: expand the frontier (every transition's successors are one array expression), bring them to rest
under internal transitions, key them, drop those that were seen (anti-join), keep the least parent of each. Layers are
written to the shared folder, so neither lineage nor memory grows with depth.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.domains import ddl, shape_of
from tidegraph.functions.exprs import Scope
from tidegraph.functions.keys import state_key
from tidegraph.model import Model, ModelError
from tidegraph.operators.effects import Effects, state_ddl, state_row
from tidegraph.scratch import materialize, new_path

#: Internal transitions whose orders are all tried when they write the same variables.
MOST_CONFLICTING = 5


@dataclass
class Limits:
    states: int = 1_000_000
    edges: int = 5_000_000
    frontier: int = 250_000


@dataclass
class Graph:
    """states(key, depth, parent, tid, s), edges(pre, tid, raw, stab, post, pre_s, post_s): tid indexes model.sorted_transitions."""

    model: Model
    states: DataFrame
    edges: DataFrame
    n_states: int
    n_edges: int
    depth: int
    exhausted: bool
    frontier: DataFrame
    stopped: str | None = None
    bound_hits: list[str] = field(default_factory=list)

    @property
    def stats(self) -> tuple[int, int, int]:
        return self.n_states, self.n_edges, self.depth

    @property
    def initial(self) -> DataFrame:
        return self.states.where("depth = 0")


class Explorer:
    def __init__(self, spark: SparkSession, model: Model, starts: DataFrame | None = None):
        """starts: a table of start states, a column for each variable by id; a variable without one, and every variable
        where there is no table, starts as the model says. Rows may repeat; other columns are not looked at."""
        self.spark, self.model, self.effects, self.starts = spark, model, Effects(model), starts
        self.rules = list(enumerate(model.sorted_transitions))
        self.bound_hits: set[str] = set()
        self._columns: dict[str, Column] = {}
        self.internal = [(i, t) for i, t in self.rules if t["cls"] == "internal"]

    def _once(self, name: str, make) -> Column:
        """A compiled expression, built once for all layers."""
        if name not in self._columns:
            self._columns[name] = make()
        return self._columns[name]

    # -- successors of one state, before internal transitions
    def raw_successors(self, s: Column) -> Column:
        """Array of (tid, raw, post): branches of each enabled transition that is not internal."""
        kind = f"array<struct<tid:int,raw:int,post:{state_ddl(self.model)}>>"
        scope, each = Scope(self.model, s), []
        for i, t in self.rules:
            if t["cls"] != "internal":
                posts = self.effects.reset(self.effects.apply(t["effect"], s, s), s)
                rows = F.transform(posts, lambda p, k: F.struct(F.lit(i).alias("tid"), k.alias("raw"), p.alias("post")))
                each.append(F.when(scope.enabled(t), rows.cast(kind)).otherwise(F.array().cast(kind)))
        return F.flatten(F.array(*each)) if each else F.array().cast(kind)

    # -- internal transitions to rest
    def stabilize(self, rows: DataFrame) -> DataFrame:
        """rows(..., s, changed): s replaced by the states at rest, with the branches taken on the way as stab; rows that do
        not come to rest within the bound have none, which counts as a bound hit. Each round is one projection of those rows that still move."""
        if not self.internal:
            return rows.drop("changed").withColumn("stab", F.array().cast("array<int>"))
        keep = [c for c in rows.columns if c not in ("s", "changed")]
        done, rows = None, rows.withColumn("stab", F.array().cast("array<int>"))
        for _ in range(self.model.max_internal_steps):
            active = rows.withColumn("go", self._once("ready", lambda: self._ready(F.col("s"), F.col("changed"))))
            rest = active.where(F.size("go") == 0).select(*keep, "s", "stab")
            done = rest if done is None else done.unionByName(rest)
            moved = active.where(F.size("go") > 0).withColumn("next", self._once("sequences", lambda: self._sequences(F.col("s"), F.col("go"))))
            moved = moved.select(*keep, F.posexplode("next").alias("k", "n"), F.col("stab").alias("was"))
            moved = moved.select(*keep, F.col("n.s").alias("s"), F.col("n.changed").alias("changed"), F.concat("was", F.array("k")).alias("stab"))
            by = [*keep, self._once("key", lambda: state_key(self.model, F.col("s"))).alias("k")]
            rows = moved.groupBy(*by).agg(F.min_by(F.struct("s", "changed", "stab"), "stab").alias("m")).select(*keep, "m.s", "m.changed", "m.stab")
            rows = materialize(rows, "moving")
            if rows.isEmpty():
                return done
        self.bound_hits.add("maxInternalSteps reached")  # as rows are left
        return done

    def _ready(self, s: Column, changed: Column) -> Column:
        scope, each = Scope(self.model, s), []
        for i, t in self.internal:
            by = [self.model.index[v] for v in t.get("triggeredBy") or ()]
            fired = F.arrays_overlap(changed, F.array(*map(F.lit, by))) if by else F.lit(True)
            each.append(F.when(fired & scope.enabled(t), i))
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    def _sequences(self, s: Column, go: Column) -> Column:
        """Array of (s, changed) after one round: in order of ids, or in all orders if two of the ready ones conflict."""
        writes = {i: set(t.get("writes") or self.model.effect_writes(t["effect"])) for i, t in self.internal}
        conflicts = [(i, j) for (i, _), (j, _) in itertools.combinations(self.internal, 2) if writes[i] & writes[j]]
        plain = self._sequence(s, go, [i for i, _ in self.internal])
        if not conflicts:
            return plain
        if len(self.internal) > MOST_CONFLICTING:
            raise ModelError(f"more than {MOST_CONFLICTING} internal transitions with conflicting writes")
        tier = {i: t.get("phase") if t.get("phase") is not None else float("inf") for i, t in self.internal}
        orders = [p for p in itertools.permutations([i for i, _ in self.internal]) if all(tier[a] <= tier[b] for a, b in itertools.pairwise(p))]
        clash = reduce(lambda a, b: a | b, (F.array_contains(go, i) & F.array_contains(go, j) for i, j in conflicts))
        return F.when(clash, F.concat(*(self._sequence(s, go, p) for p in orders))).otherwise(plain)

    def _sequence(self, s: Column, go: Column, order) -> Column:
        states, by = F.array(s), dict(self.internal)
        for i in order:
            t = by[i]
            states = F.flatten(F.transform(states, lambda x: F.when(F.array_contains(go, i) & Scope(self.model, x).enabled(t), self.effects.apply(t["effect"], x, s)).otherwise(F.array(x))))
        return F.transform(states, lambda x: F.struct(x.alias("s"), self.effects.changed(s, x).alias("changed")))

    # -- the recursive query
    def initial(self) -> DataFrame:
        rows = self.spark.range(1).select(F.explode(F.array(*(state_row(self.model, v) for v in self.model.initial_states()))).alias("s0"))
        if self.starts is not None:
            given = {v["id"]: i for i, v in enumerate(self.model.vars) if v["id"] in self.starts.columns}
            table = self.starts.select(*(F.col(f"`{k}`").alias(f"v{i}") for k, i in given.items())).distinct()
            s0 = F.array(*(state_row(self.model, v) for v in self.model.initial_states()))
            s = F.col("s0")
            for k, i in given.items():
                s = s.withField(f"v{i}", F.col(f"v{i}").cast(ddl(shape_of(self.model.var(k)["domain"]))))
            rows = table.withColumn("s0", F.explode(s0)).select(s.alias("s0"))
        rows = rows.select(F.explode(self.effects.reset(F.array("s0"), None)).alias("s"))
        # Right after the start every variable counts as changed.
        every = F.array(*(F.lit(i) for i in range(len(self.model.vars))))
        rows = self.stabilize(rows.withColumn("changed", every))
        keyed = rows.withColumn("key", state_key(self.model, F.col("s")))
        return keyed.groupBy("key").agg(F.min_by("s", "stab").alias("s")).select("key", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("int").alias("tid"), "s")

    def expand(self, states: DataFrame) -> DataFrame:
        """All steps from states(key, s): edges(pre, tid, raw, stab, post, pre_s, post_s)."""
        out = states.select(F.col("key").alias("pre"), F.col("s").alias("pre_s"), F.explode(self._once("next", lambda: self.raw_successors(F.col("s")))).alias("n"))
        out = out.select("pre", "pre_s", "n.tid", "n.raw", F.col("n.post").alias("s"))
        out = self.stabilize(out.withColumn("changed", self._once("changed", lambda: self.effects.changed(F.col("pre_s"), F.col("s")))) if self.internal else out)
        return out.select("pre", "tid", "raw", "stab", self._once("key", lambda: state_key(self.model, F.col("s"))).alias("post"), "pre_s", F.col("s").alias("post_s"))

    @staticmethod
    def _write(rows: DataFrame, path: str) -> int:
        """Writes rows and returns how many, counted on the way."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
        return seen.get["n"]

    def run(self, limits: Limits | None = None, max_depth: int | None = None) -> Graph:
        limits, spark = limits or Limits(), self.spark
        depth_bound = self.model.max_depth if max_depth is None else max_depth
        kind = state_ddl(self.model)
        state_paths, edge_paths = [new_path(spark, "layer")], []
        self.initial().write.option("compression", "zstd").parquet(state_paths[0])
        read_states = lambda paths: spark.read.schema(f"key binary, depth int, parent binary, tid int, s {kind}").parquet(*paths)
        edge_schema = f"pre binary, tid int, raw int, stab array<int>, post binary, pre_s {kind}, post_s {kind}"
        read_edges = lambda paths: spark.read.schema(edge_schema).parquet(*paths) if paths else spark.createDataFrame([], edge_schema)
        frontier = read_states(state_paths)
        n_states, n_edges, depth, width, stopped = frontier.count(), 0, 0, None, None
        width = n_states
        while width and depth < depth_bound:
            if n_states >= limits.states or n_edges >= limits.edges or width >= limits.frontier:
                stopped = "maxStates" if n_states >= limits.states else "maxEdges" if n_edges >= limits.edges else "maxFrontier"
                break
            path = new_path(spark, "edges")
            n_edges += self._write(self.expand(frontier.select("key", "s")), path)
            layer = read_edges([path])
            edge_paths.append(path)
            best = layer.groupBy(F.col("post").alias("key")).agg(F.min_by(F.struct("pre", "tid", "post_s"), F.struct("pre", "tid", "raw", "stab")).alias("m"))
            new = best.join(read_states(state_paths).select("key"), "key", "left_anti").select("key", F.lit(depth + 1).alias("depth"), F.col("m.pre").alias("parent"), F.col("m.tid").alias("tid"), F.col("m.post_s").alias("s"))
            path = new_path(spark, "layer")
            width = self._write(new, path)
            state_paths.append(path)
            frontier = read_states([path])
            n_states, depth = n_states + width, depth + 1
        return Graph(self.model, read_states(state_paths), read_edges(edge_paths), n_states, n_edges, depth, not width, frontier, stopped, sorted(self.bound_hits))


def explore(spark: SparkSession, model: Model, limits: Limits | None = None, max_depth: int | None = None, starts: DataFrame | None = None) -> Graph:
    return Explorer(spark, model, starts).run(limits, max_depth)


def initial_states(spark: SparkSession, model: Model) -> DataFrame:
    """The initial states at rest, by key."""
    return Explorer(spark, model).initial().orderBy("key")


def successors(spark: SparkSession, model: Model, values: dict) -> DataFrame:
    """All steps from one state, given as values by variable."""
    row = spark.range(1).select(state_row(model, values).alias("s")).withColumn("key", state_key(model, F.col("s")))
    return Explorer(spark, model).expand(row)
