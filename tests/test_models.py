"""Exploration and verdicts on models with known counts."""

import pytest
from models import checkout, diamond, eq, loop, op, read, todo, toggles
from pyspark.sql import functions as F

from tidegraph.operators import ctl
from tidegraph.operators.explore import Limits, explore
from tidegraph.plans.check import always, always_step, check, leads_to_within, reachable, reachable_from, temporal


@pytest.mark.parametrize("model, stats", [(diamond(), (4, 4, 2)), (loop(), (2, 2, 2)), (toggles(5), (32, 80, 5))])
def test_counts(spark, model, stats):
    assert explore(spark, model).stats == stats


def test_checkout(spark):
    same = lambda f, at: eq({"kind": "readOpArg", "key": f}, at)
    done = {"resolved": ["POST_ORDER", "success"]}
    props = [
        always("guestCannotReachSuccess", op("not", op("and", eq(read("auth"), "guest"), eq(read("step"), "success")))),
        always_step("orderSuccessMatchesUser", {"negate": True, "step": done, "post": op("not", same("userId", read("userId")))}),
        always_step("orderSuccessMatchesCart", {"negate": True, "step": done, "post": op("not", same("plan", read("plan")))}),
        reachable_from("reviewCanReachSuccess", eq(read("step"), "review"), eq(read("step"), "success")),
    ]
    r = check(spark, checkout(), props)
    assert r.stats == (44, 176, 10)
    way = ["login", "selectPro", "goBilling", "selectPayment", "goReview", "submitOrder"]
    assert r.of("guestCannotReachSuccess")["status"] == "violated" and r.of("guestCannotReachSuccess")["trace"][-1] == "resolveOrderSuccess"
    assert r.of("orderSuccessMatchesUser")["trace"] == [*way, "logout", "resolveOrderSuccess"]
    assert r.of("orderSuccessMatchesCart")["trace"] == [*way, "selectStarter", "resolveOrderSuccess"]
    assert r.of("reviewCanReachSuccess")["status"] == "verified-within-bounds"


def test_todo(spark):
    r = check(spark, todo(), [always("x", op("not", eq(read("saveStatus"), "posting"))), always_step("stale", {"negate": True, "pre": op("eq", read("auth"), "guest"), "step": {"resolved": ["POST_TODO", "success"]}})], trace_mode="reference")
    assert r.stats == (139, 435, 10)
    assert r.of("x") | {"replayable": None} == {"property": "x", "status": "violated", "trace": [], "replayable": None}
    assert r.of("stale")["status"] == "violated" and r.of("stale")["trace"][-1] == "resolve.POST.success"


def test_verdict_kinds(spark):
    both, a = op("and", read("a"), read("b")), read("a")
    props = [reachable("both", both), always("notBoth", op("not", both)), temporal("afBoth", ctl.AF(ctl.atom(both))), temporal("egA", ctl.EG(ctl.atom(a))), leads_to_within("soon", {"transitionId": "flipA"}, both, 1, allowUserEvents=True), leads_to_within("never", {"transitionId": "none"}, both, 1)]
    r = check(spark, diamond(), props)
    assert [r.of(p["name"])["status"] for p in props] == ["verified-within-bounds", "violated", "verified-within-bounds", "vacuous-warning", "verified-within-bounds", "vacuous-warning"]
    assert sorted(r.of("notBoth")["trace"]) == ["flipA", "flipB"]
    assert check(spark, loop(), [temporal("x", ctl.EG(ctl.atom(op("or", a, op("not", a)))))]).of("x")["status"] == "verified"
    assert check(spark, toggles(4), [reachable("x", read("t0"))], Limits(states=4)).of("x")["status"] == "error"


def test_slicing_keeps_verdicts(spark):
    props = [reachable("one", op("and", read("t0"), read("t1"))), always("no", op("not", read("t2")))]
    whole, part = check(spark, toggles(4), props), check(spark, toggles(4), props, slicing=True)
    assert [v["status"][:8] for v in whole.verdicts] == [v["status"][:8] for v in part.verdicts] == ["verified", "violated"]
    assert part.stats[0] < whole.stats[0]


def test_runs_agree_whatever_the_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            g = explore(spark, checkout(), max_depth=6)
            seen.append(sorted((bytes(r.key), r.depth, r.tid, r.parent and bytes(r.parent)) for r in g.states.select("key", "depth", "tid", "parent").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    assert g.states.select(F.max("depth")).first()[0] == 6
