"""Small transition models whose state counts are known."""

from tidegraph.model import parse_model

BOOL = {"kind": "bool"}


def lit(v):
    return {"kind": "lit", "value": v}


def read(v, *path):
    return {"kind": "read", "var": v, **({"path": list(path)} if path else {})}


def wrap(v):
    return v if isinstance(v, dict) and "kind" in v else lit(v)


def eq(a, b):
    return {"kind": "eq", "args": [wrap(a), wrap(b)]}


def op(kind, *args):
    return {"kind": kind, "args": [wrap(a) for a in args]}


def enum(*values):
    return {"kind": "enum", "values": list(values)}


def var(name, domain, initial, **more):
    return {"id": name, "domain": domain, "origin": "system", "scope": {"kind": "global"}, "initial": initial, **more}


def put(name, value):
    return {"kind": "assign", "var": name, "expr": wrap(value)}


def seq(*effects):
    return {"kind": "seq", "effects": list(effects)}


def when(cond, then, other=None):
    return {"kind": "if", "cond": cond, "then": then, "else": other or seq()}


def enqueue(name, cont="k", **args):
    return {"kind": "enqueue", "op": name, "continuation": cont, "args": {k: wrap(v) for k, v in args.items()}}


def dequeue(i=0):
    return {"kind": "dequeue", "index": i}


def rule(name, guard, effect, cls="user", label=None, **more):
    return {"id": name, "cls": cls, "label": label or {"kind": "click", "text": name}, "source": [], "guard": wrap(guard), "effect": effect, "reads": [], "writes": [], "confidence": "exact", **more}


def queue(ops, args, most):
    item = {"kind": "record", "fields": {"opId": enum(*ops), "continuation": enum("k"), "args": {"kind": "record", "fields": args}}}
    return var("sys:pending", {"kind": "boundedList", "inner": item, "maxLen": most}, [], role={"kind": "pending-queue"})


def model(name, variables, rules, depth, pending=1, internal=4):
    return parse_model({"schemaVersion": 1, "id": name, "vars": variables, "transitions": rules, "bounds": {"maxDepth": depth, "maxPending": pending, "maxInternalSteps": internal}})


def diamond():
    return model("diamond", [var("a", BOOL, False), var("b", BOOL, False)], [rule("flipA", op("not", read("a")), put("a", True)), rule("flipB", op("not", read("b")), put("b", True))], 2)


def loop():
    return model("loop", [var("a", BOOL, False)], [rule("setTrue", op("not", read("a")), put("a", True)), rule("setFalse", read("a"), put("a", False))], 4)


def toggles(n=8):
    return model("toggles", [var(f"t{i}", BOOL, False) for i in range(n)], [rule(f"flip{i}", op("not", read(f"t{i}")), put(f"t{i}", True)) for i in range(n)], n, 0)


def checkout():
    user = eq(read("auth"), "user")
    head = eq(read("sys:pending", "0", "opId"), "POST_ORDER")
    variables = [
        queue(["POST_ORDER"], {"userId": enum("none", "u1"), "plan": enum("none", "starter", "pro")}, 2),
        var("auth", enum("guest", "user"), "guest"), var("userId", enum("none", "u1"), "none"), var("plan", enum("none", "starter", "pro"), "none"),
        var("step", enum("plan", "billing", "review", "success"), "plan"), var("paymentMethod", enum("none", "valid"), "none"), var("submitStatus", enum("idle", "submitting", "failed"), "idle"),
    ]
    rules = [
        rule("login", eq(read("auth"), "guest"), seq(put("auth", "user"), put("userId", "u1"))),
        rule("logout", user, seq(put("auth", "guest"), put("userId", "none"), put("plan", "none"), put("paymentMethod", "none"), put("step", "plan"), put("submitStatus", "idle"))),
        rule("selectPro", user, put("plan", "pro")),
        rule("selectStarter", user, put("plan", "starter")),
        rule("goBilling", op("and", user, op("neq", read("plan"), "none")), put("step", "billing")),
        rule("selectPayment", op("and", user, eq(read("step"), "billing")), put("paymentMethod", "valid")),
        rule("goReview", op("and", user, eq(read("step"), "billing"), eq(read("paymentMethod"), "valid")), put("step", "review")),
        rule("submitOrder", op("and", user, eq(read("step"), "review"), eq(read("submitStatus"), "idle"), op("neq", read("plan"), "none")), seq(put("submitStatus", "submitting"), enqueue("POST_ORDER", userId=read("userId"), plan=read("plan")))),
        rule("resolveOrderSuccess", head, seq(dequeue(), put("submitStatus", "idle"), put("step", "success")), "env", {"kind": "resolve", "op": "POST_ORDER", "outcome": "success"}),
        rule("resolveOrderError", head, seq(dequeue(), put("submitStatus", "failed")), "env", {"kind": "resolve", "op": "POST_ORDER", "outcome": "error"}),
    ]
    return model("checkout", variables, rules, 10, 2, 8)


def todo():
    user, head = eq(read("auth"), "user"), read("sys:pending", "0", "opId")
    variables = [
        queue(["GET_TODOS", "POST_TODO"], {}, 3), var("auth", enum("guest", "user"), "guest"), var("draft", enum("empty", "nonEmpty"), "empty"), var("saveStatus", enum("idle", "posting", "failed"), "idle"),
        var("todosData", enum("none", "0", "1", "many"), "none"), var("todosValidating", BOOL, False), var("todosError", BOOL, False),
    ]
    got = lambda n: seq(dequeue(), put("todosData", n), put("todosValidating", False), put("todosError", False))
    resolve = lambda o, out: {"kind": "resolve", "op": o, "outcome": out}
    rules = [
        rule("App.login", eq(read("auth"), "guest"), seq(put("auth", "user"), when(eq(read("todosData"), "none"), seq(put("todosValidating", True), enqueue("GET_TODOS"))))),
        rule("App.logout", user, seq(put("auth", "guest"), put("draft", "empty"), put("saveStatus", "idle"))),
        rule("App.input.nonEmpty", op("and", user, op("neq", read("todosData"), "none")), put("draft", "nonEmpty")),
        rule("App.submit", op("and", user, eq(read("draft"), "nonEmpty"), eq(read("saveStatus"), "idle")), seq(put("saveStatus", "posting"), enqueue("POST_TODO"))),
        rule("resolve.GET.successEmpty", eq(head, "GET_TODOS"), got("0"), "env", resolve("GET_TODOS", "successEmpty")),
        rule("resolve.GET.successSome", eq(head, "GET_TODOS"), got("1"), "env", resolve("GET_TODOS", "successSome")),
        rule("resolve.GET.error", eq(head, "GET_TODOS"), seq(dequeue(), put("todosValidating", False), put("todosError", True)), "env", resolve("GET_TODOS", "error")),
        rule("resolve.POST.success", eq(head, "POST_TODO"), seq(dequeue(), put("draft", "empty"), put("saveStatus", "idle"), put("todosValidating", True), enqueue("GET_TODOS")), "env", resolve("POST_TODO", "success")),
        rule("resolve.POST.error", eq(head, "POST_TODO"), seq(dequeue(), put("saveStatus", "failed")), "env", resolve("POST_TODO", "error")),
    ]
    return model("todo", variables, rules, 10, 3, 8)
