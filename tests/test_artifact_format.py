"""Artifact documents read through the data source, good and bad ones."""

import json

import pytest
from pyspark.sql import functions as F

from tidegraph.sources import artifact_format as af

STEP = {"transitionId": "go", "label": {}, "pre": {"x": 1}, "post": {"x": "é"}}
LEDGER = {k: [] for k in ("globalTaints", "staleReads", "unhandledRejections", "unextractableHandlers", "modelSlack")}
GOOD = {
    "trace": {"steps": [STEP, STEP | {"transitionId": "back"}]},
    "check-report": {"trustLedger": LEDGER, "verdicts": [{"property": "p", "status": "verified"}, {"property": "q", "status": "violated"}], "stats": {}, "vacuityWarnings": []},
    "extraction-report": {**dict.fromkeys(("sourceFiles", "plugins", "globalTaints", "staleReads", "unhandledRejections", "modelSlack", "domains", "warnings"), []), "handlers": [{"id": "h"}], "coverage": {}},
    "replay-report": {"verdict": {"status": "reproduced", "stepsRun": 3}},
    "conform-report": {"walks": [], "metrics": {}, "transitionMetrics": [{"transitionId": "go", "passRate": 1}]},
    "conformance-matrix-report": {"matrixId": "m", "fixtureResults": [{"fixtureId": "f", "status": "pass"}]},
    "canary-run-report": {"manifestId": "m", "canaryResults": [{"id": "c", "status": "pass"}], "classifications": []},
    "property-slice-manifest": {"modelId": "m", "sourceModelPath": "p", "sourceModelHash": "h", "generatedAt": "t", "properties": [{"property": "p", "propertyIndex": 0, "status": "skipped", "reason": "r"}]},
}


def doc(kind, /, **more):
    return {"schemaVersion": 1, "kind": kind, **GOOD[kind], **more}


def test_all_kinds(spark, tmp_path):
    for i, kind in enumerate(GOOD):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc(kind), indent=1))
    (tmp_path / "_ignored.json").write_text("{")
    rows = af.read_artifacts(spark, str(tmp_path)).collect()
    assert all(r.problem is None for r in rows)
    assert sorted((r.kind, r.item, r.id, r.status) for r in rows if r.id) == sorted([("trace", 0, "go", None), ("trace", 1, "back", None), ("check-report", 0, "p", "verified"), ("check-report", 1, "q", "violated"), ("extraction-report", 0, "h", None), ("conform-report", 0, "go", None), ("conformance-matrix-report", 0, "f", "pass"), ("canary-run-report", 0, "c", "pass"), ("property-slice-manifest", 0, "p", "skipped")])
    assert [(r.kind, r.status) for r in rows if not r.id] == [("replay-report", "reproduced")]
    assert json.loads(next(r.body for r in rows if r.id == "go" and r.kind == "trace")) == STEP


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_ranges_read_every_line_once(spark, tmp_path, size):
    docs = [doc("trace", steps=[STEP | {"transitionId": f"t{i}é"}] * (i % 4)) for i in range(40)]
    (tmp_path / "lines.txt").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs) + "\n\n  \n" + json.dumps(docs[3]))
    found = af.read_artifacts(spark, str(tmp_path / "lines.txt"), "trace", range=max(size, 40)) if size < 100 else af.read_artifacts(spark, str(tmp_path / "lines.txt"), range=size)
    got = sorted((r.id, r["count"]) for r in found.where("problem is null").groupBy("id").count().collect())
    assert got == sorted((f"t{i}é", i % 4 + (3 if i == 3 else 0)) for i in range(40) if i % 4)


def test_bad_documents_are_kept_aside(spark, tmp_path):
    bad = [
        ("{", None, "not JSON"), ("[1]", None, "not an object"), (doc("trace", schemaVersion=2), "trace", "unsupported schemaVersion 2"), (doc("trace", kind="tale"), "tale", "unknown kind tale"),
        (doc("trace", steps=[STEP, {"transitionId": "x", "pre": {}}]), "trace", "steps[1].post is not an object"), (doc("check-report", trustLedger={}), "check-report", "trustLedger.globalTaints is not a list"), (doc("check-report", stats=1), "check-report", "stats is not an object"),
        (doc("replay-report", verdict={"status": "odd", "stepsRun": 1}), "replay-report", "verdict[0].status is not known"), (doc("replay-report", verdict={"status": "reproduced"}), "replay-report", "verdict[0].stepsRun is not a number"), (doc("canary-run-report", manifestId=""), "canary-run-report", "manifestId is not a text"),
        (doc("property-slice-manifest", properties=[{"property": "p", "propertyIndex": 0, "status": "skipped"}]), "property-slice-manifest", "properties[0].reason is not a text"),
    ]
    lines = [d if isinstance(d, str) else json.dumps(d) for d, *_ in bad]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, json.dumps(doc("trace"))]))
    rows = af.read_artifacts(spark, str(tmp_path)).orderBy("at", "item").collect()
    assert [(r.kind, r.problem) for r in rows] == [*((k, p) for _, k, p in bad), ("trace", None), ("trace", None)]
    only = af.read_artifacts(spark, str(tmp_path), "check-report").where("kind = 'trace'")
    assert {r.problem for r in only.collect()} == {"unsupported schemaVersion 2", "not a check-report"}


def test_written_traces_are_read_back(spark, tmp_path):
    steps = spark.createDataFrame([("a", 2, "go", (1,), (2,)), ("a", 1, "in", (0,), (1,)), ("b", 1, "in", (5,), (6,))], "who string, n int, transition_id string, pre struct<x:int>, post struct<x:int>")
    af.write_traces(steps, ["who"], ["n"], str(tmp_path / "t"))
    rows = af.read_artifacts(spark, str(tmp_path / "t"), "trace").select("item", "id", F.get_json_object("body", "$.post.x").alias("x")).collect()
    assert sorted(map(tuple, rows)) == [(0, "in", "1"), (0, "in", "6"), (1, "go", "2")]
    (tmp_path / "none").mkdir()
    assert af.read_artifacts(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="missing"):
        af.read_artifacts(spark, str(tmp_path / "missing")).collect()
