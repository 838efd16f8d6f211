"""Artifact documents as a Spark data source: traces, six kinds of reports and slice manifests, read in parallel.

spark.read.format("artifacts").load(path) gives a row for each item of each document: a step of a trace, a verdict, a
handler, a metric, a fixture or canary result, a slice. Files that end in .json hold one document; of other files each line
is one. Files of lines are cut into ranges of bytes, so one large file is many tasks' work. A document that isn't of its
kind makes one row with a problem and no item, and the others are read all the same.

Option kind: documents of other kinds count as problems. Option range: bytes of a task's range.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, path string, at long, item int, id string, status string, body string, problem string"


@dataclass(frozen=True)
class Kind:
    """Where a document's items are, what names an item and its state, and the types that the document and its items need."""

    items: str
    id: str
    status: str | None = None
    lists: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    item_texts: tuple[str, ...] = ()
    item_objects: tuple[str, ...] = ()
    item_numbers: tuple[str, ...] = ()
    states: tuple[str, ...] = field(default=())


#: The fields of each kind of document.
KINDS = {
    "trace": Kind("steps", "transitionId", lists=("steps",), item_texts=("transitionId",), item_objects=("pre", "post")),
    "check-report": Kind("verdicts", "property", "status", lists=("verdicts", "vacuityWarnings", "trustLedger.globalTaints", "trustLedger.staleReads", "trustLedger.unhandledRejections", "trustLedger.unextractableHandlers", "trustLedger.modelSlack"), objects=("trustLedger", "stats")),
    "extraction-report": Kind("handlers", "id", lists=("sourceFiles", "plugins", "handlers", "globalTaints", "staleReads", "unhandledRejections", "modelSlack", "domains", "warnings"), objects=("coverage",)),
    "replay-report": Kind("verdict", "property", "status", objects=("verdict",), item_numbers=("stepsRun",), states=("reproduced", "not-reproduced", "inconclusive")),
    "conform-report": Kind("transitionMetrics", "transitionId", lists=("walks", "transitionMetrics"), objects=("metrics",)),
    "conformance-matrix-report": Kind("fixtureResults", "fixtureId", "status", lists=("fixtureResults",), texts=("matrixId",)),
    "canary-run-report": Kind("canaryResults", "id", "status", lists=("canaryResults", "classifications"), texts=("manifestId",)),
    "property-slice-manifest": Kind("properties", "property", "status", lists=("properties",), texts=("modelId", "sourceModelPath", "sourceModelHash", "generatedAt"), item_texts=("property",), item_numbers=("propertyIndex",)),
}


def _at(doc, path: str):
    for k in path.split("."):
        doc = doc.get(k) if isinstance(doc, dict) else None
    return doc


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


CHECKS: tuple[tuple[str, Callable, str], ...] = (("lists", lambda v: isinstance(v, list), "a list"), ("objects", lambda v: isinstance(v, dict), "an object"), ("texts", lambda v: isinstance(v, str) and v != "", "a text"))
ITEM_CHECKS: tuple[tuple[str, Callable, str], ...] = (("item_texts", lambda v: isinstance(v, str), "a text"), ("item_objects", lambda v: isinstance(v, dict), "an object"), ("item_numbers", _number, "a number"))


def parse(text: str, wanted: str | None = None) -> tuple[str | None, list[dict], str | None]:
    """(kind, items, problem) of a document; no items where there is a problem."""
    try:
        doc = json.loads(text)
    except ValueError:
        return None, [], "not JSON"
    if not isinstance(doc, dict):
        return None, [], "not an object"
    name = doc.get("kind") if isinstance(doc.get("kind"), str) else None
    if doc.get("schemaVersion") != 1 or isinstance(doc.get("schemaVersion"), bool):
        return name, [], f"unsupported schemaVersion {doc.get('schemaVersion')}"
    if name not in KINDS or (wanted is not None and name != wanted):
        return name, [], f"not a {wanted}" if wanted else f"unknown kind {name}"
    kind = KINDS[name]
    for group, ok, what in CHECKS:
        for path in getattr(kind, group):
            if not ok(_at(doc, path)):
                return name, [], f"{path} is not {what}"
    items = doc[kind.items] if isinstance(doc[kind.items], list) else [doc[kind.items]]
    for i, item in enumerate(items):
        if not isinstance(item, dict):
            return name, [], f"{kind.items}[{i}] is not an object"
        for group, ok, what in ITEM_CHECKS:
            for k in getattr(kind, group):
                if not ok(item.get(k)):
                    return name, [], f"{kind.items}[{i}].{k} is not {what}"
        if kind.states and item.get(kind.status) not in kind.states:
            return name, [], f"{kind.items}[{i}].{kind.status} is not known"
        if name == "property-slice-manifest" and item.get("status") == "skipped" and not isinstance(item.get("reason"), str):
            return name, [], f"{kind.items}[{i}].reason is not a text"
    return name, items, None


@dataclass
class Range(InputPartition):
    """Documents of a file that begin in [start, end); whole: the file is one document."""

    path: str
    start: int
    end: int
    whole: bool


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.range = options["path"], options.get("kind"), int(options.get("range", 64 << 20))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        out: list[Range] = []
        for f in sorted(listed, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")):
                whole = f.base_name.endswith(".json")
                out += [Range(f.path, a, min(a + self.range, f.size), whole) for a in ([0] if whole else range(0, f.size, self.range))]
        return out or [Range("", 0, 0, True)]

    def _documents(self, p: Range) -> Iterator[tuple[int, bytes]]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        with io.BufferedReader(files.open_input_file(p.path)) as f:
            if p.whole:
                yield 0, f.read()
                return
            f.seek(max(0, p.start - 1))
            if p.start:
                f.readline()  # the end of a line that begins before the range
            while (at := f.tell()) < p.end and (line := f.readline()):
                if line.strip():
                    yield at, line

    def read(self, p: Range) -> Iterator[tuple]:
        if not p.path:
            return
        for at, raw in self._documents(p):
            name, items, problem = parse(raw.decode("utf-8", "replace"), self.kind)
            if problem is not None:
                yield (name, p.path, at, None, None, None, None, problem)
                continue
            kind = KINDS[name]
            for i, item in enumerate(items):
                state = item.get(kind.status) if kind.status else None
                one = item.get(kind.id)
                yield (name, p.path, at, i, one if isinstance(one, str) else None, state if isinstance(state, str) else None, json.dumps(item, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None)


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArtifactSource)


def read_artifacts(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    register(spark)
    reader = spark.read.format("artifacts").options(**{k: str(v) for k, v in options.items()})
    return (reader.option("kind", kind) if kind else reader).load(path)


def write_traces(steps: DataFrame, by: list[str], order: list[str], path: str) -> None:
    """steps(by..., order..., transition_id, pre, post), pre and post structs, as trace documents, one a line and for each
    value of by. A document is gathered whole, so a trace has to be of bounded length, as a user's day is."""
    step = F.struct(F.col("transition_id").alias("transitionId"), "pre", "post")
    rows = F.array_sort(F.collect_list(F.struct(*order, step.alias("step"))))
    docs = steps.groupBy(*by).agg(F.transform(rows, lambda x: x.step).alias("steps"))
    docs.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit("trace").alias("kind"), "steps"))).write.text(path)
