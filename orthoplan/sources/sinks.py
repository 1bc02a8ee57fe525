"""Files in the contracts' exact form. Each is one document, script or sheet, so it is small; tables go to Parquet.

A file is written beside its place and then renamed, so a stop leaves no half file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from ipaddress import ip_address
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoplan.functions.text import profile_key
from orthoplan.operators import plant, review


def put(path: str | Path, text: str) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".tmp")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)
    return path


def put_json(path: str | Path, value) -> Path:
    return put(path, json.dumps(value, ensure_ascii=False, indent=1))


def script_lines(nodes: DataFrame, edges: DataFrame):
    """The graph-load statements in order: the constraint, nodes, relationships."""
    rows = plant.statements(nodes, edges).orderBy("section", "k1", "k2", "k3", "statement")
    return (r.statement for r in rows.toLocalIterator())


def put_script(path: str | Path, nodes: DataFrame, edges: DataFrame) -> dict:
    head = ["// plant graph", "// FLOWS_TO = verified flow direction; CONNECTED_TO = drawing order only"]
    lines = list(script_lines(nodes, edges))
    put(path, "\n".join(head + [s + ";" for s in lines]) + "\n")
    return {"kind": "cypher-script", "script": str(path), "path": str(path), "nodes": sum(s.startswith("MERGE (n") for s in lines), "relationships": sum(s.startswith("MATCH") for s in lines)}


def local_endpoint(uri: str) -> str:
    """A graph database on this machine, unencrypted; anything else is refused."""
    u = urlsplit(uri)
    if u.scheme not in ("bolt", "neo4j"):
        raise ValueError(f"a graph store's scheme is bolt or neo4j, got {uri!r}")
    host = u.hostname or ""
    try:
        local = ip_address(host).is_loopback
    except ValueError:
        local = host == "localhost"
    if not local:
        raise ValueError(f"a graph store is on this machine only, got {uri!r}")
    return uri


def load_graph(uri: str, open_driver: Callable, nodes: DataFrame, edges: DataFrame, database: str = "neo4j") -> dict:
    """Runs the script's statements one by one; the order matters, so by the driver."""
    local_endpoint(uri)
    n = 0
    with open_driver(uri) as driver, driver.session(database=database) as session:
        for statement in script_lines(nodes, edges):
            session.run(statement)
            n += 1
    return {"kind": "neo4j", "uri": uri, "database": database, "statements": n}


def put_training_set(path: str | Path, verdicts: DataFrame, profile: dict, source: str | None = None) -> dict:
    """One profile's examples as JSON lines by sheet and detection; refuses a profile without any."""
    mine = verdicts.filter((F.col("profile_name") == profile["name"]) & (F.col("profile_version") == profile["version"]))
    rows = review.training_examples(mine, source).orderBy("rank")
    counts, out = dict.fromkeys(("positive", "negative", "corrected"), 0), []
    for r in rows.toLocalIterator():
        counts[r.example] += 1
        detection = json.loads(r.detection)
        fixed = json.loads(r.correction) if r.correction else {}
        fields = {"symbol": ("symbol_class", "bbox"), "line": ("line_class", "polyline"), "text": ("text_class", "string", "bbox")}[r.kind]
        label = None if r.verdict == "reject" else {f: fixed.get(f, detection.get(f)) for f in fields}
        out.append(json.dumps({"profile": profile, "source": source, "sheet": r.sheet, "kind": r.kind, "verdict": r.verdict, "example": r.example, "detection": detection, "label": label}, ensure_ascii=False))
    if not out:
        raise ValueError(f"no labelled examples for profile {profile}")
    put(path, "\n".join(out) + "\n")
    return {"path": str(path), "profile": profile, "source": source, "count": len(out), "examples": counts}


def put_verdict_store(root: str | Path, verdicts: DataFrame) -> int:
    """The latest verdicts as <root>/<profile key>/sheet_N.json; a sheet's examples fit in one row."""
    latest = review.latest_verdicts(verdicts)
    rows = latest.groupBy("profile_name", "profile_version", "sheet").agg(F.array_sort(F.collect_list(F.struct("detection_id", "verdict", "kind", "detection", "correction"))).alias("e"))
    n = 0
    for r in rows.withColumn("key", profile_key("profile_name", "profile_version")).toLocalIterator():
        examples = {}
        for e in r.e:
            examples[e.detection_id] = {"verdict": e.verdict, "kind": e.kind, "detection": json.loads(e.detection)} | ({"correction": json.loads(e.correction)} if e.correction else {})
        put_json(Path(root) / r.key / f"sheet_{r.sheet}.json", {"profile": {"name": r.profile_name, "version": r.profile_version}, "sheet": r.sheet, "examples": examples})
        n += 1
    return n


def append_event(path: str | Path, at: str, event: str, sheet: int, **fields) -> dict:
    """One line of an activity log. The clock is the caller's."""
    entry = {"at": at, "event": event, "sheet": sheet, **fields}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    return entry
