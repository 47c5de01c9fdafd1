"""Result files: parity CSV, typed tables, snapshots, errors, debug tables and profile."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.engine import TraceEngine
from ..plans.validate import Checked


def write_csv(engine: TraceEngine, checked: Checked, out_dir: str) -> str:
    """One text file ``results/<query>`` as the command line gives it.

    A header of quoted labels if there is a legend, values joined by a comma and a
    space, a blank line at the end; rows in the order of their last event, then of
    the root event. Sorting is distributed; the driver writes the one local file,
    a partition of rows at a time. For large results see ``write_text``.
    """
    ordered = _ordered(engine, checked)
    path = os.path.join(out_dir, "results", checked.query.name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        if checked.query.legend:
            f.write(", ".join(f"'{x}'" for x in checked.query.legend) + "\n")
        for r in ordered.toLocalIterator(prefetchPartitions=True):
            f.write(r.value + "\n")
        f.write("\n")
    return path


def _ordered(engine: TraceEngine, checked: Checked) -> DataFrame:
    rows = engine.run(checked, typed=False)
    n = len(rows.schema["order"].dataType.fields) - 1
    return rows.orderBy("order.trace_id", *[f"order._o{k}" for k in range(n)]).select("value")


def write_text(engine: TraceEngine, checked: Checked, out_dir: str) -> str:
    """The rows of ``write_csv`` as text parts in order in the folder ``results/<query>``, written by the executors; no header, no blank line."""
    path = f"{out_dir.rstrip('/')}/results/{checked.query.name}"
    _ordered(engine, checked).write.mode("overwrite").text(path)
    return path


def write_table(engine: TraceEngine, checked: Checked, path: str, fmt: str = "parquet") -> None:
    """Typed results, written by all executors."""
    engine.run(checked).write.format(fmt).mode("overwrite").save(path)


def native_snapshot(document: str) -> str:
    """A snapshot as text: one ``%init`` line an agent, sites with states and bond numbers."""
    agents = json.loads(document)["agents"]
    bonds: dict[frozenset, int] = {}
    lines = []
    for a in agents:
        links = {b["site"]: (b["to"], b["to_site"]) for b in a.get("bonds") or []}
        parts = []
        for s in sorted({*(a.get("states") or {}), *links}):
            state = (a.get("states") or {}).get(s)
            bond = bonds.setdefault(frozenset([(a["id"], s), links[s]]), len(bonds) + 1) if s in links else "."
            parts.append(f"{s}{f'{{{state}}}' if state else ''}[{bond}]")
        lines.append(f"x{a['id']}:{a['kind']}({' '.join(parts)})")
    return "%init: 1 " + ", ".join(lines) + "\n"


def write_snapshots(engine: TraceEngine, checked: Checked, out_dir: str, native: bool = False) -> list[str]:
    """The documents behind the paths that the query returns, numbered as there."""
    docs = engine.snapshots_of(checked).distinct().orderBy("trace_id", "step", F.col("side").desc())
    pattern = engine.snapshots.replace(".json", ".ka") if native else engine.snapshots
    paths = []
    for k, r in enumerate(docs.toLocalIterator()):
        path = os.path.join(out_dir, pattern.replace("%", str(k)))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(native_snapshot(r.document) if native else r.document)
        paths.append(path)
    return paths


def write_debug(engine: TraceEngine, checked: list[Checked], out_dir: str, level: int) -> None:
    """``debug/<what>.json`` for level 1; at level 2 tables as well."""
    if level <= 0:
        return
    os.makedirs(os.path.join(out_dir, "debug"), exist_ok=True)
    found = {c.query.name: engine.debug(c, level) for c in checked}
    for what in next(iter(found.values()), {}):
        values = {n: d[what] for n, d in found.items()}
        if any(isinstance(v, DataFrame) for v in values.values()):
            for name, v in values.items():
                v.write.mode("overwrite").json(os.path.join(out_dir, "debug", what, name))
        else:
            with open(os.path.join(out_dir, "debug", f"{what}.json"), "w") as f:
                json.dump({n: v if isinstance(v, str) else repr(v) for n, v in values.items()}, f, indent=1)


def write_errors(errors: dict[str, str], out_dir: str) -> None:
    os.makedirs(out_dir, exist_ok=True)
    with open(os.path.join(out_dir, "errors.json"), "w") as f:
        json.dump(errors, f, indent=1)


def write_profile(seconds: dict[tuple[str, str], float], out_dir: str) -> None:
    """Seconds of each query and phase, the longest query first."""
    by: dict[str, dict[str, float]] = {}
    for (name, key), s in seconds.items():
        by.setdefault(name, {})[key] = s
    os.makedirs(out_dir, exist_ok=True)
    with open(os.path.join(out_dir, "profile.json"), "w") as f:
        json.dump(dict(sorted(by.items(), key=lambda x: -sum(x[1].values()))), f, indent=1)
