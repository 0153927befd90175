"""Reports: dataset and training HTML, benchmark JSON. They hold aggregates and bounded samples only."""

from __future__ import annotations

import html
import json
import os
import platform
import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators.contracts import validate_benchmark

PAGE = '<!doctype html><html lang="en"><meta charset="utf-8"><title>{title}</title><style>body{{font:15px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:right}}.g{{display:inline-block;margin:4px;text-align:center}}</style><h1>{title}</h1>{body}</html>'


def _write(path: str, text: str) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".tmp", path)


def _table(rows: list[tuple], head: tuple) -> str:
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else html.escape(str(v))
    return "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def _line(values: list[float], name: str, width: int = 480, height: int = 160) -> str:
    low, high = min(values), max(values)
    at = " ".join(f"{i * width / max(1, len(values) - 1):.1f},{height - (v - low) / ((high - low) or 1) * height:.1f}" for i, v in enumerate(values))
    return f'<h2>{name}</h2><svg width="{width}" height="{height}" role="img" aria-label="{name}"><polyline fill="none" stroke="#245" points="{at}"/></svg><p>{low:.6g} to {high:.6g}</p>'


def training_report(metrics: DataFrame, path: str) -> dict:
    """Number of epochs, final accuracy in percent, loss and learning rate, and three line charts."""
    rows = metrics.orderBy("epoch").collect()  # one row an epoch
    if not rows:
        raise ValueError("no epochs")
    last = rows[-1]
    summary = {"epochs": len(rows), "accuracy": 100 * last["accuracy"], "cost": last["cost"], "learning_rate": last["learning_rate"]}
    charts = "".join(_line([float(r[c]) for r in rows], c.replace("_", " ")) for c in ("accuracy", "cost", "learning_rate"))
    _write(path, PAGE.format(title="Training", body=_table([tuple(summary.values())], ("epochs", "accuracy %", "loss", "learning rate")) + charts))
    return summary


def dataset_report(df: DataFrame, path: str, limit: int = 64, classes: int = 10, side: int = 28) -> dict:
    """Metrics, class histogram and the first samples as a grid of grey cells; invalid rows raise ValueError."""
    from ..operators.preprocessing import invalid_rows

    wrong = invalid_rows(df, side * side, classes).where("problem is not null").groupBy("problem").count().orderBy("problem").collect()
    if wrong:
        raise ValueError(", ".join(f"{r['count']} rows: {r['problem']}" for r in wrong))
    p = prof.profile(df).first().asDict()
    hist = prof.histogram(df, classes=classes).orderBy("label").collect()
    grid = []
    for r in prof.sample_grid(df, limit).collect():
        cells = "".join(f'<rect x="{i % side}" y="{i // side}" width="1" height="1" fill="rgb({int(v * 255)},{int(v * 255)},{int(v * 255)})"/>' for i, v in enumerate(r["features"]) if v > 0)
        grid.append(f'<span class="g"><svg width="56" height="56" viewBox="0 0 {side} {side}"><rect width="{side}" height="{side}"/>{cells}</svg><br>{int(r["label"])}</span>')
    _write(path, PAGE.format(title="Dataset", body=_table([tuple(p.values())], tuple(p)) + _table([tuple(r) for r in hist], ("label", "rows", "% of largest")) + "".join(grid)))
    return p


def terminal_image(df: DataFrame, row_id: int, side: int = 28, features_col: str = "features") -> str:
    """One image as lines of coloured cells."""
    codes = df.where(F.col("row_id") == row_id).select(F.transform(F.col(features_col).cast("array<double>"), lambda v: F.lit(232) + F.floor(v * 23).cast("int")).alias("c")).limit(1).collect()
    if not codes:
        raise ValueError(f"no row {row_id}")
    c = codes[0]["c"]
    return "\n".join("".join(f"\x1b[48;5;{v}m  " for v in c[i : i + side]) + "\x1b[0m" for i in range(0, len(c), side))


def benchmark(spark: SparkSession, name: str, query: Callable[[], DataFrame], operations: float, iterations: int = 10, warm_up: int = 2, seed: int = 5489) -> dict:
    """Time a query that is run to the end into a sink that keeps nothing; latencies in ms, operations per second."""
    if iterations < 1 or warm_up < 0:
        raise ValueError("at least one iteration")
    force = lambda: query().write.format("noop").mode("overwrite").save()
    for _ in range(warm_up):
        force()
    took = []
    for _ in range(iterations):
        t = time.perf_counter()
        force()
        took.append((time.perf_counter() - t) * 1000)
    p = prof.percentile(spark.createDataFrame([(v,) for v in took], "v double"), "v", [0.5, 0.95]).first()
    metrics = {"iterations": iterations, "total_ms": sum(took), "mean_ms": sum(took) / iterations, "p50_ms": p["p50"], "p95_ms": p["p95"], "throughput": operations * iterations / (sum(took) / 1000), "peak_resident_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}
    manifest = {"run_id": f"{name}-{seed}", "benchmark": name, "seed": seed, "compiler": f"Spark {spark.version}, Python {platform.python_version()}", "platform": platform.platform(), "arguments": [f"--iterations={iterations}", f"--seed={seed}"]}
    return {"schema_version": 1, "manifest": manifest, "metrics": metrics}


def write_benchmark(report: dict, path: str) -> None:
    """The report as JSON, numbers with 12 significant digits."""
    validate_benchmark(report)
    short = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    _write(path, json.dumps(report | {"metrics": {k: short(v) for k, v in report["metrics"].items()}}, indent=2) + "\n")
