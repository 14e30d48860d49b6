"""Sinks at the edges: mirrored CSV, nested JSON lines, requests, statistics, reports, manifests."""

from __future__ import annotations

import json
import platform
import sys
import time
from collections.abc import Callable, Sequence
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_status(df: DataFrame, path: str, status: str = "final_status") -> None:
    """One folder a status."""
    df.write.mode("overwrite").partitionBy(status).json(path)


def write_mirrored(df: DataFrame, path: str, corpus: str = "corpus", file: str = "source_file") -> None:
    """CSV with a header, one folder for each corpus and input file."""
    df.write.mode("overwrite").partitionBy(corpus, file).option("header", "true").option("escape", '"').csv(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """CSV of documents; structs and lists as JSON."""
    plain = [F.to_json(c).alias(c) if kind.startswith(("struct", "array", "map")) else F.col(c) for c, kind in docs.dtypes]
    docs.select(*plain).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_units(units: DataFrame, path: str) -> None:
    """Nested JSON lines of units, source and date under source_meta."""
    keep = ("doc_id", "unit_id", F.col("sentence").alias("text"), "role", "prev", "next", "speakers", "targets", "proc_symbolic_flag", "event_phase", "unit_hash", "unit_dup_flag")
    units.select(*keep, F.struct(F.col("source"), F.col("date").cast("string").alias("date")).alias("source_meta")).write.mode("overwrite").json(path)


def write_requests(df: DataFrame, path: str, custom_id: Column, model: str, system: str, user: Column, temperature: float = 0.0, per_file: int = 50) -> None:
    """Request lines, ``per_file`` of them at most in a file."""
    from ..operators.prompts import request_body

    df.select(*request_body(custom_id, model, F.lit(system), user, temperature, json_object=False)).write.mode("overwrite").option("maxRecordsPerFile", per_file).json(path)


def write_pair(reference: DataFrame, requests: dict[str, DataFrame], path: str, per_file: int = 50) -> None:
    """A folder of request files for each layer, and the rows they ask about, by the same custom_id."""
    for layer, lines in requests.items():
        lines.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(f"{path}/{layer}")
    write_documents(reference, f"{path}/reference")


def write_parts(requests: DataFrame, path: str, part: str = "part") -> None:
    """One folder a numbered part, its lines in one file."""
    requests.repartition(part).write.mode("overwrite").partitionBy(part).json(path)


def append_notes(notes: DataFrame, path: str) -> None:
    notes.write.mode("append").json(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, wherever paths of the session point to."""
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _file(spark, path)
    return spark.read.text(path, wholetext=True).first()["value"] if fs.exists(p) else None


def plain(value: Any) -> Any:
    """Rows, numbers and dates as what JSON knows."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        return value.item()
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def write_stats(spark: SparkSession, path: str, stats: dict[str, Any]) -> None:
    """Statistics as JSON; a frame among them, a small aggregate, becomes the list of its rows."""
    made = {k: [plain(r) for r in v.collect()] if isinstance(v, DataFrame) else plain(v) for k, v in stats.items()}
    write_text(spark, path, json.dumps(made, ensure_ascii=False, indent=2))


def merge_report(spark: SparkSession, path: str, section: str, content: dict[str, Any]) -> dict[str, Any]:
    """A JSON report with one section put in; a broken one starts anew."""
    try:
        report = json.loads(read_text(spark, path) or "{}")
    except json.JSONDecodeError:
        report = {}
    report[section] = plain(content)
    write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=2))
    return report


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small frame as a table; what is beyond ``most`` rows is counted under it."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]]
    return "\n".join(lines) + ("\n\n(more rows follow)" if len(rows) > most else "")


def write_report(spark: SparkSession, path: str, title: str, sections: Sequence[tuple[str, DataFrame | str | None]]) -> None:
    """Markdown: a heading a section, with its table or text, or a note that there is nothing."""
    parts = [f"# {title}"]
    for name, content in sections:
        parts += [f"## {name}", markdown_table(content) if isinstance(content, DataFrame) else content or "(nothing to show)"]
    write_text(spark, path, "\n\n".join(parts) + "\n")


def manifest(spark: SparkSession, inputs: Sequence[str], parameters: dict[str, Any], commit: str | None = None) -> dict[str, Any]:
    """What a run was made from: SHA-256 and size of its input files, parameters, versions. Files are
    hashed where they are read; one row a file comes back."""
    files = [r.asDict() for p in inputs for r in spark.read.format("binaryFile").load(p).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").collect()]
    return {"files": files, "parameters": plain(parameters), "python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "git_commit": commit}


def histogram(df: DataFrame, value: Column, high: float, bins: int) -> DataFrame:
    """(bin, low, n) of values cut off at ``high``, in equal bins from 0."""
    width = high / bins
    place = F.least(F.floor(F.least(value.cast("double"), F.lit(float(high))) / width), F.lit(bins - 1))
    return df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width).alias("low"), "n")


def save_chart(kind: str, series: DataFrame, x: str, y: str, by: str | None, path: str) -> bool:
    """A PNG of a small series as bars, stacked bars, lines or a heat map; False where matplotlib is absent."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return False
    wide = series.toPandas()
    wide = wide.pivot(index=x, columns=by, values=y).fillna(0) if by else wide.set_index(x)[[y]]
    fig, ax = plt.subplots(figsize=(8, 4.5))
    if kind == "heat":
        fig.colorbar(ax.imshow(wide.values.astype(float), cmap="YlOrRd"), ax=ax)
        ax.set_xticks(range(len(wide.columns)), wide.columns, rotation=45, ha="right")
        ax.set_yticks(range(len(wide.index)), wide.index)
    else:
        wide.sort_index().plot(ax=ax, kind="line" if kind == "lines" else "bar", stacked=kind == "stacked") if kind != "lines" else wide.sort_index().plot(ax=ax)
    fig.tight_layout()
    fig.savefig(path, dpi=200)
    plt.close(fig)
    return True


class BatchClient(Protocol):
    """A service that takes request files and works on them later."""

    def create(self, part: str) -> str: ...

    def status(self, batch: str) -> tuple[str, str]:
        """(status, what went wrong)."""
        ...


ACTIVE, RUNNING = ("validating", "in_progress", "finalizing"), ("in_progress", "finalizing", "completed")


def submit_parts(client: BatchClient, parts: Sequence[str], running: Sequence[str] = (), most: int = 3, wait: Callable[[float], None] = time.sleep, check_for: float = 180, on_cap: float = 600, on_rate: float = 300, poll: float = 120) -> dict[str, str]:
    """part -> batch of parts handed in one after the other, ``most`` of them at work at a time.

    A new batch is watched until it works, or for check_for seconds. One that fails for want of room
    in the queue is handed in again after on_cap seconds, a call that is refused for its rate after
    on_rate; any other failure ends the run with what was handed in so far.
    """
    active, done = list(running), {}
    for part in parts:
        while True:
            while len(active := [b for b in active if _active(client, b)]) >= most:
                wait(poll)
            try:
                batch = client.create(part)
            except Exception as e:  # the service's own errors, known by their text alone
                if "rate" not in str(e).lower():
                    return done
                wait(on_rate)
                continue
            state = _watch(client, batch, wait, check_for)
            if state == "full":
                wait(on_cap)
                continue
            if state == "failed":
                return done
            done[part] = batch
            active.append(batch)
            break
    return done


def _active(client: BatchClient, batch: str) -> bool:
    try:
        return client.status(batch)[0] in ACTIVE
    except Exception:  # unknown: it may still be at work
        return True


def _watch(client: BatchClient, batch: str, wait: Callable[[float], None], upto: float, step: float = 5) -> str:
    for _ in range(int(upto // step)):
        status, why = client.status(batch)
        if status == "failed":
            return "full" if "enqueued" in why.lower() and ("limit" in why.lower() or "token" in why.lower()) else "failed"
        if status in ("cancelled", "expired"):
            return "failed"
        if status in RUNNING:
            return "working"
        wait(step)
    return "working"


def remaining_parts(parts: DataFrame, existing: DataFrame, part: str = "part", status: str = "status", gone: Sequence[str] = ("failed", "expired", "cancelled")) -> DataFrame:
    """Parts that no batch has, or only batches that came to nothing."""
    return parts.join(existing.where(~F.col(status).isin(*gone)).select(part), part, "left_anti")
