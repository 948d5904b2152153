"""Restartable linkage by whole-organization batches, with a ledger.

One Spark job over the whole panel needs none of this: tasks are retried and skew is split at run time.  Batches serve
those who want to stop and resume between parts of a very large panel.
"""

from __future__ import annotations

import csv
import io
import json
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panellink.functions.normalize import pick
from panellink.operators.profile import build_person_profile
from panellink.plans.link import STAMPS, link_panel
from panellink.sources.panel import PanelCols, read_panel

FIELDS = ("time", "step", "batch", "event", "pid", "detail")


class _Store:
    """Folders of a batch run on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{p}"))

    def names(self, p: str) -> list[str]:
        at = self._path(f"{self.root}/{p}" if p else self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read_text(self, p: str) -> str:
        if not self.exists(p):
            return ""
        stream = self.fs.open(self._path(f"{self.root}/{p}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, p: str, text: str) -> None:
        """Write a small file beside its place and rename it there."""
        new, place = self._path(f"{self.root}/{p}.new"), self._path(f"{self.root}/{p}")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.delete(place, False)
        if not self.fs.rename(new, place):
            raise OSError(f"could not rename {new}")


def list_batches(spark: SparkSession, root: str, prefix: str = "batch") -> list[str]:
    """Batches under ``root`` whose folder is complete: its files' commit marker, or that of the store, is there."""
    s = _Store(spark, root)
    every = s.exists("_SUCCESS")
    return [n.split("=", 1)[1] for n in s.names("") if n.startswith(f"{prefix}=") and (every or s.exists(f"{n}/_SUCCESS"))]


def ledger_read(spark: SparkSession, out_dir: str) -> list[dict]:
    return list(csv.DictReader(io.StringIO(_Store(spark, out_dir).read_text("run-ledger.csv"))))


def ledger_append(spark: SparkSession, out_dir: str, step: str, batch: str, event: str, detail: str = "") -> None:
    store = _Store(spark, out_dir)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    text = store.read_text("run-ledger.csv")
    if not text:
        writer.writerow(FIELDS)
    writer.writerow([time.strftime("%Y-%m-%d %H:%M:%S"), step, batch, event, os.getpid(), " ".join(detail.split())])
    store.write_text("run-ledger.csv", text + out.getvalue())


def ledger_last(rows: list[dict]) -> dict[str, dict]:
    """The last entry of each batch."""
    return {r["batch"]: r for r in rows}


def _alive(pid: str) -> bool:
    return pid == str(os.getpid()) or os.path.exists(f"/proc/{pid}")


def ledger_recover(spark: SparkSession, out_dir: str) -> list[str]:
    """Mark batches that were started by a process that is gone as interrupted."""
    hung = [r for r in ledger_last(ledger_read(spark, out_dir)).values() if r["event"] == "started" and not _alive(r["pid"])]
    for r in hung:
        ledger_append(spark, out_dir, r["step"], r["batch"], "interrupted", f"started {r['time']} and never finished")
    return [r["batch"] for r in hung]


@dataclass
class BatchRun:
    batch: str
    status: str
    records: int | None = None
    persons: int | None = None
    link_secs: float | None = None
    profile_secs: float | None = None
    error: str | None = None


def run_batch(spark: SparkSession, path: str, out_dir: str, batch: str, do_link: bool, do_profile: bool, cols: PanelCols, id_col: str, prefix: str, link_args: dict, profile_args: dict) -> BatchRun:
    """Link and profile one batch: profiles first, then the id map, whose presence marks the batch as linked, then the run record."""
    df = spark.read.parquet(path)
    if id_col not in df.columns:
        raise ValueError(f"batch {batch}: no {id_col!r} column")
    records = df.count()
    started = time.time()
    if do_link:
        linked = link_panel(df, cols, **link_args).panel
        kept = [c for c in (id_col, pick(df, cols.org_id), pick(df, cols.year), *STAMPS) if c in linked.columns]
        new = linked.select(*kept)
    else:
        ids = spark.read.parquet(f"{out_dir}/emp-map/{prefix}={batch}")
        if ids.count() != records or df.join(ids, id_col, "left_anti").limit(1).count():
            raise ValueError(f"batch {batch}: the emp-map is from other batch files")
        linked = df.join(ids.select(id_col, *[c for c in STAMPS if c in ids.columns]), id_col)
        new = None
    link_secs = time.time() - started
    persons, n = linked.agg(F.countDistinct("EMP_ID"), F.count(F.lit(1))).first()
    if n != records:
        raise ValueError(f"batch {batch}: {n} linked rows for {records} records")
    started = time.time()
    if do_profile:
        build_person_profile(linked, cols, **profile_args).write.mode("overwrite").parquet(f"{out_dir}/profiles/{prefix}={batch}")
    if new is not None:
        new.write.mode("overwrite").parquet(f"{out_dir}/emp-map/{prefix}={batch}")
    run = BatchRun(batch, "done", records, persons, link_secs, time.time() - started)
    _Store(spark, out_dir).write_text(f"runs/{prefix}={batch}.json", json.dumps({**run.__dict__, "spark": spark.version, "date": time.strftime("%Y-%m-%d %H:%M:%S")}))
    return run


def link_panel_batched(spark: SparkSession, path: str, out_dir: str, steps: tuple[str, ...] = ("link", "profile"), batches: list[str] | None = None, resume: bool = True, retry_failed: bool = True, cols: PanelCols | None = None, id_col: str = "PERSON_YEAR_ID", prefix: str = "batch", link_args: dict | None = None, profile_args: dict | None = None, workers: int = 4) -> list[BatchRun]:
    """Link the batches under ``path``, costliest first and ``workers`` at a time, and write emp-map, profiles and a ledger to ``out_dir``.

    Statuses: done, failed, complete, skipped: failed earlier, skipped: running elsewhere, skipped: no emp-map.  A failed batch
    doesn't stop the others.
    """
    cols = cols or PanelCols()
    every = list_batches(spark, path, prefix)
    batches = list(batches or every)
    missing = sorted(set(batches) - set(every))
    if not every or missing:
        raise ValueError(f"link_panel_batched: no batch files in {path} for {' '.join(missing) or prefix}")
    interrupted = ledger_recover(spark, out_dir)
    last = ledger_last(ledger_read(spark, out_dir))
    maps, profs = (set(list_batches(spark, f"{out_dir}/{d}", prefix)) for d in ("emp-map", "profiles"))
    link = {b: "link" in steps and (not resume or b not in maps) for b in batches}
    prof = {b: "profile" in steps and (not resume or b not in profs or link[b]) for b in batches}

    def status(b: str) -> str:
        event = last.get(b, {}).get("event")
        if not link[b] and not prof[b]:
            return "complete"
        if not link[b] and b not in maps:
            return "skipped: no emp-map"
        if event == "started" and b not in interrupted and last[b]["pid"] != str(os.getpid()):
            return "skipped: running elsewhere"
        return "skipped: failed earlier" if resume and not retry_failed and event == "failed" else "todo"

    out = {b: BatchRun(b, status(b)) for b in batches}
    todo = [b for b in batches if out[b].status == "todo"]
    if todo:
        # one job over the organization column alone: cost is the sum of squared records, or records if only profiles are due
        panel = read_panel(spark, path)
        per = panel.where(F.col(prefix).isin(todo)).groupBy(prefix, F.col(f"`{pick(panel, cols.org_id)}`").alias("o")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        cost = {r[0]: r[1] if link[r[0]] else r[2] for r in per.groupBy(prefix).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).collect()}
        todo.sort(key=lambda b: (-cost.get(b, 0.0), b))
    lock = threading.Lock()

    def note(*entry: str) -> None:
        with lock:
            ledger_append(spark, out_dir, *entry)

    def work(b: str) -> None:
        step = "+".join(s for s, due in (("link", link[b]), ("profile", prof[b])) if due)
        note(step, b, "started")
        try:
            out[b] = run_batch(spark, f"{path}/{prefix}={b}", out_dir, b, link[b], prof[b], cols, id_col, prefix, link_args or {}, profile_args or {})
            note(step, b, "done", f"{out[b].records} records, {out[b].persons} persons")
        except Exception as e:  # the ledger and the result say what failed; other batches go on
            out[b] = BatchRun(b, "failed", error=str(e)[:500])
            note(step, b, "failed", str(e)[:500])

    pool = ThreadPoolExecutor(max(1, workers))
    runs = {b: pool.submit(work, b) for b in todo}  # in this order: small batches run beside large ones
    try:
        for run in runs.values():
            run.result()
    except KeyboardInterrupt:
        pool.shutdown(wait=False, cancel_futures=True)
        for b, run in runs.items():
            if run.running():
                note("stop", b, "interrupted", "stopped in this session")
        raise
    pool.shutdown()
    return [out[b] for b in batches]


def batch_status(spark: SparkSession, out_dir: str, prefix: str = "batch") -> list[dict]:
    """(batch, has_map, has_profile, last ledger entry, state): done, running, interrupted, failed or not run."""
    last = ledger_last(ledger_read(spark, out_dir))
    maps, profs = (set(list_batches(spark, f"{out_dir}/{d}", prefix)) for d in ("emp-map", "profiles"))
    rows = []
    for b in sorted({*last, *maps, *profs}):
        e = last.get(b)
        state = ("done" if b in maps else "not run") if e is None else ("running" if _alive(e["pid"]) else "interrupted") if e["event"] == "started" else e["event"]
        rows.append({"batch": b, "has_map": b in maps, "has_profile": b in profs, **({k: e[k] for k in FIELDS if k != "batch"} if e else {}), "state": state})
    return rows


def read_linked(spark: SparkSession, path: str, out_dir: str, id_col: str = "PERSON_YEAR_ID") -> DataFrame:
    """The panel with the ids of all linked batches."""
    panel, ids = read_panel(spark, path), read_panel(spark, f"{out_dir}/emp-map")
    return panel.join(ids.select(id_col, *[c for c in STAMPS if c in ids.columns]), id_col)
