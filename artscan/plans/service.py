"""Scans by name over allowed folders: run one, replay its events, look at findings, test rules.

A job is one scan that runs in the caller's thread; who wants several at once
starts them from threads and scheduler pools of their own.  Its findings and
verdicts are tables in the shared folder, and its events a view of them, so a
job's size never weighs on the driver.
"""
from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.operators import findings as views
from artscan.operators.rules import Packs, scan as rule_scan
from artscan.plans.scan import scan
from artscan.schemas import severity_name
from artscan.session import keep
from artscan.sinks import reports, stores
from artscan.sources import archive, files

PENDING, COMPLETED, FAILED = "PENDING", "COMPLETED", "FAILED"
MAX_RUNNING, MAX_EVENTS, MAX_FINISHED = 2, 500, 50
#: Levels of nesting that a job follows; the command line follows fewer.
MAX_DEPTH = 50


class Busy(Exception):
    """As many jobs run as may."""


class Forbidden(Exception):
    """A path outside the allowed roots."""


@dataclass
class Job:
    job_id: str
    roots: list[str]
    status: str = PENDING
    error: str | None = None
    started_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    completed_at: str | None = None
    findings: DataFrame | None = None
    verdicts: DataFrame | None = None

    @property
    def events(self) -> list[dict]:
        """Events for replay: the last of ``MAX_EVENTS`` verdicts at most, by path, then how the job ended."""
        out = []
        if self.verdicts is not None:
            total = self.verdicts.count()
            last = self.verdicts.orderBy(F.desc("artifact_id")).limit(MAX_EVENTS).collect()[::-1]
            out = [{"type": "verdict", "path": r["artifact_id"], "verdict": r["verdict"], "confidence": r["confidence"], "progress": n / total} for n, r in enumerate(last, total - len(last) + 1)]
        if self.status != PENDING:
            out += [{"type": "status", "status": self.status, "error": self.error}, {"type": "done"}]
        return out[-MAX_EVENTS:]


def allowed(path: str | Path, roots: list[str]) -> bool:
    """Whether a path is one of the roots or lies below one."""
    path = Path(path).resolve()
    return any(path == Path(r).resolve() or Path(r).resolve() in path.parents for r in roots)


class Service:
    def __init__(self, spark: SparkSession, packs: Packs, roots: list[str], history: stores.History | None = None, good: DataFrame | None = None):
        self.spark, self.packs, self.roots, self.history, self.good = spark, packs, roots, history, good
        self.jobs: dict[str, Job] = {}
        self.dismissed: set[str] = set()
        self.lock = threading.Lock()

    def start(self, roots: list[str]) -> Job:
        """Runs one scan to its end, unless as many run as may."""
        if not all(allowed(r, self.roots) for r in roots):
            raise Forbidden(roots)
        with self.lock:
            if sum(j.status == PENDING for j in self.jobs.values()) >= MAX_RUNNING:
                raise Busy
            job = Job(str(uuid.uuid4()), roots)
            self.jobs[job.job_id] = job
        self._run(job)
        return job

    def _run(self, job: Job) -> None:
        try:
            result = scan(files.read(self.spark, job.roots), self.packs.all(), good=self.good, max_depth=MAX_DEPTH)
            job.findings, job.verdicts = keep(result.findings), result.verdicts
            job.completed_at = datetime.now(UTC).isoformat()
            if self.history:
                self.history.record_scan(job.findings, job.verdicts, job.roots, job.job_id)
            job.status = COMPLETED
        except Exception as error:  # noqa: BLE001 - the job fails, others go on
            job.status, job.error, job.completed_at = FAILED, f"{type(error).__name__}: {error}", datetime.now(UTC).isoformat()
        self._forget()

    def _forget(self) -> None:
        with self.lock:
            done = sorted((j for j in self.jobs.values() if j.status != PENDING), key=lambda j: j.completed_at or j.started_at)
            for j in done[:-MAX_FINISHED]:
                self.jobs.pop(j.job_id)
                self.dismissed.discard(j.job_id)

    def follow(self, job_id: str) -> Iterator[dict]:
        """A job's events."""
        yield from self.jobs[job_id].events

    def findings(self, severity: str | None = None) -> DataFrame | None:
        """By path the findings of the last job that saw it, of files that exist and jobs not dismissed."""
        parts = [
            j.verdicts.join(reports.files(j.findings, j.verdicts).select(F.col("file_path").alias("artifact_id"), "findings"), "artifact_id").select(
                F.col("artifact_id").alias("path"), "sha256", "verdict", "confidence", "findings", F.lit(j.completed_at).alias("finished_at"), F.lit(j.job_id).alias("job_id")
            )
            for j in list(self.jobs.values())
            if j.status == COMPLETED and j.job_id not in self.dismissed
        ]
        if not parts:
            return None
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        there = self.spark.createDataFrame([(p,) for r in self.roots for p in files.walk(r)], "path string")
        seen = views.current(both, self.spark.createDataFrame([], "job_id string"), there).filter(F.size("findings") > 0)
        return seen.filter(F.exists("findings", lambda f: f["severity"] == severity.upper())) if severity else seen

    def finding(self, key: str) -> dict | None:
        """By hash, else by the end of the path."""
        seen = self.findings()
        row = views.lookup(seen, key).first() if seen is not None else None
        return row.asDict(recursive=True) if row else None

    def dismiss(self) -> None:
        self.dismissed.update(self.jobs)

    def rules(self) -> list[dict]:
        return [{"pack_id": k, "rule_count": len(v), "rules": [{"id": r.rule_id, "family": r.family, "severity": r.severity, "description": r.description} for r in v]} for k, v in self.packs.rules.items()]

    def test_rules(self, path: str, rule_id: str | None = None) -> list[dict]:
        """Matches of one archive; ``rule_id`` picks the packs that hold such a rule."""
        if not allowed(path, self.roots):
            raise Forbidden(path)
        chosen = [r for rules in self.packs.rules.values() if not rule_id or rule_id in {x.rule_id for x in rules} for r in rules]
        rows = archive.explode(files.read(self.spark, [path])).filter("kind = 'entry' AND level = 0")
        found = rule_scan(rows, chosen).select(F.split_part("detector_id", F.lit(":"), F.lit(3)).alias("rule_id"), severity_name(F.col("severity")).alias("severity"), "description", "matched_value")
        return [r.asDict() for r in found.orderBy("rule_id").collect()]
