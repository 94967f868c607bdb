"""What a scan leaves behind on the driver: audit log, history, quarantine.

These are actions on files, taken once after the verdicts, never inside a
transformation, where a repeated task would repeat them.
"""
from __future__ import annotations

import json
import re
import shutil
import threading
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from artscan.sinks import reports

VERSION = "1"
SHA256 = re.compile(r"[a-f0-9]{64}\Z")
SUCCESS, ALREADY, MISSING, FAILED = "success", "already_quarantined", "source_missing", "failed"
_LOCK = threading.Lock()


def _now() -> str:
    return datetime.now(UTC).isoformat()


class AuditLog:
    """JSON lines, readable by the owner only; writing never fails a scan."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def log(self, event_type: str, **more) -> None:
        line = json.dumps({"timestamp": _now(), "scanner_version": VERSION, "event_type": event_type} | more, default=str)
        try:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            new = not self.path.exists()
            with _LOCK, self.path.open("a") as f:
                f.write(line + "\n")
            if new:
                self.path.chmod(0o600)
        except OSError:
            pass

    def log_verdicts(self, rows: Iterable) -> None:
        for r in rows:
            self.log("scan_verdict", file_path=r["artifact_id"], sha256=r["sha256"], verdict=r["verdict"], confidence=r["confidence"])

    def read(self, limit: int = 100) -> list[dict]:
        """The last lines that are JSON objects."""
        try:
            lines = self.path.read_text().splitlines()
        except OSError:
            return []
        out = []
        for line in lines:
            try:
                value = json.loads(line)
            except ValueError:
                continue
            out += [value] if isinstance(value, dict) else []
        return out[-limit:]

    def table(self, spark: SparkSession, limit: int = 100) -> DataFrame:
        """The same for logs of any size: a top-k by time."""
        return spark.read.schema("timestamp string, scanner_version string, event_type string, file_path string, sha256 string, verdict string, confidence double, outcome string").option("mode", "DROPMALFORMED").json(str(self.path)).orderBy(F.desc("timestamp")).limit(limit)


class History:
    """An index of scans with a report each, the newest kept.

    ``record_scan`` has Spark write the file reports to a table and keeps only
    the summary and its path; ``record`` keeps a small report as a file.
    """

    def __init__(self, folder: str | Path, most: int = 50):
        self.folder, self.most = Path(folder), most
        self.index = self.folder / "index.json"

    def record_scan(self, findings: DataFrame, verdicts: DataFrame, roots: list[str], scan_id: str | None = None) -> dict:
        """The report's header and summary; its files lie in ``spark.checkpoint.dir``, or beside the index where that is unset."""
        head = reports.summarised(verdicts, roots, scan_id)
        top = findings.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{self.folder.resolve()}/reports"
        path = f"{top.rstrip('/')}/history-{head['scan_id']}"
        reports.write_lines(findings, verdicts, path)
        self._add(head, files=path)
        return head

    def files(self, spark: SparkSession, scan_id: str) -> DataFrame | None:
        """The file reports of a scan that ``record_scan`` kept."""
        path = next((e["files"] for e in self._read() if e.get("scan_id") == scan_id and e.get("files")), None)
        return spark.read.schema(reports.FILES).json(path) if path else None

    def _report(self, scan_id: str) -> Path:
        return self.folder / "reports" / f"{scan_id}.json"

    def _read(self) -> list[dict]:
        try:
            data = json.loads(self.index.read_text())
        except (OSError, ValueError):
            return []
        return [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []

    def _write(self, entries: list[dict]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self.index.write_text(json.dumps(entries, indent=2))

    def record(self, report: dict) -> None:
        path = self._report(report["scan_id"])
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(report, indent=2))
        self._add(report)

    def _add(self, report: dict, **more) -> None:
        entry = {"scan_id": report["scan_id"], "timestamp": report["timestamp"], "roots": report["scanned_roots"], "summary": report["summary"]} | more
        entries = sorted([e for e in self._read() if e.get("scan_id") != report["scan_id"]] + [entry], key=lambda e: e["timestamp"])
        for old in entries[: -self.most]:
            self._drop(old)
        self._write(entries[-self.most :])

    def _drop(self, entry: dict) -> None:
        self._report(entry["scan_id"]).unlink(missing_ok=True)
        spark = SparkSession.getActiveSession()
        if entry.get("files") and spark:
            path = spark._jvm.org.apache.hadoop.fs.Path(entry["files"])
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def list(self) -> list[dict]:
        return sorted(self._read(), key=lambda e: e.get("timestamp", ""), reverse=True)

    def get(self, scan_id: str) -> dict | None:
        try:
            return json.loads(self._report(scan_id).read_text())
        except (OSError, ValueError):
            return next((e for e in self._read() if e.get("scan_id") == scan_id and e.get("files")), None)

    def delete(self, scan_id: str) -> bool:
        entries = self._read()
        left = [e for e in entries if e.get("scan_id") != scan_id]
        if len(left) == len(entries):
            return False
        self._write(left)
        self._drop(next(e for e in entries if e.get("scan_id") == scan_id))
        return True

    def purge(self) -> int:
        entries = self._read()
        for e in entries:
            self._drop(e)
        self._write([])
        return len(entries)


class Quarantine:
    """Moves files away under their hash; each step can be undone until the original goes."""

    def __init__(self, folder: str | Path, malicious: bool = True, suspicious: bool = False):
        self.folder = Path(folder)
        self.wanted = {v for v, on in (("MALICIOUS", malicious), ("SUSPICIOUS", suspicious)) if on}

    def apply(self, verdicts: DataFrame, audit: AuditLog | None = None) -> dict[str, str]:
        """Outcome by path for the verdicts that call for it."""
        out = {}
        for r in verdicts.filter(F.col("verdict").isin(*self.wanted) if self.wanted else F.lit(False)).toLocalIterator():
            out[r["artifact_id"]] = self.put(r["artifact_id"], r["sha256"], r["verdict"], r["confidence"])
            if audit:
                audit.log("quarantine", file_path=r["artifact_id"], sha256=r["sha256"], outcome=out[r["artifact_id"]])
        return out

    def put(self, path: str | Path, sha256: str, verdict: str, confidence: float, findings: list | None = None) -> str:
        path = Path(path)
        if not path.exists() or not sha256:
            return MISSING
        place = self.folder / sha256
        manifest, copy, note = place / "manifest.json", place / path.name, path.with_name(path.name + ".quarantined")
        if manifest.exists():
            return ALREADY
        try:
            place.mkdir(parents=True, exist_ok=True)
            shutil.copy2(path, copy)
            manifest.write_text(json.dumps({"original_path": str(path), "sha256": sha256, "quarantined_path": str(copy), "verdict": verdict, "confidence": confidence, "findings": findings or [], "timestamp": _now(), "restored": False}, indent=2))
            note.write_text(f"This file has been quarantined.\nOriginal: {path}\nSHA-256: {sha256}\nQuarantine: {copy}\nDate: {_now()}\n")
            path.unlink()
            return SUCCESS
        except OSError:
            for p in (note, manifest, copy):
                try:
                    p.unlink(missing_ok=True)
                except OSError:
                    pass
            return FAILED

    def _manifest(self, place: Path) -> dict | None:
        try:
            return json.loads((place / "manifest.json").read_text())
        except (OSError, ValueError):
            return None

    def list(self) -> list[dict]:
        found = [(p, self._manifest(p)) for p in sorted(self.folder.iterdir()) if p.is_dir()] if self.folder.exists() else []
        return [m for p, m in found if m and not m.get("restored") and (p / Path(m["quarantined_path"]).name).exists()]

    def restore(self, sha256: str) -> bool:
        """Puts a file back unless something else stands in its place."""
        place = self.folder / sha256
        m = self._manifest(place) if SHA256.match(sha256) else None
        if not m:
            return False
        source, target = place / Path(m["quarantined_path"]).name, Path(m["original_path"])
        if not source.exists() or target.exists():
            return False
        try:
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.move(str(source), str(target))
            target.with_name(target.name + ".quarantined").unlink(missing_ok=True)
            shutil.rmtree(place, ignore_errors=True)
            return True
        except OSError:
            return False

    def delete(self, sha256: str) -> bool:
        sha256 = sha256.strip().lower()
        place = self.folder / sha256
        if not SHA256.match(sha256) or not place.exists():
            return False
        m = self._manifest(place)
        if m:
            target = Path(m["original_path"])
            target.with_name(target.name + ".quarantined").unlink(missing_ok=True)
        shutil.rmtree(place, ignore_errors=True)
        return not place.exists()

    def purge(self) -> int:
        return sum(self.delete(p.name) for p in (list(self.folder.iterdir()) if self.folder.exists() else []) if p.is_dir())
