"""Command line: scan folders, or propose a rule from samples."""
from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from artscan.operators import rulegen
from artscan.plans.scan import sample_features, scan
from artscan.session import drop_kept, keep, local_session, prepare
from artscan.sinks import documents, reports, stores
from artscan.sources import files, packs


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="artscan", description=__doc__)
    p.add_argument("--home", default=str(Path.home() / ".artscan"))
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="*")
    s.add_argument("--auto-discover", action="store_true")
    s.add_argument("--report", help="ending in .json, .sarif or .html")
    s.add_argument("--rule-pack", action="append", default=[])
    s.add_argument("--quarantine", action=argparse.BooleanOptionalAction, default=None)
    s.add_argument("--fail-on", choices=("malicious", "suspicious"))
    r = sub.add_parser("rulegen")
    r.add_argument("samples")
    r.add_argument("--family", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--min-sample-fraction", type=float, default=0.6)
    r.add_argument("--severity", default="MEDIUM")
    r.add_argument("--condition", default="count() >= 2")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    home = Path(a.home)
    settings = packs.Settings.load(home / "config.yaml")
    spark = prepare(local_session())
    if a.command == "rulegen":
        result = scan(files.read(spark, [a.samples], scripts=False, configs=False), packs.load_packs().all())
        ev, rebuilt = sample_features(result)
        found = keep(rulegen.candidates(ev, rebuilt))
        kept = keep(rulegen.generalize(found, a.min_sample_fraction, result.verdicts.count()))
        proposal = rulegen.propose(kept, found, a.family, None, a.severity.upper(), a.condition)
        packs.write_proposal(proposal, rulegen.sources(found, kept), a.output, datetime.now(UTC).isoformat())
        drop_kept(found, kept)
        return 0
    loaded = packs.load_packs(home / "rules")
    for path in a.rule_pack:
        packs.load_pack(loaded, path)
    roots = a.paths or (files.discover_roots(tuple(settings.custom_roots)) if a.auto_discover else settings.custom_roots)
    good = packs.load_known_good(spark, home / "known_good.yaml").select("sha256")
    if settings.whitelisted_hashes:
        good = good.union(spark.createDataFrame([(h,) for h in settings.whitelisted_hashes], "sha256 string"))
    found = files.read(spark, roots, archives=settings.scan_archives, scripts=settings.scan_scripts, configs=settings.scan_configs, scanDirs=not a.paths, excluded=settings.excluded_paths)
    result = scan(found, loaded.all(), tuple(settings.excluded_paths), good)
    audit = stores.AuditLog(home / "audit.log")
    audit.log_verdicts(result.verdicts.toLocalIterator())
    malicious = settings.quarantine_malicious if a.quarantine is None else a.quarantine
    moved = stores.Quarantine(Path(settings.quarantine_dir).expanduser(), malicious, settings.quarantine_suspicious).apply(result.verdicts, audit)
    findings = keep(result.findings)
    head = stores.History(home / "history", settings.history_max_entries).record_scan(findings, result.verdicts, roots)
    for line in documents.console(findings, result.verdicts, head, [p for p, o in moved.items() if o == stores.FAILED], date_format=settings.date_format, time_format=settings.time_format):
        print(line)
    if a.report:
        form = Path(a.report).suffix
        documents.save(form if form in documents.FORMS else ".json", findings, result.verdicts, head, a.report)
    return reports.exit_code(result.verdicts, a.fail_on)


if __name__ == "__main__":
    sys.exit(main())
