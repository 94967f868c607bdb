"""Rule packs, known-good files and settings from YAML, and the built-in packs."""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from artscan.operators.rules import CONDITION, Packs, Pattern, Rule
from artscan.schemas import SEVERITIES


def _rule(pack: str, rule_id: str, family: str, severity: str, description: str, condition: str, *patterns: tuple[str, str]) -> Rule:
    return Rule(pack, rule_id, family, severity, description, tuple(Pattern(k, v) for k, v in patterns), condition)


# The patterns of known families and of general suspicion.
_F, _S = "minecraft_families", "suspicious_indicators"
BUILT_IN = (
    _rule(_F, "weedhack_loaderclient", "weedhack", "CRITICAL", "Multi-stage loader with in-memory class loading and on-chain C2 fallback", "count() >= 2", ("literal", "StagingHelper"), ("literal", "me/mclauncher"), ("hex", "ce6d41de")),
    _rule(_F, "fractureiser_stage0", "fractureiser", "CRITICAL", "Fractureiser Stage 0 bytecode injector with byte-array string hiding", "count() >= 2", ("regex", r"new\s+String\s*\(\s*new\s+byte\s*\["), ("literal", "java.net.URLClassLoader"), ("regex", r"85\.217\.144\.130")),
    _rule(_F, "silentnet_handshake", "silentnet", "CRITICAL", "Handshake DNS resolution with encrypted C2", "count() >= 2", ("literal", "cloudflare-dns.com/dns-query"), ("literal", "1.1.1.1/dns-query"), ("regex", "shard/prefireMc")),
    _rule(_F, "pussylib_token_theft", "pussylib", "CRITICAL", "Session token theft via reflection", "count() >= 2", ("literal", "pussylib/pussygo"), ("literal", "getSession"), ("literal", "getAccessToken")),
    _rule(_F, "krypton_loader_stub", "krypton", "HIGH", "Obfuscated Fabric stub with URLClassLoader and UTF-16BE encoding", "count() >= 2", ("literal", "URLClassLoader"), ("literal", "UTF-16BE"), ("regex", "Error in hash")),
    _rule(_F, "makslibraries_mcmod", "makslibraries", "HIGH", "Forge mod with makslibraries mod ID", "any", ("literal", "makslibraries"), ("literal", "mcmod.info")),
    _rule(_S, "session_token_exfil", "credential_theft", "CRITICAL", "Minecraft session token exfiltration pattern", "count() >= 2", ("literal", "getAccessToken"), ("literal", "HttpURLConnection"), ("literal", "webhook")),
    _rule(_S, "discord_webhook_exfil", "credential_theft", "CRITICAL", "Discord token exfiltration via webhook", "count() >= 2", ("regex", r"discord\.com/api/webhooks/"), ("literal", "getToken"), ("literal", "discord_token")),
    _rule(_S, "native_payload_staging", "native_staging", "CRITICAL", "Native DLL staging via JNIC", "count() >= 3", ("literal", "System.load"), ("literal", "createTempFile"), ("literal", "deleteOnExit"), ("literal", ".dll")),
    _rule(_S, "onchain_c2_resolver", "onchain_c2", "CRITICAL", "Ethereum blockchain C2 resolution", "count() >= 2", ("hex", "ce6d41de"), ("literal", "eth_call"), ("literal", "verify")),
    _rule(_S, "in_memory_classloader", "dynamic_loading", "HIGH", "In-memory class loading without disk artifacts", "count() >= 2", ("literal", "defineClass"), ("literal", "URLClassLoader"), ("regex", "JarInputStream")),
    _rule(_S, "obfuscated_string_cipher", "obfuscation", "HIGH", "Custom string cipher with S-box and XOR", "count() >= 2", ("regex", r"new\s+String\s*\(\s*new\s+byte"), ("literal", "Helper.load"), ("literal", "decode")),
)


def _yaml(path: str | Path):
    try:
        return yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError, UnicodeDecodeError):
        return None


def load_pack(packs: Packs, path: str | Path) -> Packs:
    """Adds a pack; an unreadable file adds nothing, a rule with an unknown condition is left out."""
    data = _yaml(path)
    if not isinstance(data, dict):
        return packs
    pack_id, rules = data.get("pack_id", Path(path).stem), []
    for r in data.get("rules") or []:
        condition = r.get("condition") or ""
        if condition and not CONDITION.match(condition):
            continue
        severity = str(r.get("severity", "medium")).upper()
        patterns = tuple(Pattern(str(s.get("kind", "literal")), str(s.get("value", ""))) for s in r.get("strings") or [])
        rules.append(Rule(pack_id, r.get("id", ""), r.get("family", ""), severity if severity in SEVERITIES else "MEDIUM", r.get("description", ""), patterns, condition))
    if rules:
        packs.rules[pack_id] = rules
    return packs


def load_packs(user_dir: str | Path | None = None) -> Packs:
    """Built-in packs, then those of a folder in order of name; a later pack replaces one of its id."""
    packs = Packs()
    for r in BUILT_IN:
        packs.rules.setdefault(r.pack_id, []).append(r)
    for path in sorted(Path(user_dir).glob("*.y*ml")) if user_dir and Path(user_dir).is_dir() else []:
        load_pack(packs, path)
    return packs


def pack_yaml(pack_id: str, rules: list[Rule], description: str = "", **more) -> str:
    """A pack as YAML that ``load_pack`` reads back."""
    out = [{"id": r.rule_id, "family": r.family, "severity": r.severity.lower(), "description": r.description, "strings": [asdict(p) for p in r.patterns], "condition": r.condition} for r in rules]
    return yaml.safe_dump({"pack_id": pack_id, "description": description, "rules": out} | more, sort_keys=False, allow_unicode=True)


def write_proposal(proposal: DataFrame, samples: DataFrame, path: str | Path, generated_at: str, version: str = "1") -> None:
    """A proposed rule with what it rests on, for a person to review; ``samples`` (sample_hash) are written in order as a stream."""
    from artscan.operators.rulegen import as_rule

    row = proposal.first()
    rule = as_rule(row)
    about = {"status": "proposed", "generated_at": generated_at, "generator_version": version, "notes": row["notes"]}
    text = pack_yaml(f"{rule.family}_proposed", [rule], f"Auto-generated proposal for family '{rule.family}' — requires human review before use.", proposal_metadata=about)
    with Path(path).open("w", encoding="utf-8") as out:
        out.write(text + "  source_samples:" + ("\n" if row["n_samples"] else " []\n"))
        for r in samples.orderBy("sample_hash").toLocalIterator():
            out.write(f"  - {json.dumps(r['sample_hash'])}\n")


def newer(found: str, held: str) -> bool:
    """Whether a pack's version replaces the one held; versions compare as text."""
    return not held or found > held


KNOWN_GOOD = "sha256 string, mod_id string, name string, version string, loader string, source string"


def load_known_good(spark: SparkSession, path: str | Path) -> DataFrame:
    """Known-good files as a dimension table, empty on any error."""
    data = _yaml(path)
    entries = data.get("entries") if isinstance(data, dict) else None
    names = [c.split()[0] for c in KNOWN_GOOD.split(", ")]
    rows = {e["sha256"]: tuple(str(e.get(n, "")) for n in names) for e in entries or [] if isinstance(e, dict) and e.get("sha256")} if isinstance(entries, list) else {}
    return spark.createDataFrame(list(rows.values()), KNOWN_GOOD)


@dataclass
class Settings:
    custom_roots: list[str] = field(default_factory=list)
    max_workers: int = 4
    quarantine_suspicious: bool = False
    quarantine_malicious: bool = True
    scan_archives: bool = True
    scan_scripts: bool = True
    scan_configs: bool = True
    max_recursion_depth: int = 50
    whitelisted_hashes: list[str] = field(default_factory=list)
    excluded_paths: list[str] = field(default_factory=list)
    disabled_rules: list[str] = field(default_factory=list)
    quarantine_dir: str = "~/.artscan/quarantine"
    history_max_entries: int = 50
    date_format: str = "YYYY-MM-DD"
    time_format: str = "24h"

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Known keys of a file; defaults for the rest, for any error, and (written out) for no file."""
        path = Path(path)
        if not path.exists():
            out = cls()
            try:
                out.save(path)
            except OSError:
                pass
            return out
        data = _yaml(path)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known}) if isinstance(data, dict) else cls()

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False))
