"""Files as rows: roots to look in, a walk, and a data source that reads what the walk finds."""
from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from artscan.schemas import ARTIFACTS

# Fixed values.
ARCHIVES = (".jar", ".zip", ".mcworld", ".mcpack")
SCRIPTS = (".js", ".ts", ".mcfunction", ".lua")
CONFIGS = (".json", ".toml", ".yml", ".yaml", ".mcmeta", ".txt")
SCAN_DIRS = ("mods", "resourcepacks", "datapacks", "shaderpacks", "kubejs", "scripts", "config", "saves")
DENIED_DIRS = ("node_modules", "__pycache__", "assets", "libraries", "logs", "crash-reports", "versions", "natives")
MAX_DEPTH = 50
CLIENT_ROOTS = {
    "HOME": (
        ".minecraft", ".local/share/PrismLauncher/instances", ".local/share/MultiMC/instances", ".local/share/ATLauncher/Packs", ".local/modrinth-app", ".config/curseforge",
        ".var/app/com.mojang.Minecraft/.minecraft", ".var/app/org.prismlauncher.PrismLauncher/PrismLauncher/instances",
        "Library/Application Support/minecraft", "Library/Application Support/PrismLauncher/instances", "Library/Application Support/MultiMC/instances", "Library/Application Support/ATLauncher/Packs",
    ),
    "APPDATA": (".minecraft",),
    "LOCALAPPDATA": ("PrismLauncher/instances", "MultiMC/instances", "ATLauncher/Packs"),
    "USERPROFILE": (".minecraft",),
}
SERVER_ROOTS = ("server", "minecraft-server", "mc-server", "paper-server", "spigot-server")
SHARED_SERVER_ROOTS = ("/opt/minecraft-server", "/opt/server")


def is_server_root(path: Path) -> bool:
    return (path / "plugins").is_dir() or ((path / "mods").is_dir() and (path / "server.properties").exists())


def _children(path: Path) -> list[Path]:
    try:
        return sorted(path.iterdir())
    except OSError:
        return []


def discover_roots(custom: tuple[str, ...] = (), env: dict[str, str] | None = None) -> list[str]:
    """Existing roots of clients and servers, and those given, each once, sorted."""
    env = dict(os.environ) if env is None else env
    found = {p for c in custom if (p := Path(os.path.expandvars(os.path.expanduser(c)))).exists()}
    for name, places in CLIENT_ROOTS.items():
        if env.get(name):
            found |= {p for x in places if (p := Path(env[name], x)).exists()}
    if env.get("LOCALAPPDATA"):
        found |= {p / "Instances" for p in _children(Path(env["LOCALAPPDATA"], "CurseForge")) if (p / "Instances").exists()}
    home = Path(env.get("HOME", ""))
    servers = [home / s for s in SERVER_ROOTS] + [Path(s) for s in SHARED_SERVER_ROOTS] + ([p for p in _children(home) if p.is_dir()] if env.get("HOME") else [])
    return sorted({str(p) for p in found} | {str(p) for p in servers if is_server_root(p)})


def discover_plugin_dirs(custom: tuple[str, ...] = (), env: dict[str, str] | None = None) -> list[str]:
    return [str(Path(r, "plugins")) for r in discover_roots(custom, env) if Path(r, "plugins").is_dir()]


def walk(root: str, kinds: tuple[str, ...] = ARCHIVES + SCRIPTS + CONFIGS, only_scan_dirs: bool = False, max_depth: int = MAX_DEPTH, own_dir: str = ".artscan") -> Iterator[str]:
    """Files of these kinds below a root, by name, without links and denied folders.

    ``only_scan_dirs`` enters a folder below the first level only if some part
    of its path is a folder of content.
    """
    top = Path(root)
    if top.is_file():
        yield from [str(top)] if top.suffix.lower() in kinds else []
        return
    stack = [(top, 0)]
    while stack:
        path, depth = stack.pop()
        if not path.is_dir() or path.is_symlink() and depth:
            if path.is_file() and not path.is_symlink() and path.suffix.lower() in kinds:
                yield str(path)
            continue
        if depth > max_depth:
            continue
        for child in reversed(sorted(_children(path), key=lambda p: p.name)):
            try:
                if child.is_symlink():
                    continue
                if child.is_dir():
                    name = child.name
                    if name.startswith(".") or name in DENIED_DIRS or name == own_dir:
                        continue
                    if depth and only_scan_dirs and not set(child.parts) & set(SCAN_DIRS):
                        continue
                stack.append((child, depth + 1))
            except OSError:
                continue


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class ArtifactReader(DataSourceReader):
    """Lists files on the driver and reads them in groups of bounded size on executors that see them."""

    def __init__(self, options: dict[str, str]):
        get = options.get
        on = lambda name: (get(name) or "true").lower() == "true"
        self.roots = [r for r in (get("roots") or get("path") or "").split(os.pathsep) if r]
        self.kinds = (ARCHIVES if on("archives") else ()) + (SCRIPTS if on("scripts") else ()) + (CONFIGS if on("configs") else ())
        self.only = (get("scandirs") or get("scanDirs") or "false").lower() == "true"
        self.excluded = [p for p in (get("excluded") or "").split(os.pathsep) if p]
        self.bytes = int(get("partitionbytes") or get("partitionBytes") or 64 << 20)

    def partitions(self):
        parts, held, size = [], [], 0
        for path in (p for root in self.roots for p in walk(root, self.kinds, self.only)):
            n = os.path.getsize(path)
            if held and size + n > self.bytes:
                parts.append(_Part(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, *([_Part(held)] if held else [])] or [_Part([])]

    def read(self, partition):
        for path in partition.paths:
            skip = any(fnmatch.fnmatch(path, p) or fnmatch.fnmatch(os.path.basename(path), p) for p in self.excluded)
            try:
                data = b"" if skip else Path(path).read_bytes()  # excluded files are listed but never read
            except OSError:
                data = None
            row = pa.table({"artifact_id": [path], "path": [path], "length": [os.path.getsize(path)], "content": pa.array([data], pa.binary())})
            yield from row.to_batches()


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> str:
        return ARTIFACTS

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options)


def read(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """Artifacts below local or mounted roots; stores of objects are read with ``binaryFile``."""
    spark.dataSource.register(ArtifactSource)
    given = {k: str(v).lower() if isinstance(v, bool) else os.pathsep.join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items()}
    return spark.read.format("artifact").options(roots=os.pathsep.join(roots), **given).load()


def from_store(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of any store that Spark reads; the modification time stays out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("path AS artifact_id", "path", "length", "content")
