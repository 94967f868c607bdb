"""Archives as rows of entries, nested archives included.

One call handles one archive, because its size budget runs through all nested
levels in order.  Rows: ``entry`` with bytes, ``skip`` with a reason, ``broken``
for a nested archive that can't be read, ``error`` for the archive itself.
"""
from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_ENTRY = 100 * 1024 * 1024
MAX_RATIO = 100
MAX_TOTAL = 500 * 1024 * 1024
MAX_DEPTH = 6
#: Characters of the entry before that patterns may reach back to.
TAIL = 256
ZIP_MAGIC = b"PK\x03\x04"
CLASS_MAGIC = b"\xca\xfe\xba\xbe"
ROWS = (
    "artifact_id string, kind string, level int, level_path string, depth int, ordinal int, name string, data binary,"
    " size long, compressed_size long, offset long, reason string, nested boolean, tail string"
)


class Budget:
    def __init__(self, limit: int = MAX_TOTAL):
        self.left = limit

    def take(self, size: int) -> bool:
        if size > self.left:
            return False
        self.left -= size
        return True


def refusal(info: zipfile.ZipInfo, budget: Budget) -> str | None:
    """Why an entry is not read, None if it is."""
    if ".." in info.filename or info.filename.startswith("/"):
        return "path_traversal"
    if info.file_size > MAX_ENTRY:
        return "entry_too_large"
    if info.compress_size > 0 and info.file_size / info.compress_size > MAX_RATIO:
        return "compression_ratio"
    return None if budget.take(info.file_size) else "total_budget_exceeded"


class Walk:
    """All rows of one archive; levels are numbered in order of appearance."""

    def __init__(self, name: str, content: bytes, max_depth: int = MAX_DEPTH):
        self.name, self.content, self.max_depth = name, content, max_depth
        self.budget, self.levels, self.ordinal = Budget(), 0, 0

    def rows(self) -> Iterator[dict]:
        try:
            yield from self._level(self.name, self.content, 0)
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, EOFError):
            yield self._row("error", 0, self.name, 0, "")

    def _row(self, kind: str, level: int, path: str, depth: int, name: str, **more) -> dict:
        self.ordinal += 1
        return {"kind": kind, "level": level, "level_path": path, "depth": depth, "ordinal": self.ordinal, "name": name} | more

    def _level(self, path: str, content: bytes, depth: int) -> Iterator[dict]:
        level, self.levels = self.levels, self.levels + 1
        tail = ""
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                why = refusal(info, self.budget)
                data = b""
                if why is None:
                    try:
                        data = z.read(info.filename)  # by name: of two entries of a name the later one
                        why = "entry_too_large" if len(data) > MAX_ENTRY else None
                    except (zipfile.BadZipFile, RuntimeError, OSError, zlib.error, EOFError):
                        why = "read_error"
                if why:
                    yield self._row("skip", level, path, depth, info.filename, reason=why)
                    continue
                nested = data[:4] == ZIP_MAGIC and depth < self.max_depth
                yield self._row("entry", level, path, depth, info.filename, data=data, size=info.file_size, compressed_size=info.compress_size, offset=info.header_offset, nested=nested, tail=tail)
                tail = data[-4 * TAIL - 4 :].decode("utf-8", "replace")[-TAIL:]
                if nested:
                    inner = f"{path}!/{info.filename}"
                    try:
                        yield from self._level(inner, data, depth + 1)
                    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, EOFError):
                        yield self._row("broken", level, inner, depth, info.filename)


#: Rows and bytes of one batch of entries; a single entry may be larger.
HELD_ROWS, HELD_BYTES = 1000, 8 << 20
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_TYPES = {"level": pa.int32(), "depth": pa.int32(), "ordinal": pa.int32(), "data": pa.binary(), "size": pa.int64(), "compressed_size": pa.int64(), "offset": pa.int64(), "nested": pa.bool_()}


def exploded(batches: Iterator[pa.RecordBatch], max_depth: int = MAX_DEPTH, wanted: Callable[[str], bool] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of all archives in batches of (artifact_id, path, content).

    Small archives share a batch, large ones take several.  Every entry is read;
    ``wanted`` says by name whose bytes are handed on, the others' ``data`` is null.
    """

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES.get(n, pa.string())) for n in _NAMES], names=_NAMES)

    held, size = [], 0
    for batch in batches:
        for key, path, content in zip(batch.column("artifact_id"), batch.column("path"), batch.column("content")):
            for row in Walk(path.as_py().rsplit("/", 1)[-1], content.as_py() or b"", max_depth).rows():
                row["artifact_id"] = key.as_py()
                if wanted and "data" in row and not wanted(row["name"]):
                    row["data"] = None
                held.append(row)
                size += len(row.get("data") or b"")
                if size >= HELD_BYTES or len(held) >= HELD_ROWS:
                    yield made(held)
                    held, size = [], 0
    if held:
        yield made(held)


def explode(artifacts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows of all archives in (artifact_id, path, content); few entries are held at a time."""
    return artifacts.select("artifact_id", "path", "content").mapInArrow(lambda batches: exploded(batches, max_depth), ROWS)
