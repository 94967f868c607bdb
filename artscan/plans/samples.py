"""Archives and classes made from the driver's tables, so that what a scan must find follows from a row.

``Assembler`` writes class files; ``packed`` makes one archive per row of a
table where the row lies, in an Arrow pass.  ``unpacked`` reads them in that pass,
too, so that neither archives nor classes go back and forth as bytes.
"""
from __future__ import annotations

import base64
import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artscan.operators import classfile
from artscan.session import BATCH_BYTES
from artscan.sources import archive

RETURN, DUP, NEWARRAY = b"\xb1", b"\x59", 188
#: Element code of an array and the instruction that stores into it.
BYTES, CHARS, INTS = (8, 84), (5, 85), (10, 79)


class Assembler:
    """A class file: constants are added as they are asked for."""

    def __init__(self, name: str, above: str = "java/lang/Object", interfaces: tuple[str, ...] = ()):
        self.constants: dict[bytes, int] = {}
        self.methods: list[tuple[str, bytes]] = []
        self.handles: list[int] = []
        self.name, self.above, self.interfaces = self.kind(name), self.kind(above), [self.kind(i) for i in interfaces]

    def _add(self, raw: bytes) -> int:
        return self.constants.setdefault(raw, len(self.constants) + 1)

    def utf8(self, s: str) -> int:
        return self._add(struct.pack(">BH", 1, len(s.encode())) + s.encode())

    def kind(self, name: str) -> int:
        return self._add(struct.pack(">BH", 7, self.utf8(name)))

    def text(self, s: str) -> int:
        return self._add(struct.pack(">BH", 8, self.utf8(s)))

    def _named(self, name: str, descriptor: str) -> int:
        return self._add(struct.pack(">BHH", 12, self.utf8(name), self.utf8(descriptor)))

    def member(self, owner: str, name: str, descriptor: str, tag: int = 10) -> int:
        return self._add(struct.pack(">BHH", tag, self.kind(owner), self._named(name, descriptor)))

    def call(self, owner: str, name: str, descriptor: str, op: int = 184) -> bytes:
        if op == 185:
            return struct.pack(">BHBB", op, self.member(owner, name, descriptor, 11), 1, 0)
        return struct.pack(">BH", op, self.member(owner, name, descriptor))

    def reference(self, owner: str, name: str, descriptor: str) -> bytes:
        """A dynamic call whose bootstrap names a method."""
        self.handles.append(self._add(struct.pack(">BBH", 15, 6, self.member(owner, name, descriptor))))
        return struct.pack(">BHH", 186, self._add(struct.pack(">BHH", 18, len(self.handles) - 1, self._named("apply", "()Ljava/lang/Object;"))), 0)

    def load(self, s: str) -> bytes:
        return struct.pack(">BH", 19, self.text(s))

    @staticmethod
    def push(v: int) -> bytes:
        return struct.pack(">Bh", 17, v)

    def array(self, values, kind: tuple[int, int]) -> bytes:
        out = self.push(len(values)) + bytes([NEWARRAY, kind[0]])
        for i, v in enumerate(values):
            out += DUP + self.push(i) + self.push(v) + bytes([kind[1]])
        return out

    @staticmethod
    def dispatcher(targets: int) -> bytes:
        """A switch whose every target jumps back to it."""
        head = b"\x1b\xaa\0\0" + struct.pack(">iii", 0, 0, targets - 1) + struct.pack(">i", 0) * targets
        return head + b"".join(struct.pack(">Bh", 167, -(len(head) + 3 * i)) for i in range(targets))

    def build(self) -> bytes:
        bodies = b""
        code = self.utf8("Code")
        for name, body in self.methods:
            attribute = struct.pack(">HHI", 4, 4, len(body)) + body + struct.pack(">HH", 0, 0)
            bodies += struct.pack(">HHHH", 9, self.utf8(name), self.utf8("()V"), 1) + struct.pack(">HI", code, len(attribute)) + attribute
        tail = struct.pack(">H", 0)
        if self.handles:
            raw = struct.pack(">H", len(self.handles)) + b"".join(struct.pack(">HHH", h, 1, h) for h in self.handles)
            tail = struct.pack(">HHI", 1, self.utf8("BootstrapMethods"), len(raw)) + raw
        pool = b"".join(self.constants)
        head = struct.pack(">IHHH", 0xCAFEBABE, 0, 52, len(self.constants) + 1) + pool + struct.pack(">HHH", 33, self.name, self.above)
        return head + struct.pack(f">H{len(self.interfaces)}H", len(self.interfaces), *self.interfaces) + struct.pack(">HH", 0, len(self.methods)) + bodies + tail


def compiled(name: str, write: Callable[[Assembler], bytes], **more) -> bytes:
    """A class with one method, ``run``, of the instructions that ``write`` gives."""
    a = Assembler(name, **more)
    a.methods.append(("run", write(a) + RETURN))
    return a.build()


def boxed(text: bytes, k1: int, k2: int) -> tuple[list[int], list[int]]:
    """Two interleaved arrays that the substitution cipher turns back into ``text``."""
    out = []
    for b in text:
        v = (b * 53 + 97) % 256
        out.append((((v << k2) | (v >> (8 - k2))) & 0xFF) ^ k1)
    return out[0::2], out[1::2]


def hidden(technique: str, text: str, sealed: bytes | None = None, key: bytes = b"") -> Callable[[Assembler], bytes]:
    """Instructions that build ``text`` in one of the ways that a scan sees through."""
    signed = lambda data: [b - 256 if b > 127 else b for b in data]
    raw = text.encode()

    def write(a: Assembler) -> bytes:
        if technique == "byte_array_string":
            return a.array(signed(raw), BYTES)
        if technique == "char_array_string":
            return a.array(list(raw), CHARS)
        if technique == "base64_string":
            return a.load(base64.b64encode(raw).decode()) + a.call("java/util/Base64", "getDecoder", "()Ljava/util/Base64$Decoder;")
        if technique == "generic_xor_cipher":
            return a.load(key.decode()) + a.array(signed(b ^ key[i % len(key)] for i, b in enumerate(raw)), BYTES)
        if technique == "aes_embedded_key":
            make = a.call("javax/crypto/spec/SecretKeySpec", "<init>", "([BLjava/lang/String;)V", 183)
            return a.array(signed(key), BYTES) + a.array(signed(sealed or b""), BYTES) + make + a.call("javax/crypto/Cipher", "doFinal", "([B)[B", 182)
        one, other = boxed(raw, 42, 3)
        return a.array(one, INTS) + a.array(other, INTS) + a.push(42) + a.push(3) + a.call("m/Boxes", "open", "([I[III)Ljava/lang/String;")

    return write


def jar(entries: dict[str, bytes | str], stored: bool = True) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


#: Rows that become archives in one go, as many as Python objects may stand for.
ROWS_AT_ONCE = 500


def archives(batches: Iterator[pa.RecordBatch], make: Callable[[dict], bytes]) -> Iterator[pa.RecordBatch]:
    """An archive for each row, in batches of bounded size."""

    def batch_of(held):
        paths = pa.array([p for p, _ in held], pa.string())
        return pa.RecordBatch.from_arrays([paths, paths, pa.array([len(m) for _, m in held], pa.int64()), pa.array([m for _, m in held], pa.binary())], names=["artifact_id", "path", "length", "content"])

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            held, size = [], 0
            for r in batch.slice(at, ROWS_AT_ONCE).to_pylist():
                held.append((r["_path"], make(r)))
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)


def _dealt(rows: DataFrame, key: Column) -> DataFrame:
    rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.withColumn("_path", F.concat(F.lit("/m/"), key.cast("string"), F.lit(".jar")))


def packed(rows: DataFrame, key: Column, make: Callable[[dict], bytes]) -> DataFrame:
    """artifact_id, path, length and content: an archive for each row.

    A row of a few bytes becomes an archive of up to megabytes, so rows are dealt
    out before that, and the archives are handed on in batches of bounded size.
    """
    return _dealt(rows, key).mapInArrow(lambda batches: archives(batches, make), "artifact_id string, path string, length long, content binary")


def unpacked(rows: DataFrame, key: Column, make: Callable[[dict], bytes], wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """The rows of ``archive.explode`` over these archives, in one pass: each archive is taken apart where it is made."""
    return _dealt(rows, key).mapInArrow(lambda batches: archive.exploded(archives(batches, make), wanted=wanted), archive.ROWS)


def unpacked_classes(rows: DataFrame, key: Column, make: Callable[[dict], bytes]) -> DataFrame:
    """The rows of ``classfile.classes`` over these archives, in one pass."""
    return classfile.understood(_dealt(rows, key).mapInArrow(lambda batches: classfile.read(archive.exploded(archives(batches, make))), classfile.READ))
