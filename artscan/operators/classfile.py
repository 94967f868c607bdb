"""Compiled classes as rows: names, strings, calls, dispatch switches, hidden strings.

One Arrow pass reads the class format, so the bytes are read once and never
shuffled: constants, calls, array literals and jumps come out as arrays.  What
they mean (dispatchers, strings that are built or enciphered) is worked out by
column expressions in ``reconstruct``.  Everything is bounded by the class
itself.  A
class that is no class gives no row; one whose code ends inside a switch table
gives a row with ``error``, as does one with a method that can't be analysed
(``FAILED``), which keeps what its other methods give.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artscan.functions import signatures as sig
from artscan.operators import reconstruct
from artscan.schemas import CLASSES, PARTS

MAGIC = b"\xca\xfe\xba\xbe"
UTF8, INTEGER, FLOAT, LONG, DOUBLE, CLASS, STRING, FIELD, METHOD, IMETHOD, NAMETYPE, HANDLE, MTYPE, INDY = 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 18
#: Bytes of a constant by its tag; UTF8 has its own length.
CONSTANT_SIZE = {INTEGER: 4, FLOAT: 4, LONG: 8, DOUBLE: 8, CLASS: 2, STRING: 2, FIELD: 4, METHOD: 4, IMETHOD: 4, NAMETYPE: 4, HANDLE: 3, MTYPE: 2, INDY: 4}
INVOKES = {182: "invokevirtual", 183: "invokespecial", 184: "invokestatic", 185: "invokeinterface", 186: "invokedynamic"}
#: How the error of a class begins whose method could not be analysed.
FAILED = "analysis failed"
MAX_SWITCH = 65_536
MAX_ELEMENTS = 5000
#: Store instruction and value mask by the element code of an array: char, byte, int.
STORES = {5: (85, 0xFFFF), 8: (84, 0xFF), 10: (79, 0xFFFFFFFF)}
BOX_CALL = "([I[III)Ljava/lang/String;"


def _operand_sizes() -> list[int]:
    """Operand bytes of each instruction; switches and wide are handled apart."""
    size = [0] * 256
    for op in (16, 18, *range(21, 26), *range(54, 59), 169, 188):
        size[op] = 1
    for op in (17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199):
        size[op] = 2
    size[197], size[185], size[186], size[200], size[201] = 3, 4, 2, 4, 4
    return size


OPERANDS = _operand_sizes()
SIGNED = {16, 17, *range(153, 169), 198, 199, 200, 201}


class TruncatedSwitch(Exception):
    """The code ends inside a switch table."""


def decode(code: bytes) -> list[tuple[int, int, int]]:
    """(offset, opcode, value) of each instruction.

    A switch has the offset of its table's last byte and the number of its
    targets as value; invokeinterface lies two bytes late, and the two zero
    bytes behind invokedynamic count as instructions.
    """
    out, at = [], 0
    while at < len(code):
        op, start = code[at], at
        at += 1
        if op in (170, 171):
            at += -at % 4
            head = code[at : at + (12 if op == 170 else 8)]
            if len(head) < (12 if op == 170 else 8):
                raise TruncatedSwitch
            if op == 170:
                _, low, high = struct.unpack(">iii", head)
                n, width = high - low + 1, 4
            else:
                _, n = struct.unpack(">ii", head)
                width = 8
            if not 0 <= n <= MAX_SWITCH:
                break
            at += len(head) + n * width
            out.append((at - 1, op, n))
        elif op == 196:
            inner = code[at] if at < len(code) else 0
            at += 1 + (4 if inner == 132 else 2 if OPERANDS[inner] == 1 and inner not in (16, 18, 188) else 0)
            out.append((start, op, inner))
        else:
            n = OPERANDS[op]
            raw = code[at : at + (2 if op == 185 else n)]
            whole = len(raw) == (2 if op == 185 else n)
            out.append((start + (2 if op == 185 else 0), op, int.from_bytes(raw, "big", signed=op in SIGNED) if n and whole else 0))
            at += n
    return out


class Pool:
    """The constants of a class, by index."""

    def __init__(self, data: bytes, at: int, count: int):
        self.tag: dict[int, int] = {}
        self.raw: dict[int, bytes] = {}
        self.text: dict[int, str] = {}
        i = 1
        while i < count and at < len(data):
            tag = data[at]
            at += 1
            if tag == UTF8:
                if at + 2 > len(data):
                    break
                n = int.from_bytes(data[at : at + 2], "big")
                self.text[i] = data[at + 2 : at + 2 + n].decode("utf-8", "replace")
                at += 2 + n
            elif tag in CONSTANT_SIZE:
                n = CONSTANT_SIZE[tag]
                if at + n > len(data):
                    break
                self.raw[i] = data[at : at + n]
                at += n
            else:
                break
            self.tag[i] = tag
            i += 2 if tag in (LONG, DOUBLE) else 1
        self.end = at

    def _pair(self, i: int) -> tuple[int, int]:
        raw = self.raw.get(i, b"\0\0\0\0")
        return int.from_bytes(raw[:2], "big"), int.from_bytes(raw[2:4], "big")

    def class_name(self, i: int) -> str:
        return self.text.get(self._pair(i)[0], "") if self.tag.get(i) == CLASS else ""

    def literal(self, i: int) -> str:
        return self.text.get(self._pair(i)[0], "") if self.tag.get(i) == STRING else ""

    def integer(self, i: int) -> int | None:
        return int.from_bytes(self.raw[i], "big", signed=True) if self.tag.get(i) == INTEGER else None

    def member(self, i: int) -> tuple[str, str, str]:
        """Owner, name and descriptor of a member or of a dynamic call."""
        tag = self.tag.get(i)
        if tag not in (FIELD, METHOD, IMETHOD, INDY):
            return "", "", ""
        owner, both = self._pair(i)
        name, kind = self._pair(both) if self.tag.get(both) == NAMETYPE else (0, 0)
        return (self.class_name(owner) if tag != INDY else ""), self.text.get(name, ""), self.text.get(kind, "")

    def handle(self, i: int) -> tuple[str, str, str] | None:
        return self.member(int.from_bytes(self.raw[i][1:3], "big")) if self.tag.get(i) == HANDLE else None


class Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def u2(self) -> int:
        return int.from_bytes(self.take(2), "big")

    def u4(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def attributes(self, pool: Pool) -> Iterator[tuple[str, bytes]]:
        for _ in range(self.u2()):
            name = pool.text.get(self.u2(), "")
            yield name, self.take(self.u4())


def _bootstraps(body: bytes) -> list[list[int]]:
    """The arguments of each bootstrap method."""
    r, out = Reader(body, 0), []
    try:
        for _ in range(r.u2()):
            r.u2()
            out.append([r.u2() for _ in range(r.u2())])
    except EOFError:
        pass
    return out


class Method:
    """One method's instructions and what can be read from them."""

    def __init__(self, name: str, index: int, code: bytes, pool: Pool, bootstraps: list[list[int]]):
        self.name, self.index, self.pool = name, index, pool
        self.code = decode(code)
        self.calls = [(o, op, *self._target(op, v, bootstraps)) for o, op, v in self.code if 182 <= op <= 186]

    def _target(self, op: int, value: int, bootstraps: list[list[int]]) -> tuple[str, str, str]:
        if op == 186 and self.pool.tag.get(value) == INDY:
            no = int.from_bytes(self.pool.raw[value][:2], "big")
            for argument in bootstraps[no] if no < len(bootstraps) else ():
                found = self.pool.handle(argument)
                if found and (found[0] or found[1]):
                    return found
        return self.pool.member(value)

    def pushed(self, i: int) -> int | None:
        """The integer that the i-th instruction pushes, if it does."""
        _, op, value = self.code[i]
        if op in (16, 17):
            return value
        if 2 <= op <= 8:
            return op - 3
        return self.pool.integer(value) if op in (18, 19) else None

    def arrays(self, kind: int) -> list[tuple[int, list[int]]]:
        """Array literals of an element kind: offset and values, gaps being 0."""
        store, mask = STORES[kind]
        out = []
        for i, (offset, op, value) in enumerate(self.code):
            if op != 188 or value != kind:
                continue
            found: dict[int, int] = {}
            at = i + 1
            while len(found) < MAX_ELEMENTS:
                at += at < len(self.code) and self.code[at][1] == 89
                if at + 2 >= len(self.code) or self.code[at + 2][1] != store:
                    break
                index, element = self.pushed(at), self.pushed(at + 1)
                if index is None or element is None:
                    break
                found[index] = element & mask
                at += 3
            if found and max(found) >= 0:
                out.append((offset, [found.get(k, 0) for k in range(max(found) + 1)]))
        return out

    def loaded(self) -> list[tuple[int, str]]:
        pool = self.pool
        texts = ((o, pool.literal(v) or pool.text.get(v, "")) for o, op, v in self.code if op in (18, 19))
        return [(o, s) for o, s in texts if s]

    def switches(self) -> list[dict]:
        """Every switch with the method's jumps: how many there are, how many lead back to it, and the opcodes before it."""
        gotos = [(o, o + v) for o, op, v in self.code if op == 167]
        out = []
        for offset, op, targets in self.code:
            if op in (170, 171):
                springs = {o for o, to in gotos if to <= offset}
                back = sum(to <= offset or to in springs for _, to in gotos)
                before = [p for o, p, _ in self.code if o < offset][-sig.LOOP_WINDOW :]
                out.append({"offset": offset, "targets": targets, "gotos": len(gotos), "back": back, "before": before})
        return out

    def boxes(self) -> list[dict]:
        """Calls that may open a box cipher, with the two numbers pushed before them."""
        places = {o: i for i, (o, _, _) in reversed(list(enumerate(self.code)))}
        out = []
        for offset, _, _, _, descriptor in self.calls:
            at = places[offset]
            if descriptor == BOX_CALL and at >= 2:
                k1, k2 = self.pushed(at - 2), self.pushed(at - 1)
                if k1 is not None and k2 is not None:
                    out.append({"offset": offset, "k1": k1, "k2": k2})
        return out

    def hidden(self) -> dict:
        """What ``reconstruct`` looks for hidden strings in: array literals, loaded strings, members called."""
        return {
            "method": self.name, "bytes": [{"offset": o, "data": bytes(v)} for o, v in self.arrays(8)],
            "texts": [{"offset": o, "value": "".join(map(chr, v)).encode("utf-8", "replace").decode()} for o, v in self.arrays(5)],
            "ints": [{"offset": o, "values": v} for o, v in self.arrays(10)], "boxes": self.boxes(), "loads": [{"offset": o, "value": v} for o, v in self.loaded()],
            "members": list(dict.fromkeys(f"{owner}.{name}" for _, _, owner, name, _ in self.calls)), "switches": self.switches(),
        }


def unbox(first: list[int], second: list[int], k1: int, k2: int) -> str:
    """Two interleaved arrays under XOR, rotation and the substitution i -> 53 i + 97 (29 inverts 53)."""
    turn, out = k2 % 8, bytearray()
    for i in range(max(len(first), len(second))):
        for part in (first, second):
            if i < len(part):
                x = part[i] ^ k1
                out.append(((((x >> turn) | (x << (8 - turn))) & 0xFF) - 97) * 29 % 256)
    return out.decode("utf-8", "replace")


def parse(data: bytes) -> dict | None:
    """A row of the classes table, None for what is no class; ``switches`` and ``recon`` are filled in from ``parts`` later."""
    if len(data) < 10 or data[:4] != MAGIC:
        return None
    count = int.from_bytes(data[8:10], "big")
    if count < 1:
        return None
    pool = Pool(data, 10, count)
    r = Reader(data, pool.end)
    try:
        r.u2()
        name, above = pool.class_name(r.u2()), pool.class_name(r.u2())
        interfaces = [pool.class_name(r.u2()) for _ in range(r.u2())]
        for _ in range(r.u2()):
            r.take(6)
            for _ in r.attributes(pool):
                pass
        bodies = []
        for _ in range(r.u2()):
            r.u2()
            method = pool.text.get(r.u2(), "")
            r.u2()
            code = b""
            for attribute, body in r.attributes(pool):
                if attribute == "Code" and len(body) >= 8:
                    code = body[8 : 8 + int.from_bytes(body[4:8], "big")]
            bodies.append((method, code))
    except EOFError:
        return None
    bootstraps: list[list[int]] = []
    try:
        for attribute, body in r.attributes(pool):
            if attribute == "BootstrapMethods":
                bootstraps = _bootstraps(body)
    except EOFError:
        pass
    row = {
        "class_name": name, "super_name": above, "interfaces": interfaces, "utf8": [s for s in pool.text.values() if s],
        "literals": [s for s in map(pool.literal, pool.tag) if s], "invokes": [], "parts": [], "switches": [], "recon": [], "error": None,
    }
    for i, (method, code) in enumerate(bodies):
        if not code:
            continue
        try:
            m = Method(method, i, code, pool, bootstraps)
            parts = m.hidden()
        except TruncatedSwitch:
            row["error"] = "code ends inside a switch"
            break
        except Exception as error:  # noqa: BLE001 - one method must not end the scan of all others
            row["error"] = f"{FAILED}: {type(error).__name__} in {method}"
            continue
        row["invokes"] += [{"method": method, "method_idx": i, "offset": o, "opcode": op, "owner": a, "name": n, "descriptor": d} for o, op, a, n, d in m.calls]
        row["parts"].append(parts)
    return row


_ARROW = pa.schema([
    ("class_name", pa.string()), ("super_name", pa.string()), ("interfaces", pa.list_(pa.string())), ("utf8", pa.list_(pa.string())), ("literals", pa.list_(pa.string())),
    ("invokes", pa.list_(pa.struct([("method", pa.string()), ("method_idx", pa.int32()), ("offset", pa.int32()), ("opcode", pa.int32()), ("owner", pa.string()), ("name", pa.string()), ("descriptor", pa.string())]))),
    ("parts", pa.list_(pa.struct([
        ("method", pa.string()), ("bytes", pa.list_(pa.struct([("offset", pa.int32()), ("data", pa.binary())]))), ("texts", pa.list_(pa.struct([("offset", pa.int32()), ("value", pa.string())]))),
        ("ints", pa.list_(pa.struct([("offset", pa.int32()), ("values", pa.list_(pa.int64()))]))), ("boxes", pa.list_(pa.struct([("offset", pa.int32()), ("k1", pa.int32()), ("k2", pa.int32())]))),
        ("loads", pa.list_(pa.struct([("offset", pa.int32()), ("value", pa.string())]))), ("members", pa.list_(pa.string())),
        ("switches", pa.list_(pa.struct([("offset", pa.int32()), ("targets", pa.int32()), ("gotos", pa.int32()), ("back", pa.int32()), ("before", pa.list_(pa.int32()))]))),
    ]))), ("error", pa.string()),
])


#: What ``read`` gives, and the bytes of the classes that are held as Python objects, which take some fifty times as much.
READ = f"artifact_id string, level int, level_path string, ordinal int, name string, {CLASSES.partition(', switches ')[0]}, {PARTS}, error string"
READ_BYTES = 256 << 10
_PLACE = ("artifact_id", "level", "level_path", "ordinal", "name")


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes among entries, a bounded number at a time."""

    def made(batch, kept, rows):
        own = pa.Table.from_pylist(rows, schema=_ARROW)
        return pa.Table.from_arrays([*(batch.column(c).take(pa.array(kept, pa.int32())) for c in _PLACE), *(c.combine_chunks() for c in own.columns)], names=[*_PLACE, *own.column_names]).to_batches()

    for batch in batches:
        kept, rows, size = [], [], 0
        for i, data in enumerate(batch.column("data")):
            data = data.as_py()
            row = parse(data) if data else None
            if row:
                kept.append(i)
                rows.append(row)
                size += len(data)
            if size >= READ_BYTES:
                yield from made(batch, kept, rows)
                kept, rows, size = [], [], 0
        if rows:
            yield from made(batch, kept, rows)


def understood(found: DataFrame) -> DataFrame:
    """Classes as ``read`` gives them, with their dispatchers and hidden strings."""
    return found.withColumns(reconstruct.columns(found.sparkSession.sparkContext.applicationId)).select(*_PLACE, *found.columns[5:-2], "switches", "recon", "error")


def classes(entries: DataFrame) -> DataFrame:
    """artifact_id, level, ordinal, name of the entry, and the class in it."""
    found = entries.filter(F.startswith(F.col("data"), F.lit(MAGIC))).select(*_PLACE, "data")
    return understood(found.mapInArrow(read, READ))
