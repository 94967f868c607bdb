"""What the parts of a class's methods mean: dispatchers of flattened methods, and strings that code builds or hides.

Column expressions over ``schemas.PARTS``; each way of hiding a string is one
function from a method's parts to an array of (offset, value).  A value that an
expression needs for every element is bound once by ``let``, as a lambda's body
would work it out again for each.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from artscan.functions import decode
from artscan.functions import signatures as sig
from artscan.functions import text as fn

_FOUND = "array<struct<offset:int,value:string>>"
#: Keys of a repeating XOR: prefixes, up to 16 bytes, of the class's strings of up to 32 characters.
KEY_BYTES, KEY_TEXT = 16, 32
#: Bytes by which a key is ruled out before the whole array is deciphered, and the least size of such an array.
TRIED = 6
#: Hexadecimal digits of bytes that plain text has: blanks, line ends, printable ASCII.
PLAIN = "^(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])*$"
#: The bits that no byte of plain text has, in each of the first bytes: one comparison rules out most keys.
NEVER_PLAIN = int.from_bytes(b"\x80" * TRIED, "big")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(offset: Column, value: Column) -> Column:
    return F.struct(offset.alias("offset"), value.alias("value"))


def _none() -> Column:
    return F.array().cast(_FOUND)


def byte_arrays(p: Column) -> Column:
    return F.transform(F.filter(p["bytes"], lambda b: b["text"].isNotNull()), lambda b: _found(b["offset"], b["text"]))


def char_arrays(p: Column) -> Column:
    return F.filter(p["texts"], lambda t: F.length(t["value"]) > 1)


def box_ciphers(p: Column) -> Column:
    """The two arrays of integers before a call that opens them with two numbers."""

    def of(box: Column) -> Column:
        before = F.filter(p["ints"], lambda a: a["offset"] < box["offset"])
        opened = lambda two: _found(F.get(two, F.lit(0))["offset"], decode.box_cipher(F.get(two, F.lit(0))["values"], F.get(two, F.lit(1))["values"], box["k1"], box["k2"]))
        return let(before, lambda arrays: F.when(F.size(arrays) >= 2, let(F.slice(arrays, -2, 2), opened)))

    return F.filter(F.transform(p["boxes"], of), lambda f: F.length(f["value"]) > 1)


def base64_strings(p: Column) -> Column:
    """Loaded strings that a method which names the decoder would decode to other text."""
    uses = F.exists(p["members"], lambda m: F.startswith(m, F.lit("java/util/Base64.")))
    coded = F.filter(p["loads"], lambda s: fn.looks_like_base64(s["value"]))
    opened = F.transform(coded, lambda s: F.struct(s["offset"].alias("offset"), decode.base64_text(s["value"]).alias("value"), s["value"].alias("raw")))
    kept = F.filter(opened, lambda s: (s["value"] != "") & (s["value"] != s["raw"]))
    return F.when(uses, F.transform(kept, lambda s: _found(s["offset"], s["value"]))).otherwise(_none())


def _unreadable(b: Column) -> Column:
    return b["text"].isNull() & (F.octet_length(b["data"]) >= TRIED)


def xor_keys(utf8: Column) -> Column:
    """Keys in order of the strings and of length, each as hexadecimal digits and as the number that the first bytes are XORed with."""
    short = F.filter(utf8, lambda s: F.length(s).between(1, KEY_TEXT))
    begins = lambda digits: F.transform(F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")), lambda n: F.substring(digits, F.lit(1), 2 * n))
    prefixes = lambda s: let(F.hex(F.substring(s.cast("binary"), 1, KEY_BYTES)), begins)
    number = lambda k: F.conv(F.substring(F.repeat(k, F.lit(TRIED)), 1, 2 * TRIED), 16, 10).cast("long")
    return F.transform(F.array_distinct(F.flatten(F.transform(short, prefixes))), lambda k: F.struct(k.alias("key"), number(k).alias("head")))


def xor_ciphers(p: Column, keys: Column) -> Column:
    """Arrays that are no text by themselves, under the first key that makes them one."""

    def of(b: Column) -> Column:
        head = F.conv(F.substring(F.hex(b["data"]), 1, 2 * TRIED), 16, 10).cast("long")
        under = lambda k, h: k["head"].bitwiseXOR(h)
        may = lambda k, h: under(k, h).bitwiseAND(F.lit(NEVER_PLAIN).cast("long")) == 0
        fits = lambda h: F.filter(keys, lambda k: may(k, h) & F.lpad(F.hex(under(k, h)), 2 * TRIED, "0").rlike(PLAIN))
        opened = F.transform(let(head, fits), lambda k: fn.decoded(decode.xor_under(b["data"], k["key"])))
        return _found(b["offset"], F.get(F.filter(opened, fn.plausible_text), F.lit(0)))

    return F.filter(F.transform(F.filter(p["bytes"], _unreadable), of), lambda f: f["value"].isNotNull())


def aes_candidates(p: Column) -> Column:
    """Pairs of a key and blocks, for a method that deciphers with a key of its own; ``detectors.resolved`` tries them."""
    uses = F.exists(p["members"], lambda m: F.startswith(m, F.lit("javax/crypto/spec/SecretKeySpec."))) & F.array_contains(p["members"], F.lit("javax/crypto/Cipher.doFinal"))
    size = lambda b: F.octet_length(b["data"])
    keys = F.filter(p["bytes"], lambda k: size(k).isin(16, 24, 32))
    digits = lambda b: F.lower(F.hex(b["data"]))

    def under(k: Column) -> Column:
        sealed = F.filter(p["bytes"], lambda b: (size(b) > 0) & (size(b) % 16 == 0) & (b["offset"] != k["offset"]) & (b["data"] != k["data"]))
        return F.transform(sealed, lambda b: _found(b["offset"], F.concat(digits(k), F.lit(":"), digits(b))))

    return F.when(uses, F.flatten(F.transform(keys, under))).otherwise(_none())


def strings(parts: Column, utf8: Column) -> Column:
    """method, offset, value and technique of the strings that methods build or load, in order of method and technique."""

    def read(b: Column) -> Column:
        text = F.try_validate_utf8(b["data"].cast("string"))
        return F.struct(b["offset"].alias("offset"), b["data"].alias("data"), F.when(fn.plausible_text(text), text).alias("text"))

    names = ("texts", "ints", "boxes", "loads", "members")
    marked = F.transform(parts, lambda p: F.struct(p["method"].alias("method"), F.transform(p["bytes"], read).alias("bytes"), *[p[n].alias(n) for n in names]))

    def of_method(p: Column, keys: Column) -> Column:
        ways = (
            ("byte_array_string", byte_arrays(p)), ("char_array_string", char_arrays(p)), ("weedhack_xor_cipher", box_ciphers(p)), ("base64_string", base64_strings(p)),
            ("generic_xor_cipher", xor_ciphers(p, keys)), ("aes_candidate", aes_candidates(p)), ("ldc_string", p["loads"]),
        )
        told = lambda name, found: F.transform(found, lambda f: F.struct(p["method"].alias("method"), f["offset"].alias("offset"), f["value"].alias("value"), F.lit(name).alias("technique")))
        return F.concat(*[told(name, found) for name, found in ways])

    def of(ps: Column) -> Column:
        sealed = F.exists(ps, lambda p: F.exists(p["bytes"], _unreadable))
        keys = F.when(sealed, xor_keys(utf8)).otherwise(F.array().cast("array<struct<key:string,head:bigint>>"))
        return let(keys, lambda ks: F.flatten(F.transform(ps, lambda p: of_method(p, ks))))

    return let(marked, of)


def dispatchers(parts: Column) -> Column:
    """Switches that look like the dispatcher of a flattened method: most jumps lead back, and no loop's test stands before."""

    def looks(w: Column) -> Column:
        loops = F.exists(w["before"], lambda op: op.isin(*sig.LOOP_OPCODES))
        return (w["targets"] >= sig.DISPATCH_TARGETS) & (w["gotos"] >= sig.GOTO_RATIO * w["targets"]) & (w["back"] >= sig.BACK_FRACTION * w["gotos"]) & ~loops

    row = lambda p, w: F.struct(p["method"].alias("method"), *[w[c].alias(c) for c in ("offset", "targets", "gotos", "back")])
    return F.flatten(F.transform(parts, lambda p: F.transform(F.filter(p["switches"], looks), lambda w: row(p, w))))


@functools.lru_cache(maxsize=4)
def columns(application: str) -> dict[str, Column]:
    """``switches`` and ``recon`` from ``parts`` and ``utf8``; the expressions are large, so an application builds them once."""
    return {"switches": dispatchers(F.col("parts")), "recon": strings(F.col("parts"), F.col("utf8"))}
