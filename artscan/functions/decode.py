"""Decoders of hidden strings as column functions on bytes and integer arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from artscan.functions.text import decoded


def to_bytes(values: Column) -> Column:
    """An array of integers as bytes, each taken modulo 256."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(255).cast("long"))), 2, "0")), ""))


def to_values(data: Column) -> Column:
    """Bytes as an array of integers from 0 to 255; the bytes are evaluated once, not per element."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))


#: Bytes that are XORed at once: as many as fit a long without its sign.
PIECE = 7


def xor_bytes(data: Column, key: bytes) -> Column:
    """Bytes under a repeating key, by pieces of seven bytes as one number each; an empty key gives no bytes.

    The key's pieces repeat after as many pieces as it has bytes, so they are
    constants; the last, shorter piece of the data takes the key's first bytes.
    """
    if not key:
        return F.lit(b"")
    keys = F.array(*[F.lit(int.from_bytes((key * (PIECE + 1))[PIECE * i % len(key) :][:PIECE], "big")) for i in range(len(key))])

    def one(piece: Column, i: Column) -> Column:
        under = F.call_function("shiftright", F.get(keys, (i % len(key)).cast("int")), 8 * PIECE - 4 * F.length(piece))
        return F.lpad(F.hex(F.conv(piece, 16, 10).cast("long").bitwiseXOR(under)), F.length(piece), "0")

    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit(f"(.{{1,{2 * PIECE}}})"), F.lit(1)), one), ""))


def xor_under(data: Column, key: Column) -> Column:
    """Bytes under a repeating key that is a column of hexadecimal digits; by pieces of seven bytes, too."""
    digits = F.hex(data)
    n = F.length(digits)
    along = F.substring(F.repeat(key, F.ceil(n / F.length(key)).cast("int")), F.lit(1), n)
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(.{{1,{2 * PIECE}}})"), F.lit(1))
    number = lambda c: F.conv(c, 16, 10).cast("long")
    return F.unhex(F.array_join(F.zip_with(cut(digits), cut(along), lambda a, b: F.lpad(F.hex(number(a).bitwiseXOR(number(b))), F.length(a), "0")), ""))


def aes_ecb(data: Column, key: Column) -> Column:
    """Whole blocks deciphered without padding; null if lengths do not fit.

    The built-in wants padding, so a block of pure padding, enciphered with the
    same key, is put behind the data.
    """
    padding = F.aes_encrypt(F.lit(b""), key, F.lit("ECB"), F.lit("PKCS"))
    fits = F.octet_length(key).isin(16, 24, 32) & (F.octet_length(data) > 0) & (F.octet_length(data) % 16 == 0)
    return F.when(fits, F.try_aes_decrypt(F.concat(data, padding), key, F.lit("ECB"), F.lit("PKCS")))


def without_padding(data: Column) -> Column:
    """Bytes without a padding tail, if they end in one.

    ``data`` is named several times: give a column, not the expression that makes it.
    """
    tail = F.hex(F.substring(data, F.lit(-1), F.lit(1)))
    n = F.conv(tail, 16, 10).cast("int")
    padded = n.between(1, 16) & (F.octet_length(data) >= n) & (F.hex(F.substring(data, -n, n)) == F.repeat(tail, n))
    return F.when(padded, F.substring(data, F.lit(1), F.octet_length(data) - n)).otherwise(data)


def box_cipher(first: Column, second: Column, k1: Column, k2: Column) -> Column:
    """Two interleaved integer arrays under XOR, rotation and a substitution, as text."""
    longer = F.greatest(F.size(first), F.size(second))
    woven = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(longer - 1, F.lit(0))), lambda i: F.array_compact(F.array(F.get(first, i), F.get(second, i)))))
    turn = F.pmod(k2, F.lit(8))
    # The substitution maps i to 53 i + 97 modulo 256; 29 is the inverse of 53.
    power = F.pow(F.lit(2), turn).cast("long")
    up = F.pow(F.lit(2), F.lit(8) - turn).cast("long")

    def one(v: Column) -> Column:
        x = v.cast("long").bitwiseXOR(k1.cast("long"))
        y = F.floor(x / power).bitwiseOR(x * up).bitwiseAND(F.lit(255).cast("long"))
        return F.pmod((y - 97) * 29, F.lit(256))

    return F.when(longer > 0, decoded(to_bytes(F.transform(woven, one)))).otherwise("")


def base64_text(s: Column) -> Column:
    """Decoded text, null if it is no Base64 of valid UTF-8."""
    raw = F.try_to_binary(s, F.lit("base64"))
    return F.try_validate_utf8(raw.cast("string"))


def reversed_builders(source: Column) -> Column:
    """Literals that builders in source text reverse, put right again, then pairs of literals that one joins."""
    reverse = r'new\s+StringBuilder\s*\(\s*"([^"]*)"\s*\)\s*\.\s*reverse\s*\(\s*\)\s*\.\s*toString\s*\(\s*\)'
    literal = r'\s*\.\s*append\s*\(\s*"([^"]*)"\s*\)'
    pairs = r"new\s+StringBuilder\s*\(\s*\)" + literal + literal
    turned = F.transform(F.regexp_extract_all(source, F.lit(reverse), F.lit(1)), lambda s: F.reverse(s))
    halves = [F.regexp_extract_all(source, F.lit(pairs), F.lit(i)) for i in (1, 2)]
    return F.concat(turned, F.zip_with(*halves, lambda a, b: F.concat(a, b)))
