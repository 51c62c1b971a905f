"""Keyed digests as built-in expressions: HMAC-SHA256, signed values, and passwords by PBKDF2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import bound

_BLOCK = 64
#: Fixed value: rounds of a password's digest.
ROUNDS = 160_000


def _padded(key: Column) -> Column:
    """A key of one block in hex; longer ones are digested first."""
    short = F.when(F.octet_length(key) > _BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    return F.rpad(F.hex(short), 2 * _BLOCK, "0")


def _xored(hexed: Column, byte: int) -> Column:
    """Hex with each byte xor a fixed one."""
    each = F.transform(F.sequence(F.lit(0), F.lit(_BLOCK // 4 - 1)), lambda i: F.lpad(F.hex(F.conv(F.substring(hexed, i * 8 + 1, F.lit(8)), 16, 10).cast("long").bitwiseXOR(F.lit(byte * 0x01010101))), 8, "0"))
    return F.array_join(each, "")


def _pads(key: Column) -> Column:
    """The inner and the outer pad of a key (binary)."""
    return bound(_padded(key), lambda k: F.struct(F.unhex(_xored(k, 0x36)).alias("inner"), F.unhex(_xored(k, 0x5C)).alias("outer")))


def _digest(pads: Column, message: Column) -> Column:
    return F.sha2(F.concat(pads["outer"], F.unhex(F.sha2(F.concat(pads["inner"], message), 256))), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """The HMAC in hex of a message under a key, both binary or text; null if either is."""
    found = bound(_pads(key.cast("binary")), lambda pads: _digest(pads, message.cast("binary")))
    return F.when(key.isNotNull() & message.isNotNull(), found)


def signed(value: Column, key: Column) -> Column:
    """A value with its HMAC behind a dot."""
    return F.concat(value, F.lit("."), hmac_sha256(key, value))


def unsigned(value: Column, key: Column) -> Column:
    """The value that ``signed`` has made; null if it has been changed, or was signed by another key."""
    mark = F.substring_index(value, ".", -1)
    raw = F.substring(value, F.lit(1), F.length(value) - F.length(mark) - 1)
    return F.when(value.contains(".") & (hmac_sha256(key, raw) == mark), raw)


def _xor(a: Column, b: Column) -> Column:
    """Two digests in hex, xor each other."""
    part = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    return F.concat(*(F.lpad(F.hex(part(a, i).bitwiseXOR(part(b, i))), 8, "0") for i in range(8)))


def pbkdf2_sha256(password: Column, salt: Column, rounds: int = ROUNDS) -> Column:
    """The first block (32 bytes, in hex) of PBKDF2 with HMAC-SHA256: a fold of ``rounds`` steps, each of two digests."""

    def folded(pads: Column) -> Column:
        first = _digest(pads, F.concat(salt.cast("binary"), F.lit(b"\x00\x00\x00\x01")))
        start = bound(first, lambda u: F.struct(u.alias("u"), u.alias("sum")))
        step = lambda s, _: bound(_digest(pads, F.unhex(s["u"])), lambda u: F.struct(u.alias("u"), F.lower(_xor(s["sum"], u)).alias("sum")))
        return F.aggregate(F.sequence(F.lit(2), F.lit(rounds)), start, step, lambda s: s["sum"]) if rounds > 1 else first

    return F.when(password.isNotNull() & salt.isNotNull(), bound(_pads(password.cast("binary")), folded))


def password_matches(password: Column, stored: Column, rounds: int = ROUNDS) -> Column:
    """Whether a password has the stored digest, ``salt$base64``; False for anything of another form."""
    salt, digest = F.substring_index(stored, "$", 1), F.substring(stored, F.locate("$", stored) + 1, F.length(stored))
    found = F.base64(F.unhex(pbkdf2_sha256(password, salt, rounds)))
    return F.coalesce(stored.contains("$") & (F.regexp_replace(found, "\\s", "") == digest), F.lit(False))
