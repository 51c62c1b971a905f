"""Ed25519 signatures (RFC 8032) on Python's integers, and Arrow-batched UDFs that sign and verify.

Points are (X, Y, Z, T) with x = X / Z, y = Y / Z, xy = T / Z on -x^2 + y^2 = 1 + d x^2 y^2. Signing isn't done in constant time, so keys
belong on machines that nobody else shares.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

#: Fixed values of the curve: the field, the order of the base point, d, a root of -1, and the base point's y.
P, ORDER = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
D, ROOT = -121665 * pow(121666, -1, P) % P, pow(2, (P - 1) // 4, P)
NEUTRAL = (0, 1, 1, 0)


def add(a: tuple, b: tuple) -> tuple:
    """The sum of two points; complete, so equal and neutral ones too."""
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    g, h = 2 * D * a[3] * b[3] % P, 2 * a[2] * b[2] % P
    u, v, w, z = f - e, h - g, h + g, f + e
    return u * v % P, z * w % P, v * w % P, u * z % P


def times(n: int, point: tuple) -> tuple:
    total = NEUTRAL
    for bit in bin(n)[2:]:
        total = add(total, total)
        if bit == "1":
            total = add(total, point)
    return total


def x_of(y: int, odd: int) -> int | None:
    """The x of a point with that y and parity; None if there is none."""
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x % 2 != odd else x


def point_of(data: bytes) -> tuple | None:
    """The point of its 32 bytes; None if they are none."""
    value = int.from_bytes(data, "little")
    y, odd = value & ((1 << 255) - 1), value >> 255
    x = x_of(y, odd) if len(data) == 32 and y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def bytes_of(point: tuple) -> bytes:
    inverse = pow(point[2], -1, P)
    x, y = point[0] * inverse % P, point[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


_Y = 4 * pow(5, -1, P) % P
BASE = (x_of(_Y, 0), _Y, 1, x_of(_Y, 0) * _Y % P)


@lru_cache(maxsize=1)
def _multiples() -> list[list[tuple]]:
    """The base point times each digit of base 16 at each of its 64 places."""
    rows, point = [], BASE
    for _ in range(64):
        row = [NEUTRAL]
        for _ in range(15):
            row.append(add(row[-1], point))
        rows.append(row)
        point = add(row[-1], point)
    return rows


def times_base(n: int) -> tuple:
    total = NEUTRAL
    for row in _multiples():
        total, n = add(total, row[n & 15]), n >> 4
    return total


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


@lru_cache(maxsize=64)
def _expanded(secret: bytes) -> tuple[int, bytes, bytes]:
    """The scalar, the prefix and the public key of a secret."""
    if len(secret) != 32:
        raise ValueError("a secret has 32 bytes")
    digest = hashlib.sha512(secret).digest()
    scalar = int.from_bytes(digest[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return scalar, digest[32:], bytes_of(times_base(scalar))


def public_of(secret: bytes) -> bytes:
    return _expanded(secret)[2]


def sign(secret: bytes, message: bytes) -> bytes:
    scalar, prefix, public = _expanded(secret)
    nonce = _number(prefix, message) % ORDER
    start = bytes_of(times_base(nonce))
    return start + ((nonce + _number(start, public, message) * scalar) % ORDER).to_bytes(32, "little")


@lru_cache(maxsize=1024)
def _key(public: bytes) -> tuple | None:
    return point_of(public)


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature is the key's for the message; False for keys and signatures that are none."""
    if len(signature) != 64:
        return False
    key, start, response = _key(public), point_of(signature[:32]), int.from_bytes(signature[32:], "little")
    if key is None or start is None or response >= ORDER:
        return False
    left, right = times_base(response), add(start, times(_number(signature[:32], public, message) % ORDER, key))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def signed(secret: bytes):
    """A UDF: the signature of each message (binary); null of a null."""

    @F.pandas_udf(BinaryType())
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: None if m is None else sign(secret, bytes(m)))

    return run


def verified(public: bytes):
    """A UDF: whether each signature is the key's for its message; False for nulls."""

    @F.pandas_udf(BooleanType())
    def run(messages: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([m is not None and s is not None and verify(public, bytes(m), bytes(s)) for m, s in zip(messages, signatures, strict=True)], dtype=bool)

    return run
