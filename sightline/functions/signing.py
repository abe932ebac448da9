"""Signatures in plain integers: RSA with probabilistic padding (SHA-256), and ECDSA over P-256 (SHA-256).

Keys and salts are the caller's, so equal inputs give equal signatures. No effort is made to hide timings:
these functions check and make signatures in analyses, they do not guard keys.
"""

from __future__ import annotations

import hashlib

#: The curve P-256 (prime, a, b, base point, order).
PRIME = 0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF
CURVE_A = PRIME - 3
CURVE_B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
BASE = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)
ORDER = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
SALT_BYTES = 32


def fingerprint(der: bytes) -> str:
    """A public key's fingerprint."""
    return hashlib.sha3_256(der).hexdigest()


def _prime(bits: int, draw) -> int:
    """A prime of the wanted length, by Miller and Rabin's test."""
    while True:
        n = draw.getrandbits(bits) | 3 << bits - 2 | 1
        if any(n % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)):
            continue
        d, r = n - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for _ in range(24):
            x = pow(draw.randrange(2, n - 1), d, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
                break
        else:
            return n


def rsa_key(seed: int, bits: int = 2048, exponent: int = 65537) -> tuple[int, int]:
    """Modulus and private exponent that follow from a seed: for tests and synthetic tables."""
    import random

    draw = random.Random(seed)
    while True:
        p, q = _prime(bits // 2, draw), _prime(bits // 2, draw)
        if p != q and (p - 1) % exponent and (q - 1) % exponent:
            return p * q, pow(exponent, -1, (p - 1) * (q - 1))


# ---- RSA --------------------------------------------------------------------------------------


def _mask(seed: bytes, size: int) -> bytes:
    out = b"".join(hashlib.sha256(seed + i.to_bytes(4, "big")).digest() for i in range(-(-size // 32)))
    return out[:size]


def rsa_sign(message: bytes, modulus: int, exponent: int, salt: bytes) -> bytes:
    """With the private exponent."""
    bits = modulus.bit_length() - 1
    size = -(-bits // 8)
    digest = hashlib.sha256(bytes(8) + hashlib.sha256(message).digest() + salt).digest()
    block = bytes(size - len(salt) - 34) + b"\x01" + salt
    masked = bytearray(a ^ b for a, b in zip(block, _mask(digest, len(block))))
    masked[0] &= 0xFF >> (8 * size - bits)
    return pow(int.from_bytes(bytes(masked) + digest + b"\xbc", "big"), exponent, modulus).to_bytes(-(-modulus.bit_length() // 8), "big")


def rsa_verify(message: bytes, signature: bytes, modulus: int, exponent: int = 65537, salt_bytes: int = SALT_BYTES) -> bool:
    bits = modulus.bit_length() - 1
    size = -(-bits // 8)
    value = int.from_bytes(signature, "big")
    if value >= modulus:
        return False
    opened = pow(value, exponent, modulus)
    if opened.bit_length() > 8 * size:
        return False
    opened = opened.to_bytes(size, "big")
    masked, digest = opened[: size - 33], opened[size - 33 : -1]
    if opened[-1] != 0xBC or masked[0] >> (8 - (8 * size - bits)) and 8 * size > bits:
        return False
    block = bytearray(a ^ b for a, b in zip(masked, _mask(digest, len(masked))))
    block[0] &= 0xFF >> (8 * size - bits)
    salt = bytes(block[len(block) - salt_bytes :])
    if bytes(block) != bytes(len(block) - salt_bytes - 1) + b"\x01" + salt:
        return False
    return hashlib.sha256(bytes(8) + hashlib.sha256(message).digest() + salt).digest() == digest


# ---- elliptic curve ---------------------------------------------------------------------------


def _add(p: tuple | None, q: tuple | None) -> tuple | None:
    if p is None or q is None:
        return p or q
    if p[0] == q[0] and (p[1] + q[1]) % PRIME == 0:
        return None
    slope = (3 * p[0] * p[0] + CURVE_A) * pow(2 * p[1], -1, PRIME) if p == q else (q[1] - p[1]) * pow(q[0] - p[0], -1, PRIME)
    x = (slope * slope - p[0] - q[0]) % PRIME
    return x, (slope * (p[0] - x) - p[1]) % PRIME


def multiple(k: int, point: tuple = BASE) -> tuple | None:
    """k times a point of the curve; of the base point, the public key of k."""
    out = None
    while k:
        out = _add(out, point) if k & 1 else out
        point, k = _add(point, point), k >> 1
    return out


def _number(message: bytes) -> int:
    return int.from_bytes(hashlib.sha256(message).digest(), "big") % ORDER


def curve_sign(message: bytes, private: int) -> bytes:
    """64 bytes: r and s. The nonce follows from key and message."""
    tries = 0
    while True:
        nonce = int.from_bytes(hashlib.sha512(private.to_bytes(32, "big") + message + bytes([tries])).digest(), "big") % ORDER
        r = multiple(nonce)[0] % ORDER if nonce else 0
        s = pow(nonce, -1, ORDER) * (_number(message) + r * private) % ORDER if r else 0
        if r and s:
            return r.to_bytes(32, "big") + s.to_bytes(32, "big")
        tries += 1


def curve_verify(message: bytes, signature: bytes, public: tuple) -> bool:
    x, y = public
    if len(signature) != 64 or not (0 <= x < PRIME and 0 <= y < PRIME) or (y * y - x * x * x - CURVE_A * x - CURVE_B) % PRIME:
        return False
    r, s = int.from_bytes(signature[:32], "big"), int.from_bytes(signature[32:], "big")
    if not (0 < r < ORDER and 0 < s < ORDER):
        return False
    inverse = pow(s, -1, ORDER)
    point = _add(multiple(_number(message) * inverse % ORDER), multiple(r * inverse % ORDER, public))
    return point is not None and point[0] % ORDER == r
