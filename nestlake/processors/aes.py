"""AES (FIPS 197) over many blocks at once, for archives: counter mode of ZIP, block chaining of 7z."""

from __future__ import annotations

import functools
import hashlib
import hmac

import numpy as np


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a * (b & 1)
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Substitution, its inverse, and products by the constants of the two mixing steps."""
    box = np.zeros(256, np.uint8)
    inverse = {a: b for a in range(1, 256) for b in range(1, 256) if _times(a, b) == 1}
    for a in range(256):
        x = inverse.get(a, 0)
        box[a] = x ^ 0x63 ^ functools.reduce(lambda s, k: s ^ ((x << k | x >> (8 - k)) & 255), range(1, 5), 0)
    return box, np.argsort(box).astype(np.uint8), {c: np.array([_times(a, c) for a in range(256)], np.uint8) for c in (1, 2, 3, 9, 11, 13, 14)}


@functools.lru_cache(64)
def _round_keys(key: bytes) -> np.ndarray:
    box = _tables()[0]
    n, words = len(key) // 4, [list(key[k:k + 4]) for k in range(0, len(key), 4)]
    factor = 1
    for k in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if k % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= factor
            factor = _times(factor, 2)
        elif n > 6 and k % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(w, words[k - n], strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


_TURN = np.array([(r + 4 * ((c + r) % 4)) for c in range(4) for r in range(4)])
_BACK = np.argsort(_TURN)


def _mixed(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    """Each column times the circulant matrix of the factors."""
    product = _tables()[2]
    cols = s.reshape(-1, 4, 4)
    out = np.empty_like(cols)
    for r in range(4):
        out[:, :, r] = functools.reduce(np.bitwise_xor, (product[factors[(c - r) % 4]][cols[:, :, c]] for c in range(4)))
    return out.reshape(-1, 16)


def encrypt(blocks: np.ndarray, key: bytes) -> np.ndarray:
    """blocks: n x 16 bytes."""
    keys, box = _round_keys(key), _tables()[0]
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = _mixed(box[s][:, _TURN], (2, 3, 1, 1)) ^ k
    return box[s][:, _TURN] ^ keys[-1]


def decrypt(blocks: np.ndarray, key: bytes) -> np.ndarray:
    keys, back = _round_keys(key), _tables()[1]
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(back[s[:, _BACK]] ^ k, (14, 11, 13, 9))
    return back[s[:, _BACK]] ^ keys[0]


def zip_counter(data: bytes, key: bytes) -> bytes:
    """Counter mode with a little-endian counter from 1; its own inverse."""
    n = -(-len(data) // 16)
    counter = np.zeros((n, 2), "<u8")
    counter[:, 0] = np.arange(1, n + 1)
    stream = encrypt(counter.view(np.uint8).reshape(n, 16), key).tobytes() if n else b""
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8)[:len(data)]).tobytes()


def open_zip_entry(raw: bytes, strength: int, password: bytes) -> bytes | None:
    """The packed bytes of an entry: salt, check value, cipher text and authentication code; None for a wrong password."""
    size = {1: 16, 2: 24, 3: 32}[strength]
    salt, check, body, code = raw[:size // 2], raw[size // 2:size // 2 + 2], raw[size // 2 + 2:-10], raw[-10:]
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * size + 2)
    if keys[2 * size:] != check or hmac.new(keys[size:2 * size], body, "sha1").digest()[:10] != code:
        return None
    return zip_counter(body, keys[:size])


@functools.lru_cache(64)
def _sevenzip_key(password: bytes, salt: bytes, power: int) -> bytes:
    if power == 63:
        return (salt + password).ljust(32, b"\0")[:32]
    h, step = hashlib.sha256(), 4096
    for first in range(0, 1 << power, step):  # the counter is hashed behind the password each time
        h.update(b"".join(salt + password + n.to_bytes(8, "little") for n in range(first, min(first + step, 1 << power))))
    return h.digest()


def open_sevenzip(data: bytes, props: bytes, password: str) -> bytes:
    """Block chaining with the key, salt and start block that a coder's properties describe; the end may be padding."""
    first, second = props[0], props[1] if len(props) > 1 else 0
    salt_size, iv_size = (first >> 7 & 1) + (second >> 4), (first >> 6 & 1) + (second & 15)
    salt, iv = props[2:2 + salt_size], props[2 + salt_size:2 + salt_size + iv_size].ljust(16, b"\0")
    blocks = np.frombuffer(data[:len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]]) if len(blocks) else blocks
    return (decrypt(blocks, _sevenzip_key(password.encode("utf-16-le"), salt, first & 63)) ^ before).tobytes()
