import hashlib
import hmac
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
import test_sevenzip as Z

from nestlake.processors import Job, run
from nestlake.processors import aes


def test_published_vectors():
    """The example vectors of the standard."""
    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None]
    for size, cipher in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        got = aes.encrypt(plain, bytes(range(size)))
        assert got.tobytes().hex() == cipher and aes.decrypt(got, bytes(range(size))).tobytes() == plain.tobytes()


def aes_zip(body, password, strength, method):
    size, salt = {1: 16, 2: 24, 3: 32}[strength], bytes(range({1: 8, 2: 12, 3: 16}[strength]))
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = d.compress(body) + d.flush() if method == 8 else body
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * size + 2)
    cipher = aes.zip_counter(packed, keys[:size])
    raw = salt + keys[2 * size:] + cipher + hmac.new(keys[size:2 * size], cipher, "sha1").digest()[:10]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("s.txt"), raw)
    made = bytearray(out.getvalue())
    extra = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", strength, method)
    local = made.index(b"PK\x01\x02")
    head = made[:local]
    head[6:10] = struct.pack("<HH", 1, 99)
    head[22:26], head[28:30] = struct.pack("<I", len(body)), struct.pack("<H", len(extra))
    head[35:35] = extra
    tail = made[local:]
    tail[8:12] = struct.pack("<HH", 1, 99)
    tail[24:28], tail[30:32] = struct.pack("<I", len(body)), struct.pack("<H", len(extra))
    tail[51:51] = extra
    end = tail.index(b"PK\x05\x06")
    tail[end + 12:end + 20] = struct.pack("<II", end, len(head))
    return bytes(head + tail)


@pytest.mark.parametrize(("strength", "method"), [(1, 0), (2, 8), (3, 8)])
def test_zip_under_aes(strength, method):
    body = b"secret words " * 99
    z = aes_zip(body, b"pw1", strength, method)
    r = run(Job(z, "ZIP", passwords=("no", "pw1")))
    assert r.children[0].content == body and r.children[0].relation["guessed_password"] == "pw1" and {"ENCRYPTED", "DECRYPTED"} <= set(r.symbols)
    shut = run(Job(z, "ZIP", passwords=("no",)))
    assert shut.children[0].content is None and "DECRYPTED" not in shut.symbols and "ENCRYPTED" in shut.symbols


def test_sevenzip_under_aes(monkeypatch):
    iv, salt, power, pw = bytes(range(16)), b"salt", 8, "pässword"
    key = aes._sevenzip_key(pw.encode("utf-16-le"), salt, power)
    h = hashlib.sha256()
    for n in range(1 << power):
        h.update(salt + pw.encode("utf-16-le") + struct.pack("<Q", n))
    assert key == h.digest()

    def chained(body):
        out, last = b"", np.frombuffer(iv, np.uint8)
        for k in range(0, len(body), 16):
            last = aes.encrypt((np.frombuffer(body[k:k + 16].ljust(16, b"\0"), np.uint8) ^ last)[None], key)[0]
            out += last.tobytes()
        return out

    props = bytes([power | 0xC0, (len(salt) - 1) << 4 | 15]) + salt + iv
    monkeypatch.setitem(Z.FILTERS, "aes", (None, [(b"\x06\xf1\x07\x01", props)]))
    monkeypatch.setattr(Z, "squeeze", lambda kind, body, old=Z.squeeze: chained(body) if kind == "aes" else old(kind, body))
    r = run(Job(Z.archive("aes", Z.BODIES), "7Z", passwords=("x", pw)))
    assert {c.relation["name"]: c.content for c in r.children} == Z.BODIES and r.error is None and "DECRYPTED" in r.symbols
    assert run(Job(Z.archive("aes", Z.BODIES), "7Z")).children[0].content is None
