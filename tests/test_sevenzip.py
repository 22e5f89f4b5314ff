"""7z archives made here by the published format, read back."""

import lzma
import struct
import zlib

import pytest

from nestlake.processors import Job, Limits, run


def number(n):
    for k in range(8):
        if n < 1 << 7 * (k + 1):
            return bytes([(0xFF << (8 - k)) & 0xFF | n >> 8 * k]) + (n & (1 << 8 * k) - 1).to_bytes(k, "little")
    return b"\xff" + n.to_bytes(8, "little")


FILTERS = {
    "lzma2": ([{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}], [(b"\x21", b"\x10")]),
    "lzma": ([{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}], [(b"\x03\x01\x01", bytes([93]) + struct.pack("<I", 1 << 20))]),
    "x86": ([{"id": lzma.FILTER_X86}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}], [(b"\x03\x03\x01\x03", b""), (b"\x21", b"\x10")]),
    "delta": ([{"id": lzma.FILTER_DELTA, "dist": 2}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}], [(b"\x03", b"\x01"), (b"\x21", b"\x10")]),
    "copy": (None, [(b"\x00", b"")]), "aes": (None, [(b"\x06\xf1\x07\x01", b"\x13\x00")]), "strange": (None, [(b"\x7f\x01", b"")]),
}


def streams(kind, packed, plain, at, parts=None):
    coders = FILTERS[kind][1]
    folder = number(len(coders)) + b"".join(bytes([len(i) | (0x20 if p else 0)]) + i + (number(len(p)) + p if p else b"") for i, p in coders)
    folder += b"".join(number(k) + number(k + 1) for k in range(len(coders) - 1))  # the output of the next goes into this one
    out = b"\x06" + number(at) + number(1) + b"\x09" + number(len(packed)) + b"\x00"
    out += b"\x07\x0b" + number(1) + b"\x00" + folder + b"\x0c" + b"".join(number(len(plain)) for _ in coders)
    if parts is None:
        return out + b"\x0a\x01" + struct.pack("<I", zlib.crc32(plain)) + b"\x00\x00"
    out += b"\x00\x08\x0d" + number(len(parts)) + b"\x09" + b"".join(number(len(p)) for p in parts[:-1])
    return out + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(p)) for p in parts) + b"\x00\x00"


def squeeze(kind, body):
    filters = FILTERS[kind][0]
    return lzma.compress(body, lzma.FORMAT_RAW, filters=filters) if filters else body


def archive(kind, files, folders=("empty",), packed_header=False):
    bodies = list(files.values())
    plain = b"".join(bodies)
    packed = squeeze(kind, plain)
    n = len(files) + len(folders)
    names = b"\x00" + b"".join(x.encode("utf-16-le") + b"\0\0" for x in [*files, *folders])
    flags = [False] * len(files) + [True] * len(folders)
    bits = bytes(sum(x << (7 - k) for k, x in enumerate(flags[o:o + 8])) for o in range(0, n, 8))
    times = b"\x01\x00" + struct.pack("<Q", 132_380_784_000_000_000) * n
    head = b"\x01\x04" + streams(kind, packed, plain, 0, bodies) + b"\x05" + number(n)
    head += b"\x0e" + number(len(bits)) + bits + b"\x11" + number(len(names)) + names + b"\x14" + number(len(times)) + times + b"\x00\x00"
    body = packed
    if packed_header:
        small = squeeze("lzma", head)
        head, body = b"\x17" + streams("lzma", small, head, len(packed)), packed + small
    start = struct.pack("<QQI", len(body), len(head), zlib.crc32(head))
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + head


BODIES = {"a.txt": b"alpha " * 500, "dir/b.bin": bytes(range(256)) * 9, "c": b"\xe8\x00\x10\x00\x00" * 40}


@pytest.mark.parametrize("kind", ["lzma2", "lzma", "x86", "delta", "copy"])
@pytest.mark.parametrize("packed_header", [False, True])
def test_entries(kind, packed_header):
    r = run(Job(archive(kind, BODIES, packed_header=packed_header), "7Z"))
    assert r.error is None and {c.relation["name"]: c.content for c in r.children} == BODIES and not r.symbols
    assert r.metadata["number_of_files"] == 4 and r.metadata["solid"] and r.children[0].relation["last_write_time"] == 1593604800.0


def test_what_cannot_be_read_is_said():
    for kind, symbol in (("aes", "ENCRYPTED"), ("strange", "UNSUPPORTED")):
        r = run(Job(archive(kind, BODIES), "7Z"))
        assert all(c.content is None and c.symbols == [symbol] for c in r.children) and len(r.children) == 3
    broken = bytearray(archive("copy", BODIES))
    broken[40] ^= 1
    assert run(Job(bytes(broken), "7Z")).children[0].symbols == ["CHECKSUM_MISMATCH"]
    assert run(Job(bytes(broken[:-3]), "7Z")).error and run(Job(b"7z\xbc\xaf\x27\x1c", "7Z")).error
    small = run(Job(archive("lzma2", BODIES), "7Z", limits=Limits(child_bytes=1000)))
    assert [c.content is None for c in small.children] == [True, True, False] and "LIMITS_REACHED" in small.symbols
    assert run(Job(archive("lzma2", {"one": b""}), "7Z")).children[0].content == b""


def test_numbers():
    from nestlake.processors.sevenzip import _Archive

    for n in (0, 1, 127, 128, 16383, 16384, 10**6, 2**35, 2**56 - 1, 2**63):
        assert _Archive(number(n)).number() == n
