"""Archives and compressed streams."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from datetime import UTC, datetime

from nestlake.processors.aes import open_zip_entry
from nestlake.processors.base import Collector, Job, Malformed, Reader, Result, processor


@processor("ZIP", "Zip")
def unzip(job: Job) -> Result:
    try:
        z = zipfile.ZipFile(io.BytesIO(job.content))
    except zipfile.BadZipFile as e:
        raise Malformed(str(e)) from None
    out, got = Collector(job), Result()
    infos = z.infolist()
    secret = any(i.flag_bits & 1 for i in infos)
    got.metadata = {"num_entries": len(infos), "archive_comment": z.comment.decode("utf-8", "replace"), "has_encrypted_entries": secret, "zip64": b"PK\x06\x06" in job.content[-4096:]}
    opened = False
    for i in infos:
        if i.is_dir():
            continue
        meta = {"name": i.filename, "timestamp": _dos(i.date_time), "encrypted": bool(i.flag_bits & 1), "file_comment": i.comment.decode("utf-8", "replace"), "crc32": i.CRC,
                "compression_method": i.compress_type, "compressed_size": i.compress_size, "uncompressed_size": i.file_size}
        symbols: list[str] = []
        data = None
        aes = _aes(i)
        if aes:
            meta |= {"aes_strength": aes[0], "compression_method": aes[1]}
            for pw in job.passwords:
                try:
                    packed = open_zip_entry(_raw(job.content, i), aes[0], pw.encode())
                except (KeyError, struct.error, IndexError):
                    symbols += ["CORRUPTED", "ZIP_BAD"]
                    break
                if packed is not None:
                    try:
                        data = _plain(packed, aes[1], out.cap())
                    except (zlib.error, OSError, EOFError):
                        symbols += ["CORRUPTED"]
                    if data is None:
                        symbols.append("ZIP_UNSUP")
                    opened, meta["guessed_password"] = True, pw
                    symbols.append("DECRYPTED")
                    break
        for pw in () if aes else (None, *job.passwords) if not i.flag_bits & 1 else (*job.passwords, None):
            try:
                with z.open(i, pwd=pw.encode() if pw else None) as f:
                    data = f.read(out.cap())
                if i.flag_bits & 1:
                    opened, meta["guessed_password"] = True, pw
                    symbols.append("DECRYPTED")
                break
            except RuntimeError:
                continue
            except NotImplementedError:
                symbols.append("ZIP_UNSUP")
                break
            except (zipfile.BadZipFile, zlib.error, EOFError, OSError, struct.error) as e:
                symbols += ["CORRUPTED", "ZIP_BAD"] if "CRC" not in str(e) else ["CORRUPTED"]
                break
        if i.flag_bits & 1:
            symbols.append("ENCRYPTED")
        if data is not None and len(data) <= out.cap() - 1 and len(data) != i.file_size:
            symbols.append("ZIP_DSIZE_MISMATCH")
        if not out.add(data, meta, symbols=symbols):
            break
    got.symbols = out.symbols + (["ENCRYPTED"] if secret else []) + (["DECRYPTED"] if opened else [])
    got.children = out.children
    return got


def _aes(i: zipfile.ZipInfo) -> tuple[int, int] | None:
    """(strength, method of the packed bytes) of an entry under AES."""
    at = 0
    while i.compress_type == 99 and at + 4 <= len(i.extra):
        kind, size = struct.unpack_from("<HH", i.extra, at)
        if kind == 0x9901 and size >= 7:
            _, _, strength, method = struct.unpack_from("<H2sBH", i.extra, at + 4)
            return strength, method
        at += 4 + size
    return None


def _raw(content: bytes, i: zipfile.ZipInfo) -> bytes:
    name, extra = struct.unpack_from("<HH", content, i.header_offset + 26)
    at = i.header_offset + 30 + name + extra
    return content[at:at + i.compress_size]


def _plain(packed: bytes, method: int, cap: int) -> bytes | None:
    """None if the method is not one of stored, deflate and bzip2."""
    if method == 0:
        return packed[:cap]
    if method == 8:
        return zlib.decompressobj(-15).decompress(packed, cap)
    return bz2.BZ2Decompressor().decompress(packed, cap) if method == 12 else None


def _dos(t: tuple) -> float | None:
    try:
        return datetime(*t, tzinfo=UTC).timestamp()
    except ValueError:
        return None


@processor("TAR", "Tar")
def untar(job: Job) -> Result:
    magic = job.content[257:265]
    try:
        t = tarfile.open(fileobj=io.BytesIO(job.content), mode="r:", ignore_zeros=True)
    except tarfile.TarError as e:
        raise Malformed(str(e)) from None
    out = Collector(job)
    meta = {"has_devs": False, "has_links": False, "is_gnu": magic == b"ustar  \x00", "is_ustar": magic[:6] == b"ustar\x00"}
    for m in t:
        meta["has_devs"] |= m.isdev()
        meta["has_links"] |= m.issym() or m.islnk()
        if not m.isfile():
            continue
        f = t.extractfile(m)
        data = f.read(out.cap()) if f else None
        if not out.add(data, {"name": m.name, "mode": oct(m.mode)[2:], "uid": m.uid, "gid": m.gid, "user": m.uname or None, "group": m.gname or None, "time": m.mtime}):
            break
    return Result(meta, out.symbols, out.children)


@processor("GZIP", "Gzip")
def gunzip(job: Job) -> Result:
    data, members, body, symbols = job.content, [], [], []
    cap, size = job.limits.child_bytes, 0
    while data:
        if data[:2] != b"\x1f\x8b":
            if not members:
                raise Malformed("no gzip header")
            symbols.append("GZIP_TRAILING_GARBAGE")
            break
        if len(data) < 10:
            raise Malformed("input ends too early")
        flags, ts, extra_flags, os = data[3], struct.unpack("<I", data[4:8])[0], data[8], data[9]
        at = 10
        if flags & 4:
            at += 2 + struct.unpack("<H", data[at:at + 2])[0]
        name = None
        if flags & 8:
            end = data.index(b"\0", at)
            name, at = data[at:end].decode("latin-1"), end + 1
        members.append({"is_text": bool(flags & 1), "ts": float(ts), "extra_flags": extra_flags, "os": os, "has_extra": bool(flags & 4), "name": name, "has_comment": bool(flags & 16)})
        d = zlib.decompressobj(31)
        part = d.decompress(data, max(1, cap + 1 - size))
        body.append(part)
        size += len(part)
        if size > cap:
            break
        if not d.eof:
            raise Malformed("input ends too early")
        data = d.unused_data
    if len(members) > 1:
        symbols.append("GZIP_MULTI_MEMBER")
    out = Collector(job)
    out.add(b"".join(body), {"name": members[0]["name"]} if members[0]["name"] else {})
    meta = {"has_extra": any(m["has_extra"] for m in members), "has_name": any(m["name"] for m in members), "has_comment": any(m["has_comment"] for m in members), "members": members, "total_members": len(members)}
    return Result(meta, symbols + out.symbols, out.children)


def _stream(job: Job, make) -> Result:
    out, d = Collector(job), make()
    try:
        data = d.decompress(job.content, out.cap())
    except (OSError, lzma.LZMAError, ValueError) as e:
        raise Malformed(str(e)) from None
    if not d.eof and len(data) < out.cap():
        raise Malformed("input ends too early")
    out.add(data, {})
    return Result({}, out.symbols, out.children)


@processor("BZIP2", "Bzip2")
def bunzip2(job: Job) -> Result:
    return _stream(job, bz2.BZ2Decompressor)


@processor("LZMA", "XZ", "Lzma", "Xz")
def unlzma(job: Job) -> Result:
    return _stream(job, lzma.LZMADecompressor)


@processor("CAB", "Cab")
def uncab(job: Job) -> Result:
    r = Reader(job.content)
    if r.bytes(4) != b"MSCF":
        raise Malformed("no cabinet header")
    _, _, _, first, _, _, _, folders, files, flags, _, _ = r.get("IIIIIBBHHHHH")
    reserve_folder = reserve_data = 0
    if flags & 4:
        head, reserve_folder, reserve_data = r.get("HBB")
        r.bytes(head)
    for bit in (1, 2):
        if flags & bit:
            for _ in range(2):
                r.at = job.content.index(b"\0", r.at) + 1
    blocks = []
    for _ in range(folders):
        blocks.append(r.get("IHH"))
        r.bytes(reserve_folder)
    data = [_cab_folder(job.content, *b, reserve_data, job.limits.total_bytes) for b in blocks]
    out = Collector(job)
    r.at = first
    for _ in range(files):
        size, offset, folder, date, time, attributes = r.get("IIHHHH")
        end = job.content.index(b"\0", r.at)
        name = job.content[r.at:end].decode("utf-8" if attributes & 0x80 else "latin-1", "replace")
        r.at = end + 1
        content = data[folder][offset:offset + size] if folder < len(data) and data[folder] is not None else None
        if not out.add(content, {"name": name, "attributes": attributes, "date": date, "time": time, "size": size}, symbols=[] if content is not None else ["UNSUPPORTED"]):
            break
    return Result({"number_of_files": files, "number_of_folders": folders}, out.symbols, out.children)


def _cab_folder(content: bytes, at: int, n: int, method: int, reserve: int, most: int) -> bytes | None:
    """Data of a folder: stored or MSZIP; other methods give None."""
    if method & 15 > 1:
        return None
    r, out = Reader(content, at=at), b""
    for _ in range(n):
        _, packed, _ = r.get("IHH")
        r.bytes(reserve)
        part = r.bytes(packed)
        if method & 15 == 1:
            if part[:2] != b"CK":
                raise Malformed("bad block")
            part = zlib.decompressobj(-15, zdict=out[-32768:]).decompress(part[2:]) if out else zlib.decompressobj(-15).decompress(part[2:])
        out += part
        if len(out) > most:
            return None
    return out


@processor("ARJ", "Arj")
def unarj(job: Job) -> Result:
    r, out, meta, first = Reader(job.content), Collector(job), {}, True
    while True:
        if r.bytes(2) != b"\x60\xea":
            raise Malformed("no header")
        size = r.one("H")
        if not size:
            break
        head = r.bytes(size)
        r.bytes(4)
        while (more := r.one("H")):
            r.bytes(more + 4)
        n, _, _, host, flags, method = head[:6]
        names = head[n:].split(b"\0")
        name, comment = (x.decode("latin-1") for x in (names + [b"", b""])[:2])
        if first:
            meta, first = {"name": name, "comment": comment, "host_os": host}, False
            continue
        packed, original, crc = struct.unpack("<III", head[12:24])
        data = r.bytes(packed)
        symbols = []
        content = None if method or flags & 1 else data
        if method and not flags & 1:
            symbols.append("UNSUPPORTED")
        if content is not None and zlib.crc32(content) != crc:
            symbols.append("CORRUPTED")
        if not out.add(content, {"name": name, "comment": comment, "compressed_size": packed, "original_size": original, "crc": crc, "method": method}, symbols=symbols):
            break
    return Result(meta, out.symbols, out.children)


def _dstring(raw: bytes) -> str:
    """UDF text: the last byte is its length, the first the width of its characters."""
    n = min(raw[-1], len(raw) - 1)
    return raw[1:n].decode("utf-16-be" if raw[0] == 16 else "latin-1", "replace") if n else ""


def udf_volumes(c: bytes) -> list[dict]:
    """Primary volume descriptors of the sequence that the anchor in sector 256 points to."""
    anchor, out = c[256 * 2048:257 * 2048], []
    if len(anchor) < 24 or struct.unpack("<H", anchor[:2])[0] != 2:
        return out
    size, first = struct.unpack("<II", anchor[16:24])
    for k in range(min(size // 2048, 64)):
        d = c[(first + k) * 2048:(first + k + 1) * 2048]
        if len(d) < 2048 or (tag := struct.unpack("<H", d[:2])[0]) == 8:
            break
        if tag != 1:
            continue
        zone, year, month, day, hour, minute, second, centi = struct.unpack("<HhBBBBBB", d[376:386])
        offset = zone & 0xFFF
        offset = offset - 0x1000 if offset & 0x800 else offset
        stamp = f"{year:04d}-{month:02d}-{day:02d} {hour:02d}:{minute:02d}:{second:02d}.{centi:02d}"
        if zone >> 12 == 1 and -1440 <= offset <= 1440:
            stamp += f" {'-' if offset < 0 else '+'}{abs(offset) // 60:02d}:{abs(offset) % 60:02d}:00"
        out.append({"pv_identifier": _dstring(d[24:56]), "pv_seq": struct.unpack("<H", d[56:58])[0], "set_identifier": _dstring(d[72:200]),
                    "app_identifier": d[345:368].rstrip(b"\0").decode("latin-1"), "datetime": stamp if 1 <= month <= 12 else "INVALID"})
    return out


@processor("CDFS", "ISO", "Iso")
def iso9660(job: Job) -> Result:
    """ISO 9660 with Joliet names; of UDF volumes the primary descriptors."""
    c, descriptors, roots, symbols = job.content, [], [], []
    for sector in range(16, 64):
        d = c[sector * 2048:(sector + 1) * 2048]
        if len(d) < 2048:
            break
        tag = d[1:6]
        if tag in (b"NSR02", b"NSR03"):
            symbols.append("UDF")
        if tag != b"CD001":
            continue
        symbols.append("ISO9660")
        if d[0] in (1, 2):
            joliet = d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E")
            text = (lambda b: b.decode("utf-16-be", "replace").strip()) if joliet else (lambda b: b.decode("latin-1").strip(" \0"))
            descriptors.append({"type": d[0], "system_identifier": text(d[8:40]), "volume_identifier": text(d[40:72]), "volume_set_identifier": text(d[190:318]),
                                "publisher_identifier": text(d[318:446]), "application_identifier": text(d[574:702]), "creation_time": d[813:830].decode("latin-1").strip("\0 ")})
            roots.append((joliet, struct.unpack("<I", d[158:162])[0], struct.unpack("<I", d[166:170])[0]))
        if d[0] == 255:
            break
    if not descriptors and "UDF" not in symbols:
        raise Malformed("no volume descriptor")
    out = Collector(job)
    if roots:
        joliet, at, size = max(roots)
        stack, seen = [("", at, size)], set()
        while stack and not out.full:
            path, at, size = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            d, k = c[at * 2048:at * 2048 + size], 0
            while k < len(d):
                n = d[k]
                if not n:
                    k = (k // 2048 + 1) * 2048
                    continue
                e = d[k:k + n]
                k += n
                where, length, flags = struct.unpack("<I", e[2:6])[0], struct.unpack("<I", e[10:14])[0], e[25]
                raw = e[33:33 + e[32]]
                if raw in (b"\0", b"\1"):
                    continue
                name = (raw.decode("utf-16-be", "replace") if joliet else raw.decode("latin-1")).partition(";")[0]
                if flags & 2:
                    stack.append((f"{path}{name}/", where, length))
                else:
                    body = c[where * 2048:where * 2048 + length]
                    out.add(body if len(body) == length else None, {"name": path + name, "size": length}, symbols=[] if len(body) == length else ["CORRUPTED"])
    meta = {"volume_descriptors": descriptors} | ({"udf_volumes": udf_volumes(c)} if "UDF" in symbols else {})
    return Result(meta, symbols + out.symbols, out.children)


@processor("RAR", "Rar")
def unrar(job: Job) -> Result:
    """Blocks of RAR 4 archives; only stored entries are taken out."""
    c = job.content
    if c[:8] == b"Rar!\x1a\x07\x01\x00":
        return Result({"version": 5}, ["UNSUPPORTED"])
    if c[:7] != b"Rar!\x1a\x07\x00":
        raise Malformed("no RAR header")
    r, out, meta, symbols = Reader(c, at=7), Collector(job), {"version": 4}, []
    while r.at + 7 <= len(c):
        start = r.at
        _, kind, flags, size = r.get("HBHH")
        extra = r.one("I") if flags & 0x8000 and kind != 0x74 else 0
        if kind == 0x73:
            meta |= {"volume": bool(flags & 1), "comment": bool(flags & 2), "locked": bool(flags & 4), "solid": bool(flags & 8), "recovery": bool(flags & 0x40), "encrypted_headers": bool(flags & 0x80)}
            symbols += (["SOLID"] if flags & 8 else []) + (["ENCRYPTED"] if flags & 0x80 else [])
        if kind == 0x74:
            packed, unpacked, os, crc, ftime, version, method, nlen, attr = r.get("IIBIIBBHI")
            name = r.bytes(nlen).partition(b"\0")[0].decode("utf-8", "replace")
            body = c[start + size:start + size + packed]
            stored = method == 0x30 and not flags & 4
            child = ["ENCRYPTED"] if flags & 4 else [] if stored else ["UNSUPPORTED"]
            if stored and zlib.crc32(body) != crc:
                child.append("CHECKSUM_MISMATCH")
            if flags & 4:
                symbols.append("ENCRYPTED")
            if flags & 0xE0 != 0xE0:
                out.add(body if stored else None, {"name": name, "packed_size": packed, "size": unpacked, "crc": crc, "attributes": attr, "host_os": os, "method": method}, symbols=child)
            extra = packed
        if size < 7 or kind == 0x7B:
            break
        r.at = start + size + extra
    return Result(meta, symbols + out.symbols, out.children)



