"""7z archives: headers, packed or plain, and the entries of folders whose coders form one chain."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

from nestlake.processors.aes import open_sevenzip
from nestlake.processors.base import Collector, Job, Malformed, Reader, Result, filetime, processor

# Property ids of the format.
END, HEADER, PACK_INFO, UNPACK_INFO, SUBSTREAMS, SIZES, CRC, FOLDER, CODER_SIZES, COUNTS = 0, 1, 6, 7, 8, 9, 10, 11, 12, 13
STREAMS, FILES, EMPTY_STREAM, EMPTY_FILE, ANTI, NAMES, CREATED, ACCESSED, MODIFIED, ATTRIBUTES, ENCODED = 4, 5, 14, 15, 16, 17, 18, 19, 20, 21, 23
# Coder ids of the format that the standard library can undo.
CODERS = {b"\x00": "copy", b"\x21": "lzma2", b"\x03\x01\x01": "lzma", b"\x04\x01\x08": "deflate", b"\x04\x02\x02": "bzip2", b"\x03": "delta", b"\x03\x03\x01\x03": "x86", b"\x06\xf1\x07\x01": "aes"}


class _Archive(Reader):
    def number(self) -> int:
        """Leading ones of the first byte say how many bytes follow."""
        first, out, mask = self.one("B"), 0, 0x80
        for k in range(8):
            if not first & mask:
                return out | (first & (mask - 1)) << 8 * k
            out |= self.one("B") << 8 * k
            mask >>= 1
        return out

    def bits(self, n: int) -> list[bool]:
        raw = self.bytes((n + 7) // 8)
        return [bool(raw[k // 8] >> (7 - k % 8) & 1) for k in range(n)]

    def some(self, n: int) -> list[bool]:
        return [True] * n if self.one("B") else self.bits(n)

    def crcs(self, n: int) -> list[int | None]:
        return [self.one("I") if x else None for x in self.some(n)]

    def coders(self) -> dict:
        out, ins, outs = [], 0, 0
        for _ in range(self.number()):
            flags = self.one("B")
            name = self.bytes(flags & 15)
            i, o = (self.number(), self.number()) if flags & 16 else (1, 1)
            ins, outs = ins + i, outs + o
            out.append((CODERS.get(name), self.bytes(self.number()) if flags & 32 else b"", i, o))
        pairs = [(self.number(), self.number()) for _ in range(outs - 1)]
        packed = ins - len(pairs)
        if packed > 1:
            self.at += 0
            [self.number() for _ in range(packed)]
        return {"coders": out, "pairs": pairs, "packed": packed, "outs": outs, "chain": all(i == o == 1 for _, _, i, o in out)}

    def streams(self) -> dict:
        got: dict = {"at": 0, "sizes": [], "folders": [], "parts": None}
        while (kind := self.number()) != END:
            if kind == PACK_INFO:
                got["at"], n = self.number(), self.number()
                while (kind := self.number()) != END:
                    if kind == SIZES:
                        got["sizes"] = [self.number() for _ in range(n)]
                    elif kind == CRC:
                        self.crcs(n)
                    else:
                        raise Malformed("unexpected pack info")
            elif kind == UNPACK_INFO:
                if self.number() != FOLDER:
                    raise Malformed("no folders")
                n = self.number()
                if self.one("B"):
                    raise Malformed("folders elsewhere")
                got["folders"] = [self.coders() for _ in range(n)]
                while (kind := self.number()) != END:
                    if kind == CODER_SIZES:
                        for f in got["folders"]:
                            f["sizes"] = [self.number() for _ in range(f["outs"])]
                    elif kind == CRC:
                        for f, c in zip(got["folders"], self.crcs(n), strict=True):
                            f["crc"] = c
                    else:
                        raise Malformed("unexpected coder info")
            elif kind == SUBSTREAMS:
                got["parts"] = self.parts(got["folders"])
            else:
                raise Malformed("unexpected stream info")
        if got["parts"] is None:
            got["parts"] = [[(self.size_of(f), f.get("crc"))] for f in got["folders"]]
        return got

    @staticmethod
    def size_of(folder: dict) -> int:
        """Size of the output that no other coder takes in."""
        bound = {o for _, o in folder["pairs"]}
        return next(s for k, s in enumerate(folder["sizes"]) if k not in bound)

    def parts(self, folders: list[dict]) -> list[list[tuple[int, int | None]]]:
        counts, sizes, kind = [1] * len(folders), None, self.number()
        if kind == COUNTS:
            counts = [self.number() for _ in folders]
            kind = self.number()
        sizes = []
        for f, n in zip(folders, counts, strict=True):
            own = [self.number() for _ in range(n - 1)] if kind == SIZES else []
            sizes.append([*own, self.size_of(f) - sum(own)] if n else [])
        if kind == SIZES:
            kind = self.number()
        known = [n == 1 and f.get("crc") is not None for f, n in zip(folders, counts, strict=True)]
        found: list[int | None] = []
        if kind == CRC:
            found = self.crcs(sum(n for n, k in zip(counts, known, strict=True) if not k))
            kind = self.number()
        if kind != END:
            raise Malformed("unexpected substreams")
        rest = iter(found)
        return [[(s, f["crc"] if k else next(rest, None)) for s in own] for f, own, k in zip(folders, sizes, known, strict=True)]


def _opened(folder: dict, packed: bytes, limit: int, passwords: tuple[str, ...], parts: list | tuple = ()) -> tuple[bytes | None, str | None]:
    """(output, password): with encryption, of the first password whose output has the right checksums, its own or those
    of its parts, or unpacks where none is given."""
    if not any(c[0] == "aes" for c in folder["coders"]):
        return _undo(folder, packed, limit, None), None
    for pw in passwords:
        try:
            out = _undo(folder, packed, limit, pw)
        except (lzma.LZMAError, zlib.error, OSError, EOFError, IndexError):
            continue
        if out is not None and len(out) >= min(limit, _Archive.size_of(folder)) and folder.get("crc") in (None, zlib.crc32(out)) and _checked(out, parts):
            return out, pw
    return None, None


def _checked(out: bytes, parts: list | tuple) -> bool:
    at = 0
    for size, crc in parts:
        if crc is not None and at + size <= len(out) and zlib.crc32(out[at:at + size]) != crc:
            return False
        at += size
    return True


def _undo(folder: dict, packed: bytes, limit: int, password: str | None) -> bytes | None:
    """Output of a chain of coders; None if one of them cannot be undone here."""
    if not folder["chain"] or any(c[0] is None or (c[0] == "aes" and password is None) for c in folder["coders"]):
        return None
    order, at = [], next(k for k in range(len(folder["coders"])) if k not in {i for i, _ in folder["pairs"]})
    take = {o: i for i, o in folder["pairs"]}
    while True:  # from the packed stream to the last output
        order.append(at)
        if at not in take:
            break
        at = take[at]
    filters, data = [], packed
    for k in order:
        name, props, _, _ = folder["coders"][k]
        size = min(folder["sizes"][k], limit)
        if name == "copy":
            data = data[:size]
            continue
        if name == "aes":
            data = open_sevenzip(data, props, password)[:folder["sizes"][k]]
            continue
        if name in ("deflate", "bzip2"):
            data = zlib.decompressobj(-15).decompress(data, size) if name == "deflate" else bz2.BZ2Decompressor().decompress(data, size)
            continue
        if name == "lzma":
            lclppb, dictionary = props[0], struct.unpack("<I", props[1:5])[0]
            filters = [{"id": lzma.FILTER_LZMA1, "lc": lclppb % 9, "lp": lclppb // 9 % 5, "pb": lclppb // 45, "dict_size": max(dictionary, 4096)}]
        elif name == "lzma2":
            bits = props[0]
            filters = [{"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits >= 40 else (2 | bits & 1) << bits // 2 + 11}]
        else:  # liblzma has no chain that ends in these, so they go through an uncompressed LZMA2 stream
            own = {"id": lzma.FILTER_X86} if name == "x86" else {"id": lzma.FILTER_DELTA, "dist": props[0] + 1}
            stored = b"".join((b"\x01" if n == 0 else b"\x02") + struct.pack(">H", len(p) - 1) + p for n, p in ((n, data[n:n + 65536]) for n in range(0, len(data), 65536))) + b"\x00"
            data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[own, {"id": lzma.FILTER_LZMA2}]).decompress(stored, size)
            continue
        data = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size)
    return data


def _packed(content: bytes, s: dict, n: int) -> bytes:
    first = sum(f["packed"] for f in s["folders"][:n])
    at = 32 + s["at"] + sum(s["sizes"][:first])
    return content[at:at + sum(s["sizes"][first:first + s["folders"][n]["packed"]])]


def _files(r: _Archive) -> list[dict]:
    files: list[dict] = [{} for _ in range(r.number())]
    empty: list[int] = []
    while (kind := r.number()) != END:
        end = r.number() + r.at
        if kind == EMPTY_STREAM:
            for f, x in zip(files, r.bits(len(files)), strict=True):
                f["empty"] = x
            empty = [k for k, f in enumerate(files) if f["empty"]]
        elif kind in (EMPTY_FILE, ANTI):
            for k, x in zip(empty, r.bits(len(empty)), strict=True):
                files[k]["is_file" if kind == EMPTY_FILE else "is_anti_item"] = x
        elif kind == NAMES and not r.one("B"):
            for f, name in zip(files, r.bytes(end - r.at).decode("utf-16-le", "replace").split("\0"), strict=False):
                f["name"] = name
        elif kind in (CREATED, ACCESSED, MODIFIED, ATTRIBUTES):
            has = r.some(len(files))
            if not r.one("B"):
                for f, x in zip(files, has, strict=True):
                    if x:
                        f[kind] = r.one("I" if kind == ATTRIBUTES else "Q")
        r.at = end
    return files


@processor("7Z", "7z")
def sevenzip(job: Job) -> Result:
    r = Reader(job.content)
    if r.bytes(6) != b"7z\xbc\xaf\x27\x1c":
        raise Malformed("no 7z header")
    major, minor, crc, offset, size, header_crc = r.get("BBIQQI")
    header = job.content[32 + offset:32 + offset + size]
    if len(header) != size or zlib.crc32(header) != header_crc:
        raise Malformed("damaged header")
    out, meta, symbols, files, s = Collector(job), {"version": f"{major}.{minor}", "header_size": size}, [], [], None
    while header[:1] == bytes([ENCODED]):  # the header is packed as well
        inner = _Archive(header, at=1).streams()
        meta["encoded_header"] = True
        plain, pw = _opened(inner["folders"][0], _packed(job.content, inner, 0), job.limits.total_bytes, job.passwords)
        if pw is not None:
            symbols, meta["guessed_password"] = ["ENCRYPTED", "DECRYPTED"], pw
        if plain is None:
            aes = any(c[0] == "aes" for c in inner["folders"][0]["coders"])
            return Result(meta, ["ENCRYPTED"] if aes else ["UNSUPPORTED"])
        header = plain
    if header:
        a = _Archive(header)
        if a.number() != HEADER:
            raise Malformed("no header")
        while (kind := a.number()) != END:
            if kind == STREAMS:
                s = a.streams()
            elif kind == FILES:
                files = _files(a)
            elif kind == 2:  # archive properties
                while a.number() != END:
                    a.bytes(a.number())
            else:
                raise Malformed("unexpected header")
    folders = s["folders"] if s else []
    meta |= {"number_of_files": len(files), "solid": any(len(p) > 1 for p in s["parts"]) if s else False}
    slots = iter([(n, k) for n, own in enumerate(s["parts"] if s else []) for k in range(len(own))])
    plain: dict[int, bytes | None] = {}
    for f in files:
        about = {"name": f.get("name"), "creation_time": filetime(f.get(CREATED, 0)), "access_time": filetime(f.get(ACCESSED, 0)), "last_write_time": filetime(f.get(MODIFIED, 0)), "attributes": f.get(ATTRIBUTES), "is_anti_item": f.get("is_anti_item", False)}
        if f.get("empty"):
            if f.get("is_file") and not about["is_anti_item"] and not out.add(b"", about):
                break
            continue
        n, k = next(slots, (None, 0))
        if n is None:
            raise Malformed("more files than streams")
        if n not in plain:
            plain.clear()
            aes = any(c[0] == "aes" for c in folders[n]["coders"])
            symbols += ["ENCRYPTED"] if aes else []
            try:
                plain[n], pw = _opened(folders[n], _packed(job.content, s, n), job.limits.total_bytes + 1, job.passwords, s["parts"][n])
                if pw is not None:
                    symbols.append("DECRYPTED")
                    meta["guessed_password"] = pw
            except (lzma.LZMAError, zlib.error, OSError, EOFError):
                plain[n] = b""
                symbols.append("CORRUPTED")
        own = s["parts"][n]
        size, crc = own[k]
        first = sum(x for x, _ in own[:k])
        body = plain[n]
        child = [] if body is not None else ["ENCRYPTED" if "ENCRYPTED" in symbols else "UNSUPPORTED"]
        if body is not None:
            whole = body[first:first + size]
            if len(whole) < size:
                whole = None
                child.append("TOOBIG" if len(body) > job.limits.total_bytes else "CORRUPTED")
            elif crc is not None and zlib.crc32(whole) != crc:
                child.append("CHECKSUM_MISMATCH")
            body = whole
        if not out.add(body, about | {"size": size, "crc": crc}, symbols=child):
            break
    return Result(meta, symbols + out.symbols, out.children)
