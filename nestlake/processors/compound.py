"""Office documents, old and new, Outlook messages, installers and PDF."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

from nestlake.processors.base import Collector, Job, Malformed, Reader, Result, filetime, guid, processor
from nestlake.processors.texts import URI, hosts_of

FREE = 0xFFFFFFFA


class Compound:
    """Reader of compound files: a directory of storages and streams inside one file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise Malformed("no compound file header")
        self.data = data
        r = Reader(data)
        self.sector, self.mini = 1 << r.one("H", 30), 1 << r.one("H", 32)
        if not 7 <= self.sector.bit_length() - 1 <= 20:
            raise Malformed("bad sector size")
        self.cutoff = r.one("I", 56)
        fats = list(r.get("109I", 76))
        at, n = r.one("I", 68), 0
        while at < FREE and n < 100_000:
            block = struct.unpack(f"<{self.sector // 4}I", self._sector(at))
            fats += block[:-1]
            at, n = block[-1], n + 1
        self.fat = [x for f in fats if f < FREE for x in struct.unpack(f"<{self.sector // 4}I", self._sector(f))]
        minifat = self._chain(r.one("I", 60))
        self.minifat = struct.unpack(f"<{len(minifat) // 4}I", minifat)
        directory = self._chain(r.one("I", 48))
        self.entries = []
        for k in range(0, len(directory) - 127, 128):
            e = directory[k:k + 128]
            n = max(min(struct.unpack("<H", e[64:66])[0] - 2, 62), 0)
            left, right, child = struct.unpack("<III", e[68:80])
            start, size = struct.unpack("<IQ", e[116:128])
            self.entries.append((e[:n].decode("utf-16-le", "replace"), e[66], left, right, child, start, size & 0xFFFFFFFF, e[80:96]))
        if not self.entries:
            raise Malformed("no directory")
        self.ministream = self._chain(self.entries[0][5])
        self.paths: dict[str, int] = {}
        self._walk(self.entries[0][4], "")

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.sector
        out = self.data[at:at + self.sector]
        return out + b"\0" * (self.sector - len(out))

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < FREE and at not in seen and at < len(self.fat):
            seen.add(at)
            out.append(self._sector(at))
            at = self.fat[at]
        return b"".join(out)

    def _walk(self, root: int, prefix: str) -> None:
        stack, seen = [(root, prefix)], set()
        while stack:
            k, prefix = stack.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, left, right, child, *_ = self.entries[k]
            stack += [(left, prefix), (right, prefix)]
            if kind == 1:
                stack.append((child, f"{prefix}{name}/"))
            elif kind == 2:
                self.paths[prefix + name] = k

    def read(self, path: str) -> bytes:
        *_, start, size, _ = self.entries[self.paths[path]]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < FREE and start not in seen and start < len(self.minifat):
            seen.add(start)
            out.append(self.ministream[start * self.mini:(start + 1) * self.mini])
            start = self.minifat[start]
        return b"".join(out)[:size]


# Numbers of summary properties.
SUMMARY = {1: "codepage", 2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 7: "template", 8: "last_author", 9: "revision", 12: "created", 13: "saved", 14: "pages", 15: "words", 18: "application"}


def summary(data: bytes) -> dict:
    """Properties of a summary stream that have a name here."""
    r = Reader(data)
    at = r.one("I", 44)
    n, page, out = r.one("I", at + 4), "cp1252", {}
    for k in range(min(n, 256)):
        pid, off = r.get("II", at + 8 + 8 * k)
        kind, pos = r.one("I", at + off) & 0xFFFF, at + off + 4
        value: object = None
        if kind == 2:
            value = r.one("h", pos) & 0xFFFF
            if pid == 1:
                page = "utf-8" if value == 65001 else f"cp{value}"
        elif kind == 3:
            value = r.one("i", pos)
        elif kind in (30, 31):
            size = r.one("I", pos)
            raw = data[pos + 4:pos + 4 + size * (2 if kind == 31 else 1)]
            try:
                value = raw.decode("utf-16-le" if kind == 31 else page, "replace").rstrip("\0")
            except LookupError:
                value = raw.decode("cp1252", "replace").rstrip("\0")
        elif kind == 64:
            value = filetime(r.one("Q", pos))
        if pid in SUMMARY and value is not None:
            out[SUMMARY[pid]] = value
    return out


def decompress_vba(data: bytes) -> bytes:
    """Source text of a macro module: runs of literals and back references in chunks of 4 KiB."""
    if not data or data[0] != 1:
        raise Malformed("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack("<H", data[at:at + 2])[0]
        end = min(at + (head & 0xFFF) + 3, len(data))
        at += 2
        start = len(out)
        if not head & 0x8000:
            out += data[at:at + 4096]
            at = end
            continue
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    at = end
                    break
                token = struct.unpack("<H", data[at:at + 2])[0]
                at += 2
                bits = max((len(out) - start - 1).bit_length(), 4)
                back, n = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                if back > len(out):
                    raise Malformed("bad reference")
                for _ in range(n):
                    out.append(out[-back])
    return bytes(out)


def _macros(c: Compound, out: Collector) -> list[str]:
    symbols = []
    folders = {p.rpartition("/")[0] for p in c.paths if p.lower().endswith("vba/dir")}
    for folder in sorted(folders):
        symbols.append("VBA")
        try:
            directory = decompress_vba(c.read(f"{folder}/dir"))
        except Malformed:
            symbols.append("CORRUPTED_VBA")
            continue
        name = None
        at = 0
        while at + 6 <= len(directory):
            kind, size = struct.unpack("<HI", directory[at:at + 6])
            if kind == 9:
                size = 6
            body = directory[at + 6:at + 6 + size]
            if kind == 0x19:
                name = body.decode("cp1252", "replace")
            if kind == 0x31 and name and len(body) == 4:
                path = next((p for p in c.paths if p.lower() == f"{folder}/{name}".lower()), None)
                try:
                    text = decompress_vba(c.read(path)[struct.unpack("<I", body)[0]:]) if path else None
                    out.add(text, {"name": name}, "Text", ["VBA"] if path else ["VBA", "NOT_FOUND"])
                except Malformed:
                    out.add(None, {"name": name}, "Text", ["VBA", "CORRUPTED"])
            at += 6 + size
    return symbols


@processor("Office", "DOC", "XLS", "PPT")
def office(job: Job) -> Result:
    return ooxml(job) if job.content[:2] == b"PK" else ole(job)


def ole(job: Job) -> Result:
    c, out = Compound(job.content), Collector(job)
    symbols, meta = ["OLE"], {"streams": sorted(c.paths)}
    for name, key in (("\x05SummaryInformation", "properties"), ("\x05DocumentSummaryInformation", "document_properties")):
        if name in c.paths:
            try:
                meta[key] = summary(c.read(name))
            except Malformed:
                symbols.append("CORRUPTED")
    for stream, tag in (("WordDocument", "DOC"), ("Workbook", "XLS"), ("Book", "XLS"), ("PowerPoint Document", "PPT"), ("EncryptedPackage", "ENCRYPTED")):
        if stream in c.paths:
            symbols.append(tag)
    if "WordDocument" in c.paths:
        head = c.read("WordDocument")
        if len(head) > 12 and struct.unpack("<H", head[10:12])[0] & 0x100:
            symbols.append("ENCRYPTED")
    symbols += _macros(c, out)
    for p in sorted(c.paths):
        if p.endswith("\x01Ole10Native") or p.endswith("/CONTENTS") or p.endswith("/Package"):
            raw = c.read(p)
            out.add(raw[4:] if p.endswith("Native") else raw, {"name": p})
    return Result(meta, symbols + out.symbols, out.children)


def _package(job: Job) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(job.content))
    except zipfile.BadZipFile as e:
        raise Malformed(str(e)) from None


def _xml(z: zipfile.ZipFile, name: str, cap: int) -> ElementTree.Element | None:
    try:
        with z.open(name) as f:
            raw = f.read(cap + 1)
        return ElementTree.fromstring(raw) if len(raw) <= cap and b"<!ENTITY" not in raw[:4096] else None
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, RuntimeError, zlib.error):
        return None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(root: ElementTree.Element, paragraph: set[str], text: set[str]) -> str:
    out: list[str] = []
    for e in root.iter():
        if _local(e) in paragraph:
            out.append("\n")
        elif _local(e) in text and e.text:
            out.append(e.text)
    return "".join(out).strip()


@processor("DOCX", "XLSX", "PPTX")
def ooxml(job: Job) -> Result:
    z, out, cap = _package(job), Collector(job), job.limits.child_bytes
    names = z.namelist()
    kind = next((k for k, p in (("DOCX", "word/"), ("XLSX", "xl/"), ("PPTX", "ppt/")) if any(n.startswith(p) for n in names)), None)
    if kind is None:
        raise Malformed("no office package")
    if "xl/workbook.bin" in names:
        kind = "XLSB"
    meta: dict = {"properties": {}, "external_resources": [], "hyperlinks": [], "sheets": []}
    for part in ("docProps/core.xml", "docProps/app.xml"):
        root = _xml(z, part, cap)
        for e in root.iter() if root is not None else ():
            if e.text and e.text.strip() and not len(e):
                meta["properties"][_local(e)] = e.text.strip()
    custom = _xml(z, "docProps/custom.xml", cap)
    if custom is not None:
        meta["user_properties"] = {p.get("name", ""): "".join(p.itertext()).strip() for p in custom}
    for n in names:
        if n.endswith(".rels"):
            root = _xml(z, n, cap)
            for r in root if root is not None else ():
                if r.get("TargetMode") == "External":
                    meta["hyperlinks" if r.get("Type", "").endswith("/hyperlink") else "external_resources"].append(r.get("Target", ""))
    book = _xml(z, "xl/workbook.xml", cap)
    for e in book.iter() if book is not None else ():
        if _local(e) == "sheet":
            meta["sheets"].append({"name": e.get("name"), "state": e.get("state", "visible")})
    symbols = [kind]
    body = []
    for n in sorted(names):
        if n == "word/document.xml" or re.fullmatch(r"ppt/slides/slide\d+\.xml|xl/sharedStrings\.xml", n):
            root = _xml(z, n, cap)
            if root is None:
                symbols.append("CORRUPTED")
            else:
                body.append(_texts(root, {"p", "si", "br"}, {"t"}))
    if any(body):
        out.add("\n".join(body).encode(), {"name": "text"}, "Text")
    for n in sorted(names):
        if n.endswith("vbaProject.bin"):
            symbols += _macros(Compound(z.read(n)), out)
        elif "/media/" in n or "/embeddings/" in n:
            with z.open(n) as f:
                out.add(f.read(out.cap()), {"name": n})
        elif "/macrosheets/" in n:
            symbols.append("HAS_MACRO_SHEET")
    meta["hyperlinks"], meta["external_resources"] = sorted(set(meta["hyperlinks"])), sorted(set(meta["external_resources"]))
    for d in hosts_of(meta["hyperlinks"])[1]:
        out.add(d.encode(), {"name": d}, "Domain")
    return Result(meta, symbols + out.symbols, out.children)


@processor("ODF", "ODT", "ODS")
def odf(job: Job) -> Result:
    z, out, cap = _package(job), Collector(job), job.limits.child_bytes
    names = z.namelist()
    if "content.xml" not in names:
        raise Malformed("no content")
    mime = z.read("mimetype").decode("latin-1") if "mimetype" in names else ""
    symbols = ["ODT"] if mime.endswith(".text") else ["ODS"] if mime.endswith(".spreadsheet") else []
    meta: dict = {"properties": {}, "user_properties": {}, "hyperlinks": [], "file_entry": []}
    manifest = _xml(z, "META-INF/manifest.xml", cap)
    if manifest is not None:
        meta["manifest_version"] = next((v for k, v in manifest.attrib.items() if k.endswith("}version")), None)
        for e in manifest:
            meta["file_entry"].append({k.rpartition("}")[2]: v for k, v in e.attrib.items()})
            if any(_local(x) == "encryption-data" for x in e):
                symbols.append("ENCRYPTED")
    info = _xml(z, "meta.xml", cap)
    for e in info.iter() if info is not None else ():
        if _local(e) == "user-defined":
            meta["user_properties"][next((v for k, v in e.attrib.items() if k.endswith("}name")), "")] = e.text
        elif e.text and e.text.strip() and not len(e):
            meta["properties"][_local(e)] = e.text.strip()
    root = _xml(z, "content.xml", cap)
    if root is not None:
        lines = ["".join(e.itertext()) for e in root.iter() if _local(e) in ("p", "h")]
        if any(lines):
            out.add("\n".join(lines).strip().encode(), {"name": "text"}, "Text")
        meta["hyperlinks"] = sorted({v for e in root.iter() if _local(e) == "a" for k, v in e.attrib.items() if k.endswith("}href")})
    for n in names:
        if n.startswith(("Pictures/", "Object", "media/")) and not n.endswith("/") and "ENCRYPTED" not in symbols:
            with z.open(n) as f:
                out.add(f.read(out.cap()), {"name": n})
    for d in hosts_of(meta["hyperlinks"])[1]:
        out.add(d.encode(), {"name": d}, "Domain")
    return Result(meta, symbols + out.symbols, out.children)


def _property(c: Compound, prefix: str, tag: str) -> str | bytes | None:
    for kind, code in (("001F", "utf-16-le"), ("001E", "cp1252"), ("0102", None)):
        path = f"{prefix}__substg1.0_{tag}{kind}"
        if path in c.paths:
            raw = c.read(path)
            return raw.decode(code, "replace") if code else raw
    return None


@processor("MSG")
def outlook(job: Job) -> Result:
    c, out, symbols = Compound(job.content), Collector(job), []
    folders = {p.partition("/")[0] for p in c.paths if "/" in p}
    meta: dict = {"subject": _property(c, "", "0037"), "from": {"name": _property(c, "", "0C1A"), "email": _property(c, "", "0C1F")}, "headers": _property(c, "", "007D"),
                  "recipients": [{"name": _property(c, f"{f}/", "3001"), "email": _property(c, f"{f}/", "3003")} for f in sorted(folders) if f.startswith("__recip")], "attachments_by_ref": []}
    for tag, name, force in (("1000", "text", "Text"), ("1013", "html", "HTML"), ("1009", "rtf", None)):
        body = _property(c, "", tag)
        meta[f"has_{name}_body"] = body is not None
        if body is not None:
            symbols.append(f"MSG_{name.upper()}_BODY")
            out.add(body.encode() if isinstance(body, str) else body, {"name": f"body.{name}"}, force)
    attached = [f for f in sorted(folders) if f.startswith("__attach")]
    meta["n_attachments"] = len(attached)
    for f in attached:
        data = _property(c, f"{f}/", "3701")
        name = _property(c, f"{f}/", "3707") or _property(c, f"{f}/", "3704")
        out.add(data if isinstance(data, bytes) else None, {"name": name, "mime_type": _property(c, f"{f}/", "370E")}, symbols=[] if data is not None else ["NOT_FOUND"])
    return Result(meta, symbols + out.symbols, out.children)


@processor("MSI")
def installer(job: Job) -> Result:
    c, out = Compound(job.content), Collector(job)
    meta = {"is_signed": "\x05DigitalSignature" in c.paths, "clsid": guid(c.entries[0][7])}
    if "\x05SummaryInformation" in c.paths:
        s = summary(c.read("\x05SummaryInformation"))
        meta |= {k: s.get(k) for k in ("codepage", "title", "subject", "author")} | {"uuid": s.get("revision"), "timestamp": s.get("created")}
        arch, _, languages = str(s.get("template", "")).partition(";")
        meta |= {"arch": arch or None, "languages": [x for x in languages.split(",") if x]}
    for p in sorted(c.paths):
        if not p.startswith("\x05") and not out.add(c.read(p), {"name": _msi_name(p)}):
            break
    return Result(meta, out.symbols, out.children)


def _msi_name(name: str) -> str:
    """Stream names pack two characters of a 64-letter alphabet into one."""
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._"
    out = []
    for ch in name:
        v = ord(ch)
        if 0x3800 <= v < 0x4800:
            out += [letters[v - 0x3800 & 63], letters[v - 0x3800 >> 6]]
        elif 0x4800 <= v < 0x4840:
            out.append(letters[v - 0x4800])
        elif v != 0x4840:
            out.append(ch)
    return "".join(out)


_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>|\b(?:Tj|TJ|Td|TD|T\*|BT|ET)\b|['\"]", re.S)
# Escapes of literal strings.
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def shown_text(stream: bytes) -> str:
    """Text that a content stream shows, as far as its fonts use a plain encoding; a line for each move to a new one."""
    out, held = [], []
    for m in _SHOWN.finditer(stream):
        t = m[0]
        if t[:1] == b"(":
            held.append(re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else _PDF_ESCAPES.get(e[1], b"" if e[1].strip() == b"" else e[1]), t[1:-1], flags=re.S))
        elif t[:1] == b"<":
            raw = re.sub(rb"\s", b"", t[1:-1])
            held.append(bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode()))
        else:
            if t in (b"Tj", b"TJ", b"'", b'"'):
                out.append(b"".join(held).decode("cp1252", "replace"))
            elif out and out[-1] != "\n":
                out.append("\n")
            held = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


@processor("PDF")
def pdf(job: Job) -> Result:
    """What plain and deflated objects tell without a renderer: version, counts, links, scripts, and issues of the frame."""
    c, issues = job.content, []
    m = re.search(rb"%PDF-(\d\.\d)", c[:1024])
    if not m:
        raise Malformed("no PDF header")
    if b"%%EOF" not in c[-2048:]:
        issues.append("no end marker")
    if b"startxref" not in c[-4096:]:
        issues.append("no cross-reference offset")
    parts, files, limited, left = [c], [], False, job.limits.total_bytes
    for s in re.finditer(rb"stream\r?\n", c):
        end = c.find(b"endstream", s.end())
        if end < 0:
            issues.append("stream without end")
            break
        head = c[c.rfind(b"obj", 0, s.start()) + 3:s.start()]
        part = c[s.end():end]
        if b"/FlateDecode" in head and b"/Image" not in head:
            try:
                part = zlib.decompressobj().decompress(part, left)
            except zlib.error:
                continue
            left -= len(part)
            if b"/EmbeddedFile" not in head:
                parts.append(part)
        if b"/EmbeddedFile" in head:
            files.append(part)
        if left <= 0:
            limited = True
            break
    everything = b"\n".join(parts)
    count = lambda rx: len(re.findall(rx, everything))
    uris = sorted({u.decode("latin-1") for u in re.findall(rb"/URI\s*\(((?:[^()\\]|\\.)*)\)", everything)} | {u for u in URI.findall(everything.decode("latin-1"))})
    hosts, domains = hosts_of(uris)
    fonts = sorted({f.decode("latin-1") for f in re.findall(rb"/BaseFont\s*/([^\s/<>\[\]()]+)", everything)})
    out = Collector(job)
    for body in re.findall(rb"/JS\s*\(((?:[^()\\]|\\.)*)\)", everything):
        out.add(body, {"name": "script"}, "Text")
    shown = "\n".join(filter(None, map(shown_text, parts[1:] or parts)))
    if shown:
        out.add(shown.encode(), {"name": "text"}, "Text")
    for body in files:
        out.add(body, {"attachment": True})
    for d in domains:
        out.add(d.encode(), {"name": d}, "Domain")
    symbols = (["LIMITS_REACHED"] if limited else []) + (["ENCRYPTED"] if b"/Encrypt" in c else []) + (["ISSUES"] if issues else []) + ([] if re.search(rb"\bT[jJ]\b", everything) else ["NOTEXT"])
    form = "XfaFull" if b"/XFA" in everything else "Acrobat" if b"/AcroForm" in everything else "None"
    meta = {"version": m[1].decode(), "form_type": form, "fonts": fonts, "number_of_pages": count(rb"/Type\s*/Page\b"), "number_of_objects": count(rb"\b\d+ \d+ obj\b"), "number_of_annotations": count(rb"/Type\s*/Annot\b"),
            "number_of_links": count(rb"/Subtype\s*/Link\b"), "number_of_attachments": count(rb"/Type\s*/EmbeddedFile\b"), "number_of_signatures": count(rb"/Type\s*/Sig\b"), "uris": uris, "unique_hosts": hosts, "unique_domains": domains, "issues": issues}
    return Result(meta, symbols + out.symbols, out.children)
