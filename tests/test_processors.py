import base64
import bz2
import gzip
import io
import json
import lzma
import struct
import tarfile
import zipfile
import zlib
from email.message import EmailMessage

import pytest

from nestlake.processors import Job, Limits, run
from nestlake.processors.compound import decompress_vba
from nestlake.processors.network import parse_registry
from nestlake.sources.content import detect


def zip_of(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def tar_of(name, body):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        i = tarfile.TarInfo(name)
        i.size = len(body)
        t.addfile(i, io.BytesIO(body))
    return out.getvalue()


def names(r):
    return [c.relation.get("name") for c in r.children]


def test_text():
    r = run(Job(b"see http://a.example.org/x, http://10.0.0.1/y\ncard 4111-1111 1111 1111 1234567890\npassword: s3cret\n", "Text", ("OCR",)))
    assert {"ALL_ASCII", "CC_NUMBER", "MANY_NUMBERS"} <= set(r.symbols) and r.metadata["possible_passwords"] == ["s3cret"]
    assert r.metadata["unique_domains"] == ["a.example.org"] and r.metadata["unique_hosts"] == ["10.0.0.1", "a.example.org"]
    assert [c.force_type for c in r.children] == ["Domain", "URL", "URL"]
    assert run(Job(b"12 34\n56", "Text")).symbols == ["ALL_ASCII", "ALL_NUMBERS"]
    assert run(Job("zażółć".encode("utf-16"), "Text")).metadata["encoding"] == "utf-16-le"
    assert run(Job(b"x" * 100, "Text", limits=Limits(10))).error
    assert run(Job(b"", "Text")).metadata["number_of_words"] == 0


def test_html():
    page = b"<html lang=de><head><meta charset=utf-8><script src=a.js></script></head><body><h1>T</h1><p>one <b>two</b><p>three</p><form action=/go><input type=password></form><a href='http://x.example/1'>l</a><img src='data:image/png;base64,iVBORw0KGgo='></body>"
    r = run(Job(page, "HTML"))
    assert r.metadata["lang"] == "de" and r.metadata["href"] == ["http://x.example/1"] and r.metadata["input_types"] == ["password"] and r.metadata["scripts"] == [{"src": "a.js"}]
    kinds = {(c.force_type, tuple(c.symbols)) for c in r.children}
    assert kinds == {("Text", ()), (None, ("RFC2397",)), ("Domain", ())} and r.children[0].content == b"T\none two\nthree"
    assert run(Job(b"no markup at all", "HTML")).error == "No HTML data found"


def test_mail():
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"] = "a@x.example", "b@y.example", "Grüße", "Wed, 01 Jul 2020 12:00:00 +0200"
    m.set_content("plain")
    m.add_alternative("<p>rich</p>", subtype="html")
    m.add_attachment(b"\x00\x01", maintype="application", subtype="zip", filename="f.zip")
    r = run(Job(m.as_bytes(), "Email"))
    assert r.metadata["date_ts"] == 1593597600 and r.metadata["n_attachments"] == 1 and r.metadata["has_html_body"] and r.metadata["multipart"]
    assert [c.force_type for c in r.children] == ["Text", "HTML", None] and r.children[2].content == b"\x00\x01"
    assert {"name": "Subject", "value": "Grüße", "dup": False} in r.metadata["headers"]
    assert "MISSING_DATE" in run(Job(b"From: a\nSubject: s\n\nx", "Email")).symbols and run(Job(b"", "Email")).error


def test_archives():
    z = zip_of(a_dot_txt=b"A", d__b=b"B")
    r = run(Job(z, "ZIP"))
    assert names(r) == ["a.txt", "d/b"] and [c.content for c in r.children] == [b"A", b"B"] and r.metadata["num_entries"] == 2
    assert run(Job(tar_of("n", b"body"), "TAR")).children[0].content == b"body"
    two = gzip.compress(b"one") + gzip.compress(b"two")
    r = run(Job(two + b"rest", "GZIP"))
    assert r.children[0].content == b"onetwo" and r.symbols == ["GZIP_MULTI_MEMBER", "GZIP_TRAILING_GARBAGE"] and r.metadata["total_members"] == 2
    for kind, body in (("BZIP2", bz2.compress(b"x" * 999)), ("XZ", lzma.compress(b"x" * 999)), ("LZMA", lzma.compress(b"x" * 999, lzma.FORMAT_ALONE))):
        assert run(Job(body, kind)).children[0].content == b"x" * 999
        assert run(Job(body[:-9], kind)).error or run(Job(body[:-9], kind)).children
        small = run(Job(body, kind, limits=Limits(child_bytes=10)))
        assert small.children[0].content is None and small.children[0].symbols == ["TOOBIG"] and small.symbols == ["LIMITS_REACHED"]
    many = run(Job(zip_of(**{f"f{k}": b"x" for k in range(9)}), "ZIP", limits=Limits(children=5)))
    assert len(many.children) == 5 and "LIMITS_REACHED" in many.symbols


def test_cabinet():
    body = b"hello cabinet " * 20
    d = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = b"CK" + d.compress(body) + d.flush()
    entry = struct.pack("<IIHHHH", len(body), 0, 0, 0, 0, 32) + b"h.txt\0"
    head = 36 + 8
    start = head + len(entry)
    cab = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, 0, 0, head, 0, 3, 1, 1, 1, 0, 0, 0) + struct.pack("<IHH", start, 1, 1) + entry + struct.pack("<IHH", 0, len(packed), len(body)) + packed
    r = run(Job(cab, "CAB"))
    assert r.children[0].content == body and names(r) == ["h.txt"] and r.metadata == {"number_of_files": 1, "number_of_folders": 1}


def test_iso():
    vd = bytearray(2048)
    vd[0:7] = b"\x01CD001\x01"
    vd[40:44] = b"VOL1"
    vd[158:162], vd[166:170] = struct.pack("<I", 18), struct.pack("<I", 2048)
    name = b"A.TXT;1"
    e = bytearray(33) + name
    e += b"\0" * (len(e) % 2)
    e[0], e[32] = len(e), len(name)
    e[2:6], e[10:14] = struct.pack("<I", 19), struct.pack("<I", 3)
    image = b"\0" * 32768 + bytes(vd) + b"\xffCD001\x01" + b"\0" * 2041 + bytes(e) + b"\0" * (2048 - len(e)) + b"abc" + b"\0" * 2045
    r = run(Job(image, "CDFS"))
    assert r.children[0].content == b"abc" and names(r) == ["A.TXT"] and r.metadata["volume_descriptors"][0]["volume_identifier"] == "VOL1"
    assert detect(image) == "CDFS"


def test_udf_descriptor():
    text = lambda s, n: (b"\x08" + s.encode()).ljust(n - 1, b"\0") + bytes([len(s) + 1])
    pvd = bytearray(2048)
    pvd[:2], pvd[24:56], pvd[56:58], pvd[72:200] = struct.pack("<H", 1), text("VOL", 32), struct.pack("<H", 3), text("SET", 128)
    pvd[376:388] = struct.pack("<HhBBBBBBBB", 0x1000 | (120 & 0xFFF), 2020, 7, 1, 12, 30, 15, 25, 0, 0)
    image = bytearray(260 * 2048)
    image[16 * 2048 + 1:16 * 2048 + 6] = b"NSR02"
    image[256 * 2048:256 * 2048 + 2], image[256 * 2048 + 16:256 * 2048 + 24] = struct.pack("<H", 2), struct.pack("<II", 2048 * 2, 257)
    image[257 * 2048:258 * 2048] = pvd
    r = run(Job(bytes(image), "CDFS"))
    assert r.symbols == ["UDF"] and r.metadata["udf_volumes"] == [{"pv_identifier": "VOL", "pv_seq": 3, "set_identifier": "SET", "app_identifier": "", "datetime": "2020-07-01 12:30:15.25 +02:00:00"}]


def test_executables():
    elf = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0x400000, 0, 0, 0, 64, 56, 0, 64, 0, 0)
    assert run(Job(elf, "ELF")).metadata["header"]["machine"] == 62 and run(Job(elf[:30], "ELF")).error
    pe = bytearray(b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 5, 0, 0, 0, 2) + b".text\0\0\0" + struct.pack("<IIIIIIHHI", 16, 4096, 16, 128, 0, 0, 0, 0, 0))
    pe += b"\0" * (144 - len(pe))
    r = run(Job(bytes(pe) + zip_of(a=b"x"), "PE"))
    assert r.metadata["section_headers"][0]["name"] == ".text" and r.children[0].symbols == ["SFX"] and "PH_NO_OPTIONAL_HEADER" in r.metadata["issues"]
    macho = b"\xcf\xfa\xed\xfe" + struct.pack("<IIIIIII", 0x1000007, 3, 2, 1, 24, 0, 0) + struct.pack("<IIQQ", 0x80000028, 24, 1, 2)
    assert run(Job(macho, "MachO")).metadata["header"]["ncmds"] == 1
    fat = struct.pack(">II", 0xCAFEBABE, 1) + struct.pack(">IIIII", 7, 3, 28, len(macho), 2) + macho
    r = run(Job(fat, "UniversalBinary"))
    assert r.children[0].force_type == "MachO" and r.children[0].content == macho


def test_link_and_images():
    head = struct.pack("<I", 0x4C) + bytes(16) + struct.pack("<II", 0x80 | 4 | 32, 32) + struct.pack("<QQQIiIH", 132380784000000000, 0, 0, 5, 1, 1, 0) + bytes(10)
    text = lambda s: struct.pack("<H", len(s)) + s.encode("utf-16-le")
    r = run(Job(head + text("name") + text("-x") + struct.pack("<II", 12, 0xA0000001) + b"abcd" + bytes(4), "LNK"))
    assert r.symbols == ["HAS_ARGUMENTS"] and r.metadata["string_data"]["command_line_arguments"] == "-x" and r.metadata["extra_data"] == [{"block_size": 12, "block_signature": 0xA0000001}]
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 5, 7, 8, 6)
    assert run(Job(png, "Image")).metadata == {"format": "PNG", "pixel_format": "RGBA8", "width": 5, "height": 7}
    assert run(Job(b"<svg onload='x'><script>1</script></svg>", "Image")).symbols == ["SVG_JS"]
    assert run(Job(b"junk", "Image")).error


def test_documents():
    docx = zip_of(**{"[Content_Types]_dot_xml": "<x/>", "word__document_dot_xml": "<w:d xmlns:w='w'><w:p><w:t>Hi</w:t></w:p><w:p><w:t>you</w:t></w:p></w:d>", "docProps__core_dot_xml": "<c xmlns:d='d'><d:creator>me</d:creator></c>",
                     "word___rels__document_dot_xml_dot_rels": "<R><r TargetMode='External' Type='t/hyperlink' Target='http://l.example/'/></R>", "word__media__i_dot_png": b"img"})
    r = run(Job(docx, "Office"))
    assert r.symbols == ["DOCX"] and r.metadata["properties"]["creator"] == "me" and r.children[0].content == b"Hi\nyou" and names(r) == ["text", "word/media/i.png", "l.example"]
    assert detect(docx) == "Office"
    odt = zip_of(mimetype=b"application/vnd.oasis.opendocument.text", content_dot_xml="<o xmlns:t='t'><t:p>para</t:p></o>", meta_dot_xml="<m xmlns:d='d'><d:title>T</d:title></m>")
    r = run(Job(odt, "ODF"))
    assert r.symbols == ["ODT"] and r.children[0].content == b"para" and r.metadata["properties"]["title"] == "T"
    r = run(Job(rb"{\rtf1\ansi\ansicpg1250{\fonttbl{\f0 Arial;}}Za\'bf\'f3\u322?\'e6 {\b x}\par y}", "RTF"))
    assert r.children[0].content.decode() == "Zażółć x\ny"
    pdf = b"%PDF-1.7\n1 0 obj<</Type /Page /BaseFont /Foo>>endobj\n2 0 obj<</Filter/FlateDecode>>stream\n" + zlib.compress(b"BT (x) Tj ET /URI (http://p.example/a)") + b"\nendstream\nstartxref\n%%EOF"
    r = run(Job(pdf, "PDF"))
    assert r.metadata["number_of_pages"] == 1 and r.metadata["fonts"] == ["Foo"] and r.metadata["uris"] == ["http://p.example/a"] and "NOTEXT" not in r.symbols
    assert decompress_vba(bytes.fromhex("0119b000616263646566676800696a6b6c6d6e6f70007172737475762e")) == b"abcdefghijklmnopqrstuv."
    assert run(Job(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "MSG")).error


def test_registry_answers():
    got = parse_registry("% c\nCreation Date: 2001-02-03T04:05:06Z\nRegistrar: R\nName Server: NS1.X.example\nName Server: ns1.x.example\nDomain Status: ok http://x")
    assert got == {"name_servers": ["ns1.x.example"], "status": ["ok"], "creation_date": 981173106.0, "registrar": "R"}
    assert run(Job(b"x.example", "Domain")).symbols == ["NO_DATA"]


@pytest.mark.parametrize("kind", ["ZIP", "TAR", "GZIP", "CAB", "ARJ", "CDFS", "7Z", "RAR", "PE", "ELF", "MachO", "LNK", "Image", "RTF", "PDF", "ODF", "Office", "MSG", "MSI", "BZIP2", "XZ", "UniversalBinary"])
def test_damaged_input_is_an_error_not_a_crash(kind):
    assert run(Job(b"\x00\x01garbage" * 7, kind)).error
    assert run(Job(b"", kind)).error


def test_detection():
    cases = {b"": "EMPTY", b"%PDF-1": "PDF", gzip.compress(b""): "GZIP", zip_of(a=b"b"): "ZIP", b"<!DOCTYPE html><p>": "HTML", b"From: a\nSubject: b\n\n": "Email", b"plain words": "Text", b"\x00\x01\x02": "UNKNOWN", tar_of("a", b"b"): "TAR"}
    assert {k: detect(k) for k in cases} == cases and detect(None) == "SKIPPED"
    assert json.dumps(run(Job(base64.b64decode("AAAA"), "Nothing")).metadata) == "{}"
