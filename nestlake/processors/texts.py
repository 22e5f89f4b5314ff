"""Text, web pages, mail and rich text."""

from __future__ import annotations

import base64
import binascii
import email
import email.errors
import email.header
import email.policy
import email.utils
import re
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes, urlsplit

from nestlake.functions.textfeatures import FUNCTION_WORDS, LEAST_WORDS, MARKED_WORDS, MARKS, ONLY_PLAIN_MARKS, PLAIN_WORDS
from nestlake.processors.base import Collector, Job, Malformed, Result, processor

URI = re.compile(r"\b((?:https?|ftp)://[^\s<>\"'`{}|\\^\[\]]*[^\s<>\"'`{}|\\^\[\].,;:!?()])", re.I)
CARD = re.compile(r"\b(?:\d{4}[\s-]?){3}\d{4}\b")
MAX_URL = 1024


def decode(content: bytes) -> tuple[str, str, bool]:
    """(text, encoding, whether characters were lost): BOM, UTF-8, else a single-byte guess."""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(bom):
            text = content[len(bom):].decode(name, "replace")
            return text, name, "\ufffd" in text
    try:
        return content.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    cyrillic = len(content) - len(content.translate(None, bytes(range(0xC0, 0x100)))) > 0.3 * len(content)
    name = "windows-1251" if cyrillic else "windows-1252"
    text = content.decode({"windows-1251": "cp1251", "windows-1252": "cp1252"}[name], "replace")
    return text, name, "\ufffd" in text


def possible_passwords(text: str) -> list[str]:
    """Last words of lines behind an announcement; the same rule as in functions.textfeatures."""
    found, words = set(), re.split(r"(\s)", text)
    words, gaps = words[::2], [*words[1::2], "\n"]
    for i, word in enumerate(words):
        if i and word and gaps[i] == "\n" and _announced(words[i - 2].lower() if i > 1 else "", words[i - 1].lower()):
            found.add(word)
    return sorted(found)


def _announced(first: str, second: str) -> bool:
    for mark in ("", *MARKS, *ONLY_PLAIN_MARKS):
        own = PLAIN_WORDS + (MARKED_WORDS if mark in MARKS else ())
        for said in [second[:len(second) - len(mark)]] * second.endswith(mark) + [first] * (second == mark):
            last = re.search(r"\w+\Z", said)
            if last and last[0] in own:
                return True
    return False


def natural_language(text: str) -> str | None:
    """The same rule as in functions.textfeatures."""
    words = re.split(r"[\W\d_]+", text.lower())
    n = sorted(((sum(w in own for w in words), name) for name, own in FUNCTION_WORDS.items()), reverse=True)
    return n[0][1] if n[0][0] >= LEAST_WORDS and n[0][0] > n[1][0] else None


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def hosts_of(uris: list[str]) -> tuple[list[str], list[str]]:
    """Distinct hosts, and those of them that are names rather than addresses."""
    hosts = set()
    for u in uris:
        try:
            h = urlsplit(u).hostname
        except ValueError:
            continue
        if h:
            hosts.add(h)
    names = {h for h in hosts if "." in h and not re.fullmatch(r"[\d.]+|.*:.*", h)}
    return sorted(hosts), sorted(names)


# What a line of code in some languages looks like, most telling first.
CODE = (("Python", re.compile(r"^(?:def \w+\(.*\):|import \w+|from \w[\w.]* import |class \w+.*:)", re.M)), ("C", re.compile(r"^#include\s*[<\"]", re.M)), ("PHP", re.compile(r"<\?php")),
        ("Java", re.compile(r"^(?:public |private )?(?:final )?class \w+.*\{|^import java", re.M)), ("JavaScript", re.compile(r"^(?:function \w*\(|(?:const|let|var) \w+ = )", re.M)), ("Bash", re.compile(r"\A#!/bin/")))


def programming_language(text: str) -> str | None:
    for name, rx in CODE:
        if len(rx.findall(text)) >= (1 if name in ("PHP", "Bash", "C") else 2):
            return name
    return None


@processor("Text")
def text(job: Job) -> Result:
    t, encoding, lost = decode(job.content)
    symbols = ["CHAR_DECODING_ERRORS"] if lost else []
    digits, spaces = sum(c.isascii() and c.isdigit() for c in t), sum(map(str.isspace, t))
    code = programming_language(t)
    if digits:
        rest = len(t) - spaces
        symbols += ["ALL_NUMBERS"] if digits == rest else ["MOSTLY_NUMBERS"] if digits > rest // 2 else ["MANY_NUMBERS"] if digits > rest // 10 else []
    if t.isascii():
        symbols.append("ALL_ASCII")
    uris = sorted(set(URI.findall(t)))
    hosts, domains = hosts_of(uris)
    if any(luhn(re.sub(r"\D", "", m)) for m in CARD.findall(t)):
        symbols.append("CC_NUMBER")
    out = Collector(job)
    for d in domains:
        out.add(d.encode(), {"name": d}, "Domain")
    if "OCR" in job.symbols:
        for u in uris:
            out.add(u.encode(), {"url": u}, "URL")
    meta = {"encoding": encoding, "programming_language": code, "natural_language": natural_language(t) if code is None else None, "number_of_characters": len(t), "number_of_digits": digits, "number_of_ascii_range_chars": sum(map(str.isascii, t)), "number_of_whitespaces": spaces,
            "number_of_newlines": t.count("\n"), "number_of_words": len(t.split()), "uris": uris, "possible_passwords": possible_passwords(t) if code is None else [], "unique_hosts": hosts, "unique_domains": domains}
    return Result(meta, symbols + out.symbols, out.children)


class _Page(HTMLParser):
    BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "label", "textarea", "dialog")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: dict[str, int] = {}
        self.links: dict[str, list[str]] = {"href": [], "src": []}
        self.lang, self.inputs, self.forms, self.scripts, self.texts, self.charset = None, set(), [], [], [], None
        self.open, self.script = [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "") for k, v in attrs}
        self.tags[tag] = self.tags.get(tag, 0) + 1
        if tag == "html" and a.get("lang"):
            self.lang = a["lang"]
        if tag == "meta":
            m = re.search(r"charset=([\w-]+)", a.get("content", ""))
            self.charset = a.get("charset") or (m[1] if m else self.charset)
        if tag in ("a", "area", "link") and a.get("href"):
            self.links["href"].append(a["href"])
        if tag == "img" and a.get("src"):
            self.links["src"].append(a["src"])
        if tag == "input":
            self.inputs.add(a.get("type", "text").lower())
        if tag == "form":
            self.forms.append({k: a[k][:512] for k in ("action", "method", "target", "name") if k in a})
        if tag == "script":
            self.script = True
            self.scripts.append({k: a[k][:512] for k in ("src", "type", "integrity") if k in a})
        if tag in self.BLOCKS:
            if self.open and self.open[-1][0] == "p":  # a block ends an open paragraph
                self.handle_endtag("p")
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.script = False
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for _, parts in self.open[k:]:
                    t = " ".join("".join(parts).split())
                    if t:
                        self.texts.append(t)
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.open and not self.script:
            self.open[-1][1].append(data)


@processor("HTML")
def html(job: Job) -> Result:
    t, encoding, lost = decode(job.content)
    p = _Page()
    p.feed(t)
    p.close()
    while p.open:
        p.handle_endtag(p.open[-1][0])
    if not p.tags and not p.lang and not p.charset:
        raise Malformed("No HTML data found")
    out = Collector(job)
    if p.texts:
        out.add("\n".join(p.texts).encode(), {"name": "text"}, "Text")
    fit = lambda urls: sorted({u.strip() for u in urls if len(u.strip()) <= MAX_URL and not u.strip().lower().startswith("data:")})
    data = [u.strip() for u in p.links["href"] + p.links["src"] if u.strip().lower().startswith("data:")]
    for u in data:
        head, _, body = u[5:].partition(",")
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4)) if head.lower().endswith(";base64") else unquote_to_bytes(body)
        except (binascii.Error, ValueError):
            raw = None
        out.add(raw, {"mime_type": head.partition(";")[0] or "text/plain", "decoded_size": len(raw) if raw is not None else None, "encoded_size": len(u)}, symbols=["RFC2397"])
    href, src = fit(p.links["href"]), fit(p.links["src"])
    hosts, domains = hosts_of(href + src)
    for d in domains:
        out.add(d.encode(), {"name": d}, "Domain")
    meta = {"lang": p.lang, "encoding": encoding, "href": href, "img_src": src, "img_data_src": [u[:64] for u in data], "unique_hosts": hosts, "unique_domains": domains, "input_types": sorted(p.inputs),
            "tag_counters": p.tags, "tag_count": sum(p.tags.values()), "forms": p.forms, "scripts": p.scripts}
    return Result(meta, (["CHAR_DECODING_ERRORS"] if lost else []) + out.symbols, out.children)


@processor("Email")
def mail(job: Job) -> Result:
    m = email.message_from_bytes(job.content, policy=email.policy.compat32)
    if not m.keys():
        raise Malformed("no headers")
    symbols, seen = [], {}
    for k in m.keys():
        seen[k.lower()] = seen.get(k.lower(), 0) + 1
    headers = [{"name": k, "value": _unfold(v), "dup": seen[k.lower()] > 1} for k, v in m.items()]
    for h in ("from", "to", "subject", "date", "message-id"):
        tag = h.upper().replace("-", "_")
        if seen.get(h, 0) > 1:
            symbols.append(f"DUP_{tag}")
        if h not in seen and h != "to":
            symbols.append(f"MISSING_{tag}")
    if any(k.startswith("resent-") for k in seen):
        symbols.append("RESENT")
    ts = None
    if m.get("date"):
        try:
            ts = email.utils.parsedate_to_datetime(str(m["date"])).timestamp()
        except (ValueError, TypeError, OverflowError):
            symbols.append("INVALID_DATE")
    if len(email.utils.getaddresses([str(m.get("from", ""))])) > 1:
        symbols.append("FROM_LIST")
    version = m.get("mime-version")
    if version is None:
        symbols.append("MISSING_MIME_VER")
    elif not re.match(r"\s*1\.0", str(version)):
        symbols.append("INVALID_MIME_VER")
    if m.defects:
        symbols.append("INVALID_HEADERS")
    out, n, plain, rich = Collector(job), 0, False, False
    for k, part in enumerate(x for x in m.walk() if not x.is_multipart()):
        disposition = part.get_content_disposition() or ""
        kind, names = part.get_content_type(), [x for x in (part.get_filename(), part.get_param("name")) if isinstance(x, str)]
        try:
            body = part.get_payload(decode=True)
        except (ValueError, LookupError):
            body = None
        child = []
        if any("Base64" in type(d).__name__ for d in part.defects):
            symbols.append("INVALID_BODY_ENC")
        attached = disposition == "attachment" or bool(names)
        n += attached
        plain |= kind == "text/plain" and not attached
        rich |= kind == "text/html" and not attached
        charset = part.get_content_charset()
        if attached and charset:
            symbols.append("CHARSET_ATTM")
        meta = {"ord": k, "disposition": disposition, "inline": disposition != "attachment", "mime_type": kind, "transfer_encoding": str(part.get("content-transfer-encoding")) if part.get("content-transfer-encoding") else None,
                "name": names[0] if names else None, "names": sorted(set(names)), "text_decoder": {"charset": charset} if charset else None}
        force = None if attached else {"text/plain": "Text", "text/html": "HTML"}.get(kind)
        if force and body is not None and charset and charset.lower() not in ("utf-8", "us-ascii"):
            try:
                body = body.decode(charset, "replace").encode()
            except LookupError:
                meta["text_decoder"]["supported"] = False
        if not out.add(body, meta, "Email" if kind == "message/rfc822" else force, child):
            break
    meta = {"headers": headers, "date_ts": ts, "multipart": m.is_multipart(), "mime_type": m.get_content_type(), "charset": m.get_content_charset(), "n_attachments": n, "has_text_body": plain, "has_html_body": rich}
    return Result(meta, symbols + out.symbols, out.children)


def _unfold(v: object) -> str:
    try:
        parts = email.header.decode_header(str(v))
        return re.sub(r"\r?\n[ \t]*", " ", "".join(p.decode(c or "latin-1", "replace") if isinstance(p, bytes) else p for p, c in parts))
    except (LookupError, ValueError, email.errors.HeaderParseError):
        return str(v)


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
# Destinations whose text is not part of the document.
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "themedata", "datastore", "generator", "listtable", "listoverridetable", "rsidtbl", "xmlnstbl", "fldinst", "latentstyles"}


@processor("RTF")
def rtf(job: Job) -> Result:
    if not job.content.startswith(b"{\\rtf"):
        raise Malformed("no RTF header")
    page, out, stack, skip, uc, drop = "cp1252", [], [], False, 1, 0
    for m in _RTF.finditer(job.content.decode("latin-1")):
        word, arg, hexa, sign, brace, char = m.groups()
        if brace == "{":
            stack.append((skip, uc))
        elif brace == "}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif sign == "*":
            skip = True
        elif word:
            word = word.lower()
            if word in _RTF_SKIP:
                skip = True
            elif word == "ansicpg" and arg:
                page = f"cp{arg}"
            elif word == "uc" and arg:
                uc = int(arg)
            elif word == "u" and arg and not skip:
                out.append(chr(int(arg) % 65536).encode("utf-16-le", "surrogatepass"))
                drop = uc
            elif word in ("par", "line", "row", "sect") and not skip:
                out.append("\n")
            elif word in ("tab", "cell") and not skip:
                out.append("\t")
        elif hexa:
            if drop:
                drop -= 1
            elif not skip:
                out.append(bytes.fromhex(hexa))
        elif sign in ("\\", "{", "}", "~") and not skip:
            out.append(" " if sign == "~" else sign)
        elif char and not skip:
            if drop:
                drop -= 1
            else:
                out.append(char)
    text, wide, narrow = [], b"", b""
    for piece in [*out, ""]:
        if isinstance(piece, bytes) and len(piece) == 2:
            if narrow:
                text.append(_page(narrow, page))
                narrow = b""
            wide += piece
            continue
        if wide:
            text.append(wide.decode("utf-16-le", "replace"))
            wide = b""
        if isinstance(piece, bytes):
            narrow += piece
            continue
        if narrow:
            text.append(_page(narrow, page))
            narrow = b""
        text.append(piece)
    got = Collector(job)
    body = "".join(text).strip()
    if body:
        got.add(body.encode(), {"name": "text"}, "Text")
    return Result({"encoding": page}, got.symbols, got.children)


def _page(raw: bytes, page: str) -> str:
    try:
        return raw.decode(page, "replace")
    except LookupError:
        return raw.decode("cp1252", "replace")
