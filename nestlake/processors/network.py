"""Addresses. This build fetches nothing: pages and registry answers come from tables joined to the objects."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from urllib.parse import urlsplit

from nestlake.processors.base import Collector, Job, Malformed, Result, processor

# Names that registries give to the same fields.
FIELDS = {
    "creation_date": ("creation date", "created", "created on", "registered on", "domain registration date", "registered"),
    "update_date": ("updated date", "last updated", "last modified", "changed", "modified"),
    "expiration_date": ("registry expiry date", "registrar registration expiration date", "expiry date", "expires", "expires on", "paid-till", "renewal date"),
    "registrar": ("registrar", "registrar name", "sponsoring registrar"), "registrant_name": ("registrant name", "registrant", "holder"), "registrant_organization": ("registrant organization", "org", "organization"),
    "admin_name": ("admin name",), "admin_organization": ("admin organization",), "tech_name": ("tech name",), "tech_organization": ("tech organization",),
}
_FORMS = ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d-%b-%Y", "%Y.%m.%d %H:%M:%S", "%Y.%m.%d", "%d.%m.%Y", "%d/%m/%Y", "%a %b %d %H:%M:%S %Y")


def parse_registry(answer: str, now: datetime | None = None) -> dict:
    """Fields of a registry's answer, whatever it calls them."""
    out: dict = {"name_servers": [], "status": []}
    for line in answer.splitlines():
        key, sep, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep or not value or line.startswith(("%", "#")):
            continue
        if key in ("name server", "nserver", "nameserver", "name servers"):
            out["name_servers"].append(value.split()[0].lower().rstrip("."))
        elif key in ("domain status", "status", "state"):
            out["status"].append(value.split()[0])
        for name, keys in FIELDS.items():
            if key in keys and name not in out:
                out[name] = _date(value) if name.endswith("_date") else value
    out["name_servers"] = sorted(set(out["name_servers"]))
    created = out.get("creation_date")
    if created and now:
        out["age_days"] = int((now.timestamp() - created) // 86400)
    return out


def _date(value: str) -> float | None:
    for form in _FORMS:
        try:
            d = datetime.strptime(re.sub(r"\.\d+Z$", "Z", value), form)
        except ValueError:
            continue
        return (d if d.tzinfo else d.replace(tzinfo=UTC)).timestamp()
    return None


@processor("Domain")
def domain(job: Job) -> Result:
    """A name alone; with an answer after the first line, its fields."""
    _, _, answer = job.content.decode("utf-8", "replace").partition("\n")
    got = parse_registry(answer) if answer.strip() else {}
    return Result(got, [] if any(k in got for k in ("creation_date", "registrar")) else ["NO_DATA"])


@processor("URL", "Url")
def url(job: Job) -> Result:
    """The address's parts, and as a child the page that the table of fetched pages holds for it."""
    address = job.content.decode("utf-8", "replace").strip()
    try:
        parts = urlsplit(address)
        meta = {"url": address, "scheme": parts.scheme, "host": parts.hostname, "port": parts.port, "path": parts.path, "query": parts.query or None}
    except ValueError:
        raise Malformed("no address") from None
    if not parts.scheme or not parts.hostname:
        raise Malformed("no address")
    out = Collector(job)
    if re.fullmatch(r"[^\d.]*\.[^.]*|(?:[^.]+\.)+[A-Za-z][\w-]*", parts.hostname):
        out.add(parts.hostname.encode(), {"name": parts.hostname}, "Domain")
    if job.page is None:
        return Result(meta, ["NOT_FETCHED", *out.symbols], out.children)
    out.add(bytes(job.page), {"url": address})
    return Result(meta | {"page_size": len(job.page)}, out.symbols, out.children)
