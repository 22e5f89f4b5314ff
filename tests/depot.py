"""A seeded forest of deliveries, and a walker in plain Python that says which of its nodes a condition selects.

Every case is a query and a Python function of one node; the function knows nothing of the engine.
"""

import json
import random
import re
from datetime import datetime, timedelta

KINDS = [("Zip", None), ("PDF", None), ("Email", None), ("Text", None), ("Image", "PNG"), ("Image", "TIFF"), ("PE", "DLL")]
ORGS = ["north", 'the "yard"', "a\tb\nc", "łódź\U0001F3ED"]
WORDS = ["invoice", "manifest", "Label", "photo", "setup", "notes"]
ENDS = [".pdf", ".TXT", ".dll", ".png"]
FLAGS = ["SIGNED", "SCANNED", "MACRO_FREE", "TOO_LARGE"]
FAILURES = ["Truncated stream", "unknown method 9"]


class Node:
    def __init__(self, **facts):
        self.__dict__.update(facts)
        self.kids = []

    def ups(self):
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def downs(self, depth=1000):
        if depth > 0:
            for k in self.kids:
                yield k
                yield from k.downs(depth - 1)

    def mates(self):
        return [k for k in self.parent.kids if k is not self] if self.parent is not None else []

    def root(self):
        return ([*self.ups()] or [self])[-1]


def _metadata(rng):
    m = {}
    if rng.random() < 0.6:
        m["pages"] = rng.randrange(5)
    if rng.random() < 0.5:
        m["limit"] = rng.choice([rng.randrange(5), "3", None])
    if rng.random() < 0.4:
        m["signed"] = rng.random() < 0.5
    if rng.random() < 0.5:
        m["title"] = rng.choice(["summary", "Summary of all", "\x08\x0cend", "\U0001F3ED\U0001F4E6", "état", ""])
    if rng.random() < 0.4:
        m["sizes"] = [rng.randrange(6) for _ in range(rng.randrange(4))]
    if rng.random() < 0.5:
        m["headers"] = [{"field": f, "content": rng.choice(["dock", "Crane", 4, True])} for f in rng.sample(["origin", "target", "weight"], rng.randrange(1, 4))]
    if rng.random() < 0.2:
        m["odd key's"] = {"in.ner": 1}
    return m


def _relation(rng):
    p = {"name": rng.choice(WORDS) + rng.choice(ENDS)}
    if rng.random() < 0.3:
        p["names"] = [rng.choice(["box/", "rack/"]) + rng.choice(WORDS) for _ in range(2)]
    if rng.random() < 0.5:
        p["place"] = rng.choice([{"row": 2}, {"row": "2"}, {"row": None}, {"row": 1, "column": 1}, {"row": 3, "column": 1}])
    if rng.random() < 0.4:
        p["mark"] = rng.choice([[1, 2], "k", {}])
    return p


def grow(seed=11, works=12):
    """All nodes of the forest."""
    rng, out = random.Random(seed), []
    for w in range(works):
        own = []
        for n in range(rng.choice([1, 3, 6, 9, 14])):
            kind, sub = rng.choice(KINDS)
            up = rng.choice(own) if own else None
            bad = rng.random() < 0.12
            x = Node(id=w * 50 + n + 7, work=f"delivery-{w}", org=ORGS[w % len(ORGS)], name=f"d{w}n{n}", kind=kind, sub=sub, parent=up, size=rng.randrange(1, 9) * 1000, level=1 if up is None else up.level + 1,
                     at=datetime(2021, 5, 1 + w, 6), entropy=rng.choice([None, 2.5, 7.25]), md5=f"{rng.getrandbits(32):08x}", error=rng.choice(FAILURES) if bad else None,
                     meta={} if bad else _metadata(rng), flags=[] if bad else rng.sample(FLAGS, rng.randrange(3)), props=_relation(rng))
            if up is not None:
                up.kids.append(x)
            own.append(x)
        out += own
    return out


def tables(nodes):
    """(objects, rels) as lists of dicts."""
    objects = [{"id": x.id, "org": x.org, "work_id": x.work, "is_entry": x.parent is None, "object_id": x.name, "object_type": x.kind, "object_subtype": x.sub, "recursion_level": x.level, "size": x.size,
                "hashes": json.dumps({"md5": x.md5}), "t": x.at, "result": json.dumps({"error": x.error} if x.error else {"ok": {"symbols": x.flags, "object_metadata": x.meta}}), "entropy": x.entropy} for x in nodes]
    rels = [{"parent": x.parent and x.parent.id, "child": x.id, "props": json.dumps(x.props)} for x in nodes]
    return objects, rels


def found(value, *steps):
    """Values at a path; arrays are looked into, one level a step."""
    now = [value]
    for s in steps:
        flat = [y for x in now for y in (x if isinstance(x, list) else [x])]
        if isinstance(s, str):
            now = [x[s] for x in flat if isinstance(x, dict) and s in x]
        else:
            now = [y[s] for y in (x if isinstance(x, list) else [x] for x in now) if s < len(y)]
    return now


def each(value, *steps):
    return [y for x in found(value, *steps) for y in (x if isinstance(x, list) else [x])]


def texts(value, *steps):
    return [x for x in each(value, *steps) if isinstance(x, str)]


def numbers(value, *steps):
    return [x for x in each(value, *steps) if isinstance(x, (int, float)) and not isinstance(x, bool)]


def same(a, b):
    return isinstance(a, bool) == isinstance(b, bool) and isinstance(a, str) == isinstance(b, str) and a == b


def named(x):
    return [*dict.fromkeys([x.props["name"], *x.props.get("names", [])])]


CASES = [
    ('object_type = "Zip"', lambda x: x.kind == "Zip"),
    ('object_subtype != "PNG"', lambda x: x.sub not in (None, "PNG")),
    ('not (object_subtype == "PNG")', lambda x: x.sub not in (None, "PNG")),
    ('(object_subtype in ("PNG", "TIFF") or object_type == "PDF") and size > 4000', lambda x: (x.sub in ("PNG", "TIFF") or x.kind == "PDF") and x.size > 4000),
    ('recursion_level not in (1, 3)', lambda x: x.level not in (1, 3)),
    ("entropy >= 7 || size <= 2000", lambda x: (x.entropy or 0) >= 7 or x.size <= 2000),
    ('/* either */ object_type=="PE" || is_entry && size>3e3 // rest', lambda x: x.kind == "PE" or (x.parent is None and x.size > 3000)),
    (r'org == "the \"yard\""', lambda x: x.org == ORGS[1]),
    (r'org == "a\tb\nc"', lambda x: x.org == ORGS[2]),
    (r'org == "łódź\U0001F3ED" and is_entry', lambda x: x.org == ORGS[3] and x.parent is None),
    ('@has_error()', lambda x: x.error is not None),
    ('@has_error("Truncated stream")', lambda x: x.error == FAILURES[0]),
    ('@has_error(starts_with("unknown"))', lambda x: (x.error or "").startswith("unknown")),
    (r'@has_error(regex("\\d$"))', lambda x: bool(re.search(r"\d$", x.error or ""))),
    ('@has_error(iregex("STREAM"))', lambda x: "stream" in (x.error or "")),
    ('@has_symbol("SIGNED")', lambda x: "SIGNED" in x.flags),
    ('@has_symbol(starts_with("S")) == false', lambda x: not any(f[0] == "S" for f in x.flags)),
    ('@has_symbol(in("TOO_LARGE", iregex("^macro")))', lambda x: bool({"TOO_LARGE", "MACRO_FREE"} & set(x.flags))),
    (r'@has_name(iregex(r"\.txt$"))', lambda x: any(n.lower().endswith(".txt") for n in named(x))),
    (r'@has_name(regex("\\.TXT$")) || @has_name(starts_with("rack/"))', lambda x: any(n.endswith(".TXT") or n.startswith("rack/") for n in named(x))),
    ('@has_name(in("box/photo", regex("^Label.dll$")))', lambda x: any(n == "box/photo" or re.search("^Label.dll$", n) for n in named(x))),
    ("@is_leaf()", lambda x: not x.kids),
    ("@is_root() && @count_children() == 0", lambda x: x.parent is None and not x.kids),
    ('@count_children(object_type="Image") >= 2', lambda x: sum(k.kind == "Image" for k in x.kids) >= 2),
    ('@has_parent(object_type="Zip" && @has_symbol("SIGNED"))', lambda x: x.parent is not None and x.parent.kind == "Zip" and "SIGNED" in x.parent.flags),
    ("@has_root(size > 5000)", lambda x: x.root().size > 5000),
    ('@has_child(object_type == "PDF" || @has_child(object_type == "PDF"))', lambda x: any(k.kind == "PDF" or any(g.kind == "PDF" for g in k.kids) for k in x.kids)),
    ('recursion_level > 1 && @has_sibling(object_type = "Text")', lambda x: any(k.kind == "Text" for k in x.mates())),
    ("@count_siblings() > 2", lambda x: len(x.mates()) > 2),
    ('@has_descendant(object_type="Email" && size > 3000)', lambda x: any(k.kind == "Email" and k.size > 3000 for k in x.downs())),
    ("@count_descendants(size > 3000, 2) == 2", lambda x: sum(k.size > 3000 for k in x.downs(2)) == 2),
    ('@has_ancestor(object_type != "Zip" && size > 6000)', lambda x: any(k.kind != "Zip" and k.size > 6000 for k in x.ups())),
    ("@count_ancestors() == 2", lambda x: len([*x.ups()]) == 2),
    ('@count_conditions(size > 4000, @has_symbol("SCANNED"), @is_leaf()) >= 2', lambda x: (x.size > 4000) + ("SCANNED" in x.flags) + (not x.kids) >= 2),
    ('@date_range("2021-05-02", "2021-05-04") && is_entry', lambda x: x.parent is None and 2 <= x.at.day <= 4),
    ('@date_range("2021-05-03 06:00:00", "2021-05-03 06:00:00")', lambda x: x.at == datetime(2021, 5, 3, 6)),
    ('@date_since("2021-05-09 06:00:01")', lambda x: x.at > datetime(2021, 5, 9, 6)),
    ("@has_object_meta($limit)", lambda x: any(v is not None for v in each(x.meta, "limit"))),
    ("@match_object_meta($pages == 3)", lambda x: 3 in numbers(x.meta, "pages")),
    ("@match_object_meta($pages != 3)", lambda x: 3 not in numbers(x.meta, "pages")),
    ("@match_object_meta($pages == $limit)", lambda x: any(same(a, b) for a in each(x.meta, "pages") for b in each(x.meta, "limit"))),
    ("@match_object_meta($pages <> $limit)", lambda x: not any(same(a, b) for a in each(x.meta, "pages") for b in each(x.meta, "limit"))),
    ("@match_object_meta($signed == true)", lambda x: x.meta.get("signed") is True),
    ("@match_object_meta($sizes > 4)", lambda x: any(v > 4 for v in numbers(x.meta, "sizes"))),
    ("@match_object_meta($sizes[1] in (1, $pages))", lambda x: any(v == 1 or v in numbers(x.meta, "pages") for v in numbers(x.meta, "sizes", 1))),
    ('@match_object_meta($title starts_with("Summary"))', lambda x: any(t.startswith("Summary") for t in texts(x.meta, "title"))),
    ('@match_object_meta($title iregex("^summary$"))', lambda x: "summary" in texts(x.meta, "title")),
    (r'@match_object_meta($title == "\u0008\u000Cend")', lambda x: "\x08\x0cend" in texts(x.meta, "title")),
    (r'@match_object_meta($title starts_with("\U0001F3ED"))', lambda x: any(t.startswith("\U0001F3ED") for t in texts(x.meta, "title"))),
    (r'@match_object_meta($title starts_with(r"\U0001F3ED"))', lambda x: False),
    ("@match_object_meta($title.len() == 2)", lambda x: any(len(t) == 2 for t in texts(x.meta, "title"))),
    ("@match_object_meta($title.len() != 7)", lambda x: any(len(t) != 7 for t in texts(x.meta, "title"))),
    ("@has_object_meta($headers.content)", lambda x: bool(each(x.meta, "headers", "content"))),
    ('@match_object_meta($headers[0].content in ("dock", iregex("CRANE"), 4))', lambda x: any(v in ("dock", "Crane") or same(v, 4) for v in each(x.meta, "headers", 0, "content"))),
    ('@match_object_meta($headers?($field == "origin" && $content == "dock"))', lambda x: any(h["field"] == "origin" and h["content"] == "dock" for h in x.meta.get("headers", []))),
    ('@match_object_meta($headers ? ($content regex("^C") or $content == 4 and $field != "weight"))',
     lambda x: any(h["content"] == "Crane" or (same(h["content"], 4) and h["field"] != "weight") for h in x.meta.get("headers", []))),
    ('@match_object_meta($headers?($field == "target" && $content != 4))', lambda x: any(h["field"] == "target" and not same(h["content"], 4) for h in x.meta.get("headers", []))),
    ('@match_object_meta($headers?($field in ("weight", "none") and $content in (true, iregex("DOCK"))))', lambda x: any(h["field"] == "weight" and (h["content"] is True or h["content"] == "dock") for h in x.meta.get("headers", []))),
    ('@has_object_meta($"odd key\'s"."in.ner")', lambda x: "odd key's" in x.meta),
    ("@has_relation_meta($place.row)", lambda x: any(v is not None for v in each(x.props, "place", "row"))),
    ("@match_relation_meta($place.row == 2)", lambda x: 2 in numbers(x.props, "place", "row")),
    ("@match_relation_meta($place.row != 2)", lambda x: 2 not in numbers(x.props, "place", "row")),
    ("@match_relation_meta($place.row == $place.column)", lambda x: any(same(a, b) for a in each(x.props, "place", "row") for b in each(x.props, "place", "column"))),
    ("@has_relation_meta($mark)", lambda x: any(v is not None for v in each(x.props, "mark"))),
    (r"""@has_object_meta($"x'; drop table y; --")""", lambda x: False),
    ('${k}="Zip"; ${n}=3000; object_type == ${k} && size > ${n}', lambda x: x.kind == "Zip" and x.size > 3000),
]


def _whole(value, *steps):
    return {json.dumps(v, sort_keys=True) for v in found(value, *steps)}


HEAD = f"MATCHES:>1;TIME_WINDOW:{timedelta(weeks=2).days} days;"
#: (query over neighbours, function (nodes of the local work, node of the neighbour) -> whether the node is selected)
NEIGHBOURS = [
    ("${v}=LOCAL.size; size in ${v}", lambda own, x: x.size in {y.size for y in own}),
    ("${v}=LOCAL.get_names(); @has_name(in ${v})", lambda own, x: bool(set(named(x)) & {n for y in own for n in named(y)})),
    ("${v}=LOCAL.get_symbols(); @has_symbol(in ${v})", lambda own, x: bool(set(x.flags) & {n for y in own for n in y.flags})),
    ("${v}=LOCAL.get_object_meta($headers.content); @match_object_meta($headers.content in ${v})", lambda own, x: bool(_whole(x.meta, "headers", "content") & {v for y in own for v in _whole(y.meta, "headers", "content")})),
    ("${v}=LOCAL.get_relation_meta($mark); @match_relation_meta($mark in ${v})", lambda own, x: bool(_whole(x.props, "mark") & {v for y in own for v in _whole(y.props, "mark")})),
    ('${v}=LOCAL.get_relation_meta($mark); @match_relation_meta($mark in ${v}) && @has_root(object_type!="Zip")',
     lambda own, x: x.root().kind != "Zip" and bool(_whole(x.props, "mark") & {v for y in own for v in _whole(y.props, "mark")})),
    ('is_entry && object_type=="Zip"', lambda own, x: x.parent is None and x.kind == "Zip"),
]
