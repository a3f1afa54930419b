"""References in style sheets by a lexer: one pass over the text, whatever it holds.

Strings, comments and url tokens are read whole, each by a pattern that never
gives back what it has read, so time is linear in the text and nothing
recurses: a sheet with a data URI of megabytes is one token.  A small state
tells apart imports, declarations (with their property and the rule around
them) and names that are no files.  Rewriting replaces what the same tokens
found and copies all else.

Null sheets have no references.  Strings and comments that never end go to
the end of the line and of the text; malformed url tokens are no references.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pieces import in_pieces

REFERENCE = "array<struct<url:string,kind:string,property:string,rule:string,func:string,start:int,stop:int>>"
_TYPE = pa.list_(pa.struct([("url", pa.string()), ("kind", pa.string()), ("property", pa.string()), ("rule", pa.string()), ("func", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}+\s?|\r\n|.)"
_NAME = rf"(?:[-\w]|{_ESCAPE})++"
_TOKEN = re.compile(
    rf"""(?P<comment>/\*(?:[^*]++|\*(?!/))*+(?:\*/)?)
    |(?P<string>"(?P<double>(?:[^"\\\n]++|{_ESCAPE})*+)"?|'(?P<single>(?:[^'\\\n]++|{_ESCAPE})*+)'?)
    |(?P<url>(?i:url)\(\s*+(?!["'])(?P<plain>(?:[^\s"'()\\]++|{_ESCAPE})*+)\s*+(?:\)|\Z))
    |(?P<bad>(?i:url)\(\s*+(?!["'\s])(?:[^)\\]++|{_ESCAPE})*+\)?)
    |@(?P<at>{_NAME})
    |(?P<func>{_NAME})\(
    |(?P<name>{_NAME})
    |(?P<mark>[][(){{}};:])""",
    re.S | re.X,
)
_ESCAPED = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(\r\n|\n)|(.))", re.S)
#: Functions whose string is a URL.
URL_FUNCTIONS = ("url", "src", "image-set", "-webkit-image-set")
#: Rules whose prelude names no file.
NAMELESS = ("namespace", "charset")


def plain(text: str) -> str:
    """``text`` with its escapes decoded."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return "\ufffd" if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)
        return "" if m[2] else m[3]

    return _ESCAPED.sub(one, text)


def references(text: str) -> list[tuple]:
    """(url, kind, property, rule, func, start, stop) in order.

    kind is import, declaration or other; rule is the nearest at-rule around;
    func is the outermost image set, url, src, or null for a bare string;
    start and stop bound the URL as written, without quotes.
    """
    found = []
    # The rule around each open block; of each open call its name, whether an image set is around it, and whether another function is.
    blocks: list[str | None] = []
    calls: list[tuple[str, bool, bool]] = []
    at = named = pending = None
    fresh, imported = True, False

    def add(raw: str, func: str | None, start: int, stop: int) -> None:
        nonlocal imported
        if at in NAMELESS:
            return
        rule = blocks[-1] if blocks else None
        if at == "import":
            if not imported and not (calls and calls[-1][2]):
                found.append((plain(raw).strip(), "import", None, rule, func, start, stop))
                imported = True
        elif func:
            found.append((plain(raw).strip(), "declaration" if named else "other", named, rule, func, start, stop))

    def opened(name: str) -> tuple[str, bool, bool]:
        _, image, other = calls[-1] if calls else ("", False, False)
        return name, image or name.endswith("image-set"), other or name not in URL_FUNCTIONS

    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("double", "single", "plain") else "string" if m["string"] is not None else "url"
        if kind == "comment":
            continue
        if kind == "string":
            which = "double" if m["double"] is not None else "single"
            name, image, _ = calls[-1] if calls else (None, False, False)
            if name in URL_FUNCTIONS:
                add(m[which], "image-set" if image else name, *m.span(which))
            elif at == "import" and not calls:
                add(m[which], None, *m.span(which))
            fresh, pending = False, None
        elif kind == "url":
            add(m["plain"], "image-set" if calls and calls[-1][1] else "url", *m.span("plain"))
            fresh, pending = False, None
        elif kind == "at":
            if not calls:
                at, named, imported = plain(m["at"]).lower(), None, False
            fresh, pending = False, None
        elif kind == "func":
            calls.append(opened(plain(m["func"]).lower()))
            fresh, pending = False, None
        elif kind == "name":
            pending = plain(m["name"]) if fresh and not calls else None
            fresh = False
        elif kind == "mark":
            c = m["mark"]
            if c in "([":
                calls.append(opened(""))
                fresh, pending = False, None
            elif c in ")]":
                if calls:
                    calls.pop()
            elif c == ":":
                if pending is not None:
                    named = pending if pending.startswith("--") else pending.lower()
                pending = None
            elif c == ";":
                if not calls:
                    at = named = pending = None
                    fresh = True
            else:
                if c == "{":
                    blocks.append(at or (blocks[-1] if blocks else None))
                elif blocks:
                    blocks.pop()
                calls.clear()
                at = named = pending = None
                fresh = True
    return [f for f in found if f[0]]


def rewritten(text: str, new: dict[str, str]) -> str:
    """Each reference that ``new`` knows, by its decoded or its written form, replaced; quotes stay, all else is copied."""
    out, at = [], 0
    for url, _, _, _, _, start, stop in references(text):
        target = new.get(url)
        if target is None:
            target = new.get(text[start:stop].strip())
        if target is None:
            continue
        quote = text[start - 1] if text[start - 1 : start] in ("'", '"') else ""
        if not quote and re.search(r"[\s\"'()\\]", target):
            quote, lead, tail = '"', '"', '"'
        else:
            lead = tail = ""
        if quote:
            target = target.replace("\\", "\\\\").replace(quote, "\\" + quote).replace("\n", "\\a ")
        out += [text[at:start], lead, target, tail]
        at = stop
    return "".join(out) + text[at:]


def _lex(col: pa.Array) -> pa.Array:
    names = [f.name for f in _TYPE.value_type]
    return in_pieces(lambda rows: [None if t is None else [dict(zip(names, r)) for r in references(t)] for t in rows], _TYPE, col)


def css_references(css: Column) -> Column:
    """array<struct<url,kind,property,rule,func,start,stop>> of a sheet."""
    return F.arrow_udf(_lex, REFERENCE)(css)
