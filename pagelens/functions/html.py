"""HTML elements and document rewriting: the two places where text is tokenized in Python.

Both are Arrow functions over whole documents; everything before and after
them is Catalyst expressions.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import csslex
from .pieces import in_pieces

RAW_TEXT = ("script", "style")
ELEMENTS = "array<struct<seq:int,tag:string,attrs:map<string,string>,text:string>>"
_ELEMENT_TYPE = pa.list_(pa.struct([("seq", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]))

#: Attributes that hold URLs, and the elements where they do.
URL_ATTRIBUTES = {
    "src": ("img", "script", "iframe", "embed", "source", "track", "audio", "video"),
    "href": ("link", "a", "area"),
    "data-src": ("img",),
    "data-background": ("div", "section"),
    "poster": ("video",),
    "content": ("meta",),
    "action": ("form",),
    "cite": ("blockquote", "q"),
    "data": ("object",),
    "formaction": ("button", "input"),
    "manifest": ("html",),
    "ping": ("a", "area"),
    "srcset": ("img", "source"),
}
#: Those of them that are not rewritten.
NOT_REWRITTEN = ("data-background", "content", "manifest", "ping")


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.inside: dict | None = None

    def handle_starttag(self, tag, attrs):
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.found.append({"seq": len(self.found), "tag": tag, "attrs": list(first.items()), "text": None})
        self.inside = self.found[-1] if tag in RAW_TEXT else None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.inside is not None:
            self.inside["text"] = (self.inside["text"] or "") + data

    def handle_endtag(self, tag):
        self.inside = None


def elements_of(html: str | None) -> list[dict]:
    """Start tags in order, with attributes (the first of a name counts) and the text of scripts and styles."""
    if not html:
        return []
    parser = _Elements()
    parser.feed(html)
    parser.close()
    return parser.found


def _parse(col: pa.Array) -> pa.Array:
    return in_pieces(lambda rows: [elements_of(x) for x in rows], _ELEMENT_TYPE, col)


def parse_elements(html: Column) -> Column:
    """The elements of a page as an array of structs."""
    return F.arrow_udf(_parse, ELEMENTS)(html)


def rewritten_srcset(value: str, new: dict[str, str]) -> str:
    out = []
    for part in value.split(","):
        words = part.split()
        if words:
            out.append(" ".join([new.get(words[0], words[0]), *words[1:]]))
    return ", ".join(out)


_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""
#: Comments, scripts and style sheets with their text, and other start tags; all else is copied as it is.
_PIECES = re.compile(rf"(?P<comment><!--.*?-->)|(?P<script><script\b{_TAG})(?P<code>.*?)(?=</script|\Z)|(?P<style><style\b{_TAG})(?P<sheet>.*?)(?=</style|\Z)|(?P<tag><[a-z]{_TAG})", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(\s)([^\s=>"'/]+)(\s*=\s*)("[^"]*"|'[^']*'|[^\s>"']+)""")


def _rewritten_tag(raw: str, new: dict[str, str]) -> str:
    tag = re.match(r"<([a-zA-Z][^\s/>]*)", raw)[1].lower()

    def attribute(m: re.Match) -> str:
        name, value = m[2].lower(), m[4]
        quote = value[0] if value[:1] in ("'", '"') else ""
        old = changed = unescape(value[1:-1] if quote else value)
        if name == "style":
            changed = csslex.rewritten(old, new)
        elif name == "srcset" and tag in URL_ATTRIBUTES["srcset"]:
            if any(c.split() and c.split()[0] in new for c in old.split(",")):
                changed = rewritten_srcset(old, new)
        elif name not in NOT_REWRITTEN and tag in URL_ATTRIBUTES.get(name, ()):
            changed = new.get(old, old)
        if changed == old:
            return m[0]
        quote = quote or '"'
        text = changed.replace("&", "&amp;").replace(quote, "&quot;" if quote == '"' else "&#x27;")
        return f"{m[1]}{m[2]}{m[3]}{quote}{text}{quote}"

    return _ATTRIBUTE.sub(attribute, raw)


def rewritten_html(html: str, new: dict[str, str]) -> str:
    """The document with references in attributes, style attributes and style sheets replaced; nothing else changes."""
    if not new:
        return html

    def piece(m: re.Match) -> str:
        if m["comment"]:
            return m[0]
        if m["script"]:
            return _rewritten_tag(m["script"], new) + m["code"]
        if m["style"]:
            return _rewritten_tag(m["style"], new) + csslex.rewritten(m["sheet"], new)
        return _rewritten_tag(m["tag"], new)

    return _PIECES.sub(piece, html)


def _mapper(function):
    def each(texts: list, maps: list) -> list:
        return [None if text is None else function(text, dict(new or [])) for text, new in zip(texts, maps)]

    def run(col: pa.Array, mapping: pa.Array) -> pa.Array:
        return in_pieces(each, pa.string(), col, mapping)

    return run


def rewrite_html(html: Column, mapping: Column) -> Column:
    """The document with each raw reference in ``mapping`` (map<string,string>) replaced."""
    return F.arrow_udf(_mapper(rewritten_html), "string")(html, mapping)


def rewrite_css(text: Column, mapping: Column) -> Column:
    return F.arrow_udf(_mapper(csslex.rewritten), "string")(text, mapping)
