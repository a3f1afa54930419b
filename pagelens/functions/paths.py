"""Safe local paths for URLs, relative paths, and number formats."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Suffixes that a local file may keep.
VALID_EXTENSIONS = ("html", "htm", "css", "js", "json", "xml", "txt", "svg", "jpg", "jpeg", "png", "gif", "webp", "ico", "bmp", "woff", "woff2", "ttf", "otf", "eot", "mp4", "webm", "mp3", "wav", "pdf", "zip")
#: Suffixes of binary files.
BINARY_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "ico", "bmp", "tiff", "woff", "woff2", "ttf", "otf", "eot", "mp4", "webm", "mp3", "wav", "pdf", "zip", "exe", "dll")
#: Device names that no file may have.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{k}" for k in range(1, 10)), *(f"LPT{k}" for k in range(1, 10)))
MAX_NAME = 100


def _compatibility_form(col: pa.Array) -> pa.Array:
    return pa.array([None if s is None else unicodedata.normalize("NFKC", s) for s in col.to_pylist()], pa.string())


def nfkc(s: Column) -> Column:
    """NFKC; Python runs only in plans that ask for it, ASCII strings pass by."""
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.arrow_udf(_compatibility_form, "string")(s)).otherwise(s)


def _no_traversal(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\.\.|/|\\", "_"), r"[\x00\n\r]", "")


def sanitized_name(name: Column) -> Column:
    """A file name of word characters, spaces, dots and hyphens that no system reserves; 'unnamed' if nothing is left."""
    s = F.regexp_replace(_no_traversal(name), r"(?U)[^\w\s.\-]", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1f\x7f]", ""), r"^[. ]+|[. ]+$", "")
    free = lambda s: F.when(F.upper(s).isin(*RESERVED_NAMES), F.concat(F.lit("_"), s)).otherwise(s)

    def shortened(s: Column) -> Column:
        ext = F.regexp_extract(s, r"(?s)\.([^.]*)$", 1)
        stem = F.regexp_extract(s, r"(?s)^(.*)\.[^.]*$", 1)
        room = F.greatest(F.lit(MAX_NAME - 1) - F.char_length(ext), F.lit(0))
        short = F.when(s.contains("."), F.concat(F.substr(stem, F.lit(1), room), F.lit("."), ext)).otherwise(F.substr(s, F.lit(1), F.lit(MAX_NAME)))
        return F.when(F.char_length(s) > MAX_NAME, short).when(s.isin("", "."), F.lit("unnamed")).otherwise(s)

    return urls.let(F.coalesce(s, F.lit("")), lambda s: urls.let(free(s), shortened))


def sanitized_extension(ext: Column) -> Column:
    kept = F.substr(F.regexp_replace(F.lower(ext), "[^a-z0-9]", ""), F.lit(1), F.lit(10))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("html"))


def last_extension(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))


def has_valid_extension(name: Column) -> Column:
    return F.coalesce(last_extension(name).isin(*VALID_EXTENSIONS), F.lit(False))


def has_binary_extension(name: Column) -> Column:
    return F.coalesce(last_extension(name).isin(*BINARY_EXTENSIONS), F.lit(False))


def fallback_name(url: Column) -> Column:
    return F.concat(F.lit("safe_file_"), F.substr(F.md5(url.cast("binary")), F.lit(1), F.lit(12)), F.lit(".html"))


def local_path(url: Column, base_url: Column, unicode: bool = False) -> Column:
    """The path of a URL's local file, relative to the output directory, always inside it.

    ``unicode`` normalises non-ASCII names (NFKC), which takes a Python step.
    """
    raw = F.regexp_replace(urls.percent_decoded(urls.path(url), plus=False), r"[\x00\n\r]", "")
    if unicode:
        raw = nfkc(raw)
    parts = F.transform(F.filter(F.split(raw, "/"), lambda c: (c != "") & ~c.contains("..") & ~c.contains("\\")), lambda c: sanitized_name(c))
    every = F.concat(F.array(sanitized_name(urls.authority(url))), F.filter(parts, lambda c: ~c.isin("", ".", "..")))

    def marked(last: Column, q: Column) -> Column:
        mark = F.concat(F.lit("_q"), F.substr(F.md5(q.cast("binary")), F.lit(1), F.lit(8)))
        stem, ext = F.regexp_extract(last, r"(?s)^(.*)\.[^.]*$", 1), F.regexp_extract(last, r"(?s)\.([^.]*)$", 1)
        return F.when(q == "", last).when(last.contains("."), F.concat(stem, mark, F.lit("."), sanitized_extension(ext))).otherwise(F.concat(last, mark, F.lit(".html")))

    def named(m: Column) -> Column:
        return F.when(~m.contains("."), F.concat(m, F.lit("/index.html"))).when(has_valid_extension(m) | has_binary_extension(m), m).otherwise(F.concat(m, F.lit(".html")))

    def whole(x: Column) -> Column:
        name = urls.let(marked(F.element_at(x["every"], -1), x["q"]), named)
        return F.array_join(F.concat(F.slice(x["every"], F.lit(1), F.size(x["every"]) - 1), F.array(name)), "/")

    full = urls.let(F.struct(every.alias("every"), urls.query(url).alias("q")), whole)
    safe = urls.let(full, lambda p: F.when(p.rlike(r"(^|/)\.\.(/|$)") | p.startswith("/"), fallback_name(url)).otherwise(p))
    return F.when(url == base_url, F.lit("index.html")).otherwise(safe)


def mapped_path(file: Column, root: Column) -> Column:
    """The path below ``root`` with forward slashes; the file name alone where the file is outside."""
    f, r = F.replace(file, F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.startswith(f, F.concat(r, F.lit("/"))), F.substr(f, F.char_length(r) + 2)).otherwise(F.element_at(F.split(f, "/"), -1))


def relative_path(page_dir: Column, file: Column) -> Column:
    """``file`` from within ``page_dir``: one '../' per directory level, common prefixes kept."""
    levels = F.size(F.filter(F.split(page_dir, "/"), lambda p: (p != "") & (p != ".")))
    return F.concat(F.repeat(F.lit("../"), levels), F.replace(file, F.lit("\\"), F.lit("/")))


def is_safe_path(p: Column) -> Column:
    return F.coalesce(~p.contains(".."), F.lit(False))


def is_within(p: Column, base: Column) -> Column:
    """A path without '..' that is below ``base``, lexically."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return is_safe_path(p) & (~p.startswith("/") | F.startswith(F.concat(p, F.lit("/")), root))


def format_bytes(n: Column) -> Column:
    n = n.cast("double")
    out = F.format_string("%.1f TB", n / 1024**4)
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024**k)).otherwise(out)
    return out


def format_seconds(s: Column) -> Column:
    s = s.cast("double")
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))
