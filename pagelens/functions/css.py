"""URLs in style sheets and scripts, by regular expressions that Spark and RE2 engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of references in style sheets and scripts.
CSS_URL = r"""(?i)url\s*\(\s*["']?([^"')]+)["']?\s*\)"""
CSS_IMPORT = r"""(?i)@import\s+["']([^"']+)["']"""
CSS_VARIABLE = r"""(?i)--[\w-]+\s*:\s*url\s*\(\s*["']?([^"')]+)["']?\s*\)"""
CSS_IMAGE_SET = r"""(?i)image-set\s*\(\s*url\s*\(\s*["']?([^"')]+)["']?\s*\)"""
CSS_FILTER = r"""(?i)(?:filter|backdrop-filter)\s*:\s*url\s*\(\s*["']?([^"')]+)["']?\s*\)"""
CSS_DECLARATION = r"""(?i)([a-z-]+)\s*:\s*[^;{}]*?url\s*\(\s*["']?[^"')]+["']?\s*\)"""
SCRIPT_PATTERNS = (
    r"""(?i)["']([^"']+\.(?:js|css|png|jpg|jpeg|gif|svg|webp|woff|woff2|ttf|otf))["']""",
    r"""(?i)src\s*:\s*["']([^"']+)["']""",
    r"""(?i)url\s*:\s*["']([^"']+)["']""",
    r"""(?i)href\s*:\s*["']([^"']+)["']""",
)
WORKER_PATTERNS = (
    r"""(?i)serviceWorker\.register\s*\(\s*["']([^"']+)["']""",
    r"""(?i)registerServiceWorker\s*\(\s*["']([^"']+)["']""",
    r"""(?i)register\s*\(\s*["']([^"']+)["'].*serviceWorker""",
)
#: Properties whose url() is an image.
IMAGE_PROPERTIES = ("background", "background-image", "border-image", "mask", "mask-image", "cursor")
#: Properties that may hold a url(); ``discover_css`` can be held to them.
URL_PROPERTIES = ("background", "background-image", "border-image", "border-image-source", "content", "cursor", "filter", "list-style-image", "mask", "mask-image", "shape-outside", "src")


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), lambda m: F.trim(m))


def css_urls(css: Column) -> Column:
    """url() references, then @import strings, each once."""
    return F.array_union(all_matches(css, CSS_URL), all_matches(css, CSS_IMPORT))


def css_declarations(css: Column) -> Column:
    """array<struct(property, url)> of declarations with a url()."""
    found = F.regexp_extract_all(F.coalesce(css, F.lit("")), F.lit(r"""(?i)([a-z-]+\s*:\s*[^;{}]*?url\s*\(\s*["']?[^"')]+["']?\s*\))"""), F.lit(1))
    return F.transform(found, lambda d: F.struct(F.lower(F.regexp_extract(d, r"(?i)^([a-z-]+)", 1)).alias("property"), F.trim(F.regexp_extract(d, CSS_URL, 1)).alias("url")))


def script_urls(script: Column) -> Column:
    out = all_matches(script, SCRIPT_PATTERNS[0])
    for p in SCRIPT_PATTERNS[1:]:
        out = F.array_union(out, all_matches(script, p))
    return out


def worker_urls(script: Column, exact_gate: bool = False) -> Column:
    """Service workers; ``exact_gate`` asks for 'serviceWorker' in this spelling first."""
    out = all_matches(script, WORKER_PATTERNS[0])
    for p in WORKER_PATTERNS[1:]:
        out = F.array_union(out, all_matches(script, p))
    none = F.array().cast("array<string>")
    gate = script.contains("serviceWorker") if exact_gate else F.lower(script).contains("serviceworker")
    return F.when(F.coalesce(gate, F.lit(False)), out).otherwise(none)


def srcset_urls(value: Column) -> Column:
    """The URL of each candidate; blank candidates are left out."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), 1)), lambda u: u != "")


def refresh_url(content: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(content, r"(?i)url=([^;]+)", 1)), F.lit(""))
