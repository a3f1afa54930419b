"""Asset categories, essential-for-rendering flags, and content sniffing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import css, urls

#: Suffixes of each category.
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".bmp", ".ico", ".tiff")
FONTS = (".woff", ".woff2", ".ttf", ".otf", ".eot")
STYLESHEETS = (".css", ".scss", ".sass")
SCRIPTS = (".js", ".mjs", ".ts")
MEDIA = (".mp4", ".webm", ".ogg", ".mp3", ".wav", ".m4a", ".aac")
DOCUMENTS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
CATEGORIES = ("stylesheets", "scripts", "images", "fonts", "media", "documents", "manifests", "service_workers", "preload", "other")
#: Parts of URLs that no page needs to render.
NON_ESSENTIAL_DOMAINS = ("twitter.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com", "google-analytics.com", "googletagmanager.com", "doubleclick.net", "googlesyndication.com", "hs-scripts.com", "hubspot.com", "mixpanel.com", "segment.com")
NON_ESSENTIAL_PATTERNS = ("xmlrpc.php", "wp-json", "wp-admin", "wp-login", "analytics", "tracking", "gtag", "facebook.com", "twitter.com", "linkedin.com")
NON_ESSENTIAL_ERRORS = ("File filtered by configuration", "HTTP 403", "HTTP 401")
#: Patterns by which content is taken for a style sheet or a page.
CSS_CONTENT = (r"\{[^}]*\}", r"[a-zA-Z-]+\s*:\s*[^;]+;", r"@import\s+", r"@media\s+")
HTML_CONTENT = (r"(?i)<html[^>]*>", r"(?i)<body[^>]*>", r"(?i)<head[^>]*>", r"(?i)<[a-zA-Z]+[^>]*>.*</[a-zA-Z]+>")


def by_suffix(ext: Column) -> Column:
    """The category of a suffix, or null."""
    return F.when(ext.isin(*IMAGES), "images").when(ext.isin(*FONTS), "fonts").when(ext.isin(*STYLESHEETS), "stylesheets").when(ext.isin(*SCRIPTS), "scripts").when(ext.isin(*MEDIA), "media").when(ext.isin(*DOCUMENTS), "documents")


def asset_category(url: Column, tag: Column | None = None, attr: Column | None = None) -> Column:
    """By suffix, else by the element that refers to the URL, else 'other'."""
    out = urls.let(urls.url_ext(url), by_suffix)
    if tag is not None:
        attr = F.lit(None).cast("string") if attr is None else attr
        out = F.coalesce(out, F.when(tag.isin("img", "picture"), "images").when(tag == "script", "scripts").when((tag == "link") & (attr == "href"), "stylesheets").when(tag.isin("audio", "video", "source"), "media"))
    return F.coalesce(out, F.lit("other"))


def css_asset_category(url: Column, prop: Column) -> Column:
    """Fonts and style sheets by suffix, images by property, the rest by suffix."""
    rule = lambda ext: F.when(ext.isin(*FONTS), "fonts").when(ext.isin(*STYLESHEETS), "stylesheets").when(prop.isin(*css.IMAGE_PROPERTIES), "images").otherwise(F.coalesce(by_suffix(ext), F.lit("other")))
    return urls.let(urls.url_ext(url), rule)


def _any_in(text: Column, parts: tuple[str, ...]) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def is_essential(url: Column, error: Column) -> Column:
    """False for trackers, social media, administration paths and refused or filtered files."""
    low = F.lower(url)
    return ~(_any_in(low, NON_ESSENTIAL_DOMAINS) | _any_in(low, NON_ESSENTIAL_PATTERNS) | _any_in(F.coalesce(error, F.lit("")), NON_ESSENTIAL_ERRORS))


def _any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def looks_like_css(text: Column) -> Column:
    return _any_match(text, CSS_CONTENT)


def looks_like_html(text: Column) -> Column:
    return _any_match(text, HTML_CONTENT)
