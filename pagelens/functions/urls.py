"""URL algebra as Catalyst expressions: split, join, canonicalise, resolve, classify hosts.

No Python runs here; every function takes and returns Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes that are never fetched.
SKIPPED_SCHEMES = ("data", "javascript", "mailto", "tel", "ftp", "file", "blob")
#: Parts of a reference that make it suspicious.
SUSPICIOUS = ("../", "..\\", "%2e%2e", "%2f%2e%2e", "file://", "ftp://", "ldap://", "gopher://")
#: Prefixes of hosts that are taken as private.
PRIVATE_PREFIXES = ("localhost", "127.", "10.", "192.168.", "172.")
#: Suffixes of files that can refer to further assets.
PROCESSABLE = (".html", ".htm", ".xhtml", ".css", ".scss", ".sass", ".js", ".json", ".xml", ".svg")
MAX_URL_LENGTH = 2048

_SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable, so that the plan does not repeat the value's expression."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def cleaned(url: Column) -> Column:
    """Without leading control characters and spaces, and without tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(cleaned(url), _SPLIT, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path_and_params(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def path(url: Column) -> Column:
    """The path before the ';' of its last segment."""
    return F.regexp_extract(path_and_params(url), r"(?s)^((?:[^/]*/)*[^/;]*)", 1)


def params(url: Column) -> Column:
    return F.regexp_extract(path_and_params(url), r"(?s)^(?:[^/]*/)*[^/;]*;(.*)$", 1)


_PATH = r"(?s)^((?:[^/]*/)*[^/;]*)"
_PARAMS = r"(?s)^(?:[^/]*/)*[^/;]*;(.*)$"


def split(url: Column) -> Column:
    """struct(scheme, authority, whole, path, params, query, fragment), each part matched once."""
    part = lambda u, k: F.regexp_extract(u, _SPLIT, k)
    return let(
        cleaned(url),
        lambda u: let(
            part(u, 3),
            lambda whole: F.struct(
                F.lower(part(u, 1)).alias("scheme"), part(u, 2).alias("authority"), whole.alias("whole"), F.regexp_extract(whole, _PATH, 1).alias("path"), F.regexp_extract(whole, _PARAMS, 1).alias("params"), part(u, 4).alias("query"), part(u, 5).alias("fragment")
            ),
        ),
    )


def url_parts(url: Column) -> Column:
    """struct(scheme, authority, path, params, query, fragment); absent parts are empty."""
    return let(split(url), lambda p: F.struct(*[p[k].alias(k) for k in ("scheme", "authority", "path", "params", "query", "fragment")]))


def domain(url: Column) -> Column:
    """The authority in lower case, with user information and port."""
    return F.lower(authority(url))


def same_domain(url: Column, base: Column) -> Column:
    return domain(url) == domain(base)


def suffix(p: Column) -> Column:
    """The lower-case suffix of a path's last segment with its dot; '' if none (also for 'name.' and '.name')."""
    last = F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1)
    return F.lower(F.regexp_extract(last, r"(?s)^\.*[^.].*?(\.[^.]+)$", 1))


def url_ext(url: Column) -> Column:
    return suffix(path(url))


def folded_segments(p: Column) -> Column:
    """The segments of a path without empty ones and '.', each '..' taking one away."""
    parts = F.filter(F.split(p, "/", -1), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.when(p.rlike(r"(^|/)\.\.(/|$)"), F.aggregate(parts, F.array().cast("array<string>"), step)).otherwise(parts)


def normal_path(p: Column) -> Column:
    body = F.concat(F.lit("/"), F.array_join(folded_segments(p), "/"))
    return let(body, lambda x: F.when(p.endswith("/") & ~x.endswith("/"), F.concat(x, F.lit("/"))).otherwise(x))


def percent_decoded(s: Column, plus: bool = True) -> Column:
    """Percent decoding that leaves malformed escapes; '+' becomes a space if ``plus``."""
    safe = F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe if plus else F.replace(safe, F.lit("+"), F.lit("%2B")))


def form_encoded(s: Column) -> Column:
    """Form encoding that keeps letters, digits and ``_.-~``; a space becomes '+'."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_query(q: Column) -> Column:
    """Pairs with a value, sorted by decoded key (equal keys keep their order), encoded again."""
    pairs = F.filter(F.transform(F.split(q, "&"), lambda s, i: F.struct(percent_decoded(F.regexp_extract(s, r"(?s)^([^=]*)=", 1)).alias("k"), i.alias("i"), percent_decoded(F.regexp_extract(s, r"(?s)^[^=]*=(.*)$", 1)).alias("v"))), lambda p: p["v"] != "")
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(form_encoded(p["k"]), F.lit("="), form_encoded(p["v"]))), "&")


def _optional(mark: str, s: Column) -> Column:
    return F.when(s != "", F.concat(F.lit(mark), s)).otherwise("")


def canonical_of(p: Column) -> Column:
    """``canonical`` of a split URL."""
    q = F.when(p["query"] != "", normal_query(p["query"])).otherwise("")
    return F.concat(p["scheme"], F.lit("://"), F.lower(p["authority"]), normal_path(p["path"]), _optional(";", p["params"]), let(q, lambda s: _optional("?", s)))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, folded path, sorted query, no fragment."""
    return F.when(url.isNotNull(), let(split(url), canonical_of))


def without_dots(p: Column) -> Column:
    """RFC 3986 dot-segment removal of an absolute path (empty segments stay)."""
    parts = F.split(p, "/", -1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return let(folded, lambda x: F.when(p.rlike(r"(^|/)\.\.?$") & ~x.endswith("/"), F.concat(x, F.lit("/"))).otherwise(x))


def _joined(base: Column, b: Column, ref: Column, r: Column) -> Column:
    """The join of a base and a (cleaned) reference, both also given in parts."""
    tail = lambda q: F.concat(_optional("?", q), _optional("#", r["fragment"]))
    merged = F.when(r["whole"].startswith("/"), r["whole"]).otherwise(F.concat(F.when(b["whole"] == "", F.lit("/")).otherwise(F.regexp_extract(b["whole"], r"(?s)^(.*/)", 1)), r["whole"]))
    head = F.concat(b["scheme"], F.lit("://"), b["authority"])
    return (
        F.when(ref == "", base)
        .when((r["scheme"] != "") & (r["scheme"] != b["scheme"]), ref)
        .when(r["authority"] != "", F.concat(b["scheme"], F.lit("://"), r["authority"], r["whole"], tail(r["query"])))
        .when(r["whole"] == "", F.concat(head, b["whole"], tail(F.when(r["query"] != "", r["query"]).otherwise(b["query"]))))
        .otherwise(F.concat(head, let(merged, without_dots), tail(r["query"])))
    )


def url_join(base: Column, ref: Column) -> Column:
    """RFC 3986 reference resolution; a reference with its own scheme or authority keeps its dot segments."""
    return let(F.struct(base.alias("base"), split(base).alias("b"), cleaned(ref).alias("ref"), split(ref).alias("r")), lambda x: _joined(x["base"], x["b"], x["ref"], x["r"]))


def is_suspicious(url: Column) -> Column:
    low = F.lower(url)
    out = low.contains(SUSPICIOUS[0])
    for s in SUSPICIOUS[1:]:
        out = out | low.contains(s)
    return out


def should_skip(url: Column) -> Column:
    """Schemes that are not fetched, fragments, blanks and suspicious references; null is skipped."""
    return F.coalesce(url.rlike(f"(?i)^({'|'.join(SKIPPED_SCHEMES)}):") | url.startswith("#") | (F.trim(url) == "") | is_suspicious(url), F.lit(True))


def is_fetchable(url: Column) -> Column:
    """Absolute http(s) with a host and of bounded length."""
    return F.coalesce(scheme(url).isin("http", "https") & (authority(url) != "") & (F.char_length(url) <= MAX_URL_LENGTH), F.lit(False))


def _is_private(host: Column, strict: bool) -> Column:
    out = host.rlike("^(" + "|".join(p.replace(".", r"\.") for p in PRIVATE_PREFIXES) + ")")
    if strict:
        bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
        out = out | bare.rlike(r"^(localhost$|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|\[(::1|::|f[cd]|fe[89ab]))")
    return out


def is_private_host(url: Column, strict: bool = False) -> Column:
    """Prefix test on the authority; ``strict`` also looks behind user information and at further local addresses."""
    return _is_private(domain(url), strict)


def _is_fetchable_parts(url: Column, p: Column) -> Column:
    return F.coalesce(p["scheme"].isin("http", "https") & (p["authority"] != "") & (F.char_length(url) <= MAX_URL_LENGTH), F.lit(False))


def resolve(ref: Column, page: Column, mode: str = "rfc3986", safe_hosts: bool = False) -> Column:
    """A reference on a page as a canonical URL, or null.

    ``rfc3986`` joins first and validates the result; ``strict`` accepts only
    absolute references (and '//host' ones), as a validator before the join does.
    """
    if mode not in ("rfc3986", "strict"):
        raise ValueError(f"unknown mode: {mode}")
    r = F.trim(ref)
    absolute = F.when(r.startswith("//"), F.concat(scheme(page), F.lit(":"), r)).otherwise(r)

    def checked(x: Column) -> Column:
        ok = _is_fetchable_parts(x["full"], x["p"]) & ~_is_private(F.lower(x["p"]["authority"]), safe_hosts)
        return F.when(ok, canonical_of(x["p"]))

    full = url_join(page, absolute)
    out = let(full, lambda u: let(F.struct(u.alias("full"), split(u).alias("p")), checked))
    keep = ~should_skip(r) & page.isNotNull()
    return F.when(keep & is_fetchable(absolute) if mode == "strict" else keep, out)


def safe_join(base: Column, ref: Column) -> Column:
    """Plain join where base and result are http(s), else null."""
    ok = lambda u: scheme(u).isin("http", "https") & (authority(u) != "")
    return F.when(ok(base), let(url_join(base, ref), lambda u: F.when(ok(u), u)))


def should_process(url: Column) -> Column:
    return url_ext(url).isin(*PROCESSABLE)
