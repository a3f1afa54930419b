"""SQL expressions of the URL algebra for the oracle engine."""

from __future__ import annotations

from ..functions import css, paths, urls
from ..functions import classify as c

SPLIT = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cleaned(u: str) -> str:
    return rf"regexp_replace(regexp_replace({u}, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g')"


def part(u: str, k: int) -> str:
    return f"regexp_extract({cleaned(u)}, {q(SPLIT)}, {k})"


def scheme(u: str) -> str:
    return f"lower({part(u, 1)})"


def authority(u: str) -> str:
    return part(u, 2)


def domain(u: str) -> str:
    return f"lower({part(u, 2)})"


def whole_path(u: str) -> str:
    return part(u, 3)


def path(u: str) -> str:
    return f"regexp_extract({part(u, 3)}, '(?s)^((?:[^/]*/)*[^/;]*)', 1)"


def params(u: str) -> str:
    return f"regexp_extract({part(u, 3)}, '(?s)^(?:[^/]*/)*[^/;]*;(.*)$', 1)"


def query(u: str) -> str:
    return part(u, 4)


def fragment(u: str) -> str:
    return part(u, 5)


def ext(u: str) -> str:
    last = f"string_split(regexp_replace({path(u)}, '/+$', ''), '/')[-1]"
    return rf"lower(regexp_extract({last}, '(?s)^\.*[^.].*?(\.[^.]+)$', 1))"


def isin(x: str, options) -> str:
    return f"{x} IN ({', '.join(q(o) for o in options)})"


def contains_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def normal_path(p: str) -> str:
    parts = f"list_filter(string_split({p}, '/'), lambda x: x <> '' AND x <> '.')"
    fold = f"list_reduce(list_transform({parts}, lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))"
    body = f"('/' || array_to_string({fold}, '/'))"
    return f"(CASE WHEN {p} LIKE '%/' AND {body} NOT LIKE '%/' THEN {body} || '/' ELSE {body} END)"


def normal_query(x: str) -> str:
    decode = lambda s: f"url_decode(replace({s}, '+', ' '))"
    encode = lambda s: f"replace(url_encode({s}), '%20', '+')"
    pairs = f"list_filter(list_transform(string_split({x}, '&'), lambda s, i: struct_pack(k := {decode('regexp_extract(s, ' + q('(?s)^([^=]*)=') + ', 1)')}, i := i, v := {decode('regexp_extract(s, ' + q('(?s)^[^=]*=(.*)$') + ', 1)')})), lambda p: p.v <> '')"
    return f"array_to_string(list_transform(list_sort({pairs}), lambda p: {encode('p.k')} || '=' || {encode('p.v')}), '&')"


def canonical(u: str) -> str:
    nq = f"(CASE WHEN {query(u)} <> '' THEN {normal_query(query(u))} ELSE '' END)"
    return f"({scheme(u)} || '://' || {domain(u)} || {normal_path(path(u))} || CASE WHEN {params(u)} <> '' THEN ';' || {params(u)} ELSE '' END || CASE WHEN {nq} <> '' THEN '?' || {nq} ELSE '' END)"


def without_dots(p: str) -> str:
    fold = f"array_to_string(list_reduce(list_transform(string_split({p}, '/'), lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[])), '/')"
    return rf"(CASE WHEN regexp_matches({p}, '(^|/)\.\.?$') AND {fold} NOT LIKE '%/' THEN {fold} || '/' ELSE {fold} END)"


def join(base: str, ref: str) -> str:
    tail = lambda a, f: f"(CASE WHEN {a} <> '' THEN '?' || {a} ELSE '' END || CASE WHEN {f} <> '' THEN '#' || {f} ELSE '' END)"
    own, bp = whole_path(ref), whole_path(base)
    merged = f"(CASE WHEN {own} LIKE '/%' THEN {own} ELSE (CASE WHEN {bp} = '' THEN '/' ELSE regexp_extract({bp}, '(?s)^(.*/)', 1) END) || {own} END)"
    head = f"({scheme(base)} || '://' || {authority(base)})"
    rq = f"(CASE WHEN {query(ref)} <> '' THEN {query(ref)} ELSE {query(base)} END)"
    r = cleaned(ref)
    return (
        f"(CASE WHEN {r} = '' THEN {base} WHEN {scheme(ref)} <> '' AND {scheme(ref)} <> {scheme(base)} THEN {r} "
        f"WHEN {authority(ref)} <> '' THEN {scheme(base)} || '://' || {authority(ref)} || {own} || {tail(query(ref), fragment(ref))} "
        f"WHEN {own} = '' THEN {head} || {bp} || {tail(rq, fragment(ref))} ELSE {head} || {without_dots(merged)} || {tail(query(ref), fragment(ref))} END)"
    )


def suspicious(u: str) -> str:
    return contains_any(f"lower({u})", urls.SUSPICIOUS)


def skipped(u: str) -> str:
    return f"coalesce(regexp_matches({u}, '(?i)^({'|'.join(urls.SKIPPED_SCHEMES)}):') OR {u} LIKE '#%' OR trim({u}) = '' OR {suspicious(u)}, TRUE)"


def fetchable(u: str) -> str:
    return f"coalesce({isin(scheme(u), ('http', 'https'))} AND {authority(u)} <> '' AND length({u}) <= {urls.MAX_URL_LENGTH}, FALSE)"


def private_host(u: str) -> str:
    return "regexp_matches(" + domain(u) + ", '^(" + "|".join(p.replace(".", r"\.") for p in urls.PRIVATE_PREFIXES) + ")')"


def resolve_from(source: str, ref: str, page: str, mode: str) -> str:
    """A query with every column of ``source`` and ``asset`` (null where the reference does not resolve)."""
    fixed = f"(CASE WHEN trim({ref}) LIKE '//%' THEN {scheme(page)} || ':' || trim({ref}) ELSE trim({ref}) END)"
    strict = f" AND {fetchable('_r')}" if mode == "strict" else ""
    return (
        f"SELECT * EXCLUDE (_r, _full), CASE WHEN NOT {skipped('trim(' + ref + ')')} AND {fetchable('_full')} AND NOT {private_host('_full')}{strict} THEN {canonical('_full')} END AS asset "
        f"FROM (SELECT *, {join(page, '_r')} AS _full FROM (SELECT *, {fixed} AS _r FROM {source}))"
    )


def category(e: str, tag: str | None = None, attr: str | None = None) -> str:
    cases = "".join(f" WHEN {isin(e, options)} THEN '{name}'" for name, options in (("images", c.IMAGES), ("fonts", c.FONTS), ("stylesheets", c.STYLESHEETS), ("scripts", c.SCRIPTS), ("media", c.MEDIA), ("documents", c.DOCUMENTS)))
    if tag:
        cases += f" WHEN {tag} IN ('img', 'picture') THEN 'images' WHEN {tag} = 'script' THEN 'scripts' WHEN {tag} = 'link' AND {attr} = 'href' THEN 'stylesheets' WHEN {tag} IN ('audio', 'video', 'source') THEN 'media'"
    return f"(CASE{cases} ELSE 'other' END)"


def css_category(e: str, prop: str) -> str:
    return f"(CASE WHEN {isin(e, c.FONTS)} THEN 'fonts' WHEN {isin(e, c.STYLESHEETS)} THEN 'stylesheets' WHEN {isin(prop, css.IMAGE_PROPERTIES)} THEN 'images' ELSE {category(e)} END)"


def essential(u: str, error: str) -> str:
    return f"NOT ({contains_any(f'lower({u})', c.NON_ESSENTIAL_DOMAINS)} OR {contains_any(f'lower({u})', c.NON_ESSENTIAL_PATTERNS)} OR {contains_any(f'coalesce({error}, {q("")})', c.NON_ESSENTIAL_ERRORS)})"


def sanitized(n: str) -> str:
    base = rf"regexp_replace(regexp_replace({n}, '\.\.|/|\\', '_', 'g'), '[\x00\n\r]', '', 'g')"
    s = rf"regexp_replace(regexp_replace(regexp_replace({base}, '[^\p{{L}}\p{{N}}_\s.\-]', '_', 'g'), '[\x00-\x1f\x7f]', '', 'g'), '^[. ]+|[. ]+$', '', 'g')"
    s = f"(CASE WHEN {isin(f'upper({s})', paths.RESERVED_NAMES)} THEN '_' || {s} ELSE {s} END)"
    return f"(CASE WHEN {s} IN ('', '.') THEN 'unnamed' ELSE {s} END)"


def tokens(u: str) -> str:
    none = "CAST([] AS VARCHAR[])"
    return (
        f"list_concat(list_concat(list_concat(CASE WHEN {scheme(u)} <> '' THEN [{scheme(u)}] ELSE {none} END, CASE WHEN {domain(u)} <> '' THEN list_reverse(string_split({domain(u)}, '.')) ELSE {none} END), "
        f"list_filter(string_split({path(u)}, '/'), lambda p: p <> '')), CASE WHEN {query(u)} <> '' THEN ['?' || {query(u)}] ELSE {none} END)"
    )


def matches(text: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {q(pattern)}, 1), lambda m: trim(m))"


def union(*lists: str) -> str:
    """Distinct entries of the lists; order does not matter to the queries that use it."""
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return f"list_distinct({out})"
