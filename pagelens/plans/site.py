"""Queries over style sheets, scripts and link graphs that both sides derive from ``pages`` by the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import css
from ..operators import discover, graph, rewrite
from . import sql as S
from .queries import _pages, query

#: Names that depend on the page, and a single quote.
K1, K2, K3 = (f"substr(md5(concat(url, '{k}')), 1, 6)" for k in (1, 2, 3))
Q = "chr(39)"
#: A style sheet for every page: imports of other pages' sheets (some missing), nested rules, fonts, image sets, custom properties, a long data URI, and comments and strings that look like rules.
SHEET = f"""concat('/* .old{{background:url(/c/', {K1}, '.png)}} */ ',
  CASE WHEN page_id % 5 <> 0 THEN concat('@import "p', page_id + 3, '.css"; ') ELSE '' END,
  CASE WHEN page_id % 11 = 0 THEN concat('@import url( p', page_id - 2, '.css ) screen; ') ELSE '' END,
  '@media print{{.a:hover{{color:red;background:url( "/i/', {K1}, '.png" )}}}} ',
  '@font-face{{font-family:x;src:url(/f/', {K2}, '.woff2) format("woff2"),url(', {Q}, '/f/', {K2}, '.ttf', {Q}, ')}} ',
  '.b{{content:"/* url(/n/', {K3}, '.gif)";mask-image:image-set("/i/', {K3}, '.webp" 1x, url(/i/', {K3}, '.jpg) 2x);--pic:url(/v/', {K2}, '.svg)}} ',
  '.c{{cursor:url(data:image/png;base64,', repeat('QUJD', 2000), '),url(/u/', {K1}, '.cur);x-thing:url("data:font/ttf;base64,', repeat('QUJD', 2000), '")}} ',
  '.d{{background:image-set(url(/m/', {K2}, '.png) 1x)}} .e{{filter:url(#f);backdrop-filter:url(/y/', {K3}, '.svg)}} /* open url(/o/', {K3}, '.png)')"""
CSS_URL = "concat('https://e.com/s/p', page_id, '.css')"
SHEETS = f"(SELECT page_id, url, {CSS_URL} AS css_url, {SHEET} AS css FROM pages)"
SCRIPT = f"""concat('load(', {Q}, '/js/', {K1}, '.js', {Q}, '); var o={{src: "', {K2}, '/img.png", url:', {Q}, 'api/', page_id, {Q}, ', href : ', {Q}, 'y', page_id, '.css', {Q}, '}};',
  CASE WHEN page_id % 3 = 0 THEN concat('navigator.serviceWorker.register(', {Q}, '/sw', page_id, '.js', {Q}, ');') ELSE '' END,
  CASE WHEN page_id % 4 = 0 THEN concat('registerServiceWorker(', {Q}, 'w', {K3}, '.js', {Q}, ')') ELSE '' END)"""
SRCSET = f"concat('/i/', {K1}, '.png 1x, /i/', {K2}, '.png 2x,', CASE WHEN page_id % 2 = 0 THEN '  /i/b.png 640w' ELSE '' END)"


def _sheets(spark, d) -> DataFrame:
    return _pages(spark, d).selectExpr("page_id", "url", f"{CSS_URL} AS css_url", f"{SHEET} AS css")


# What the lexer must find, by regular expressions that know how these sheets are written.
_BARE = rf"regexp_replace(regexp_replace(regexp_replace(css, 'content:\"[^\"]*\"', 'content:none', 'g'), '(?s)/\*.*?(\*/|$)', ' ', 'g'), 'url\(\"?data:[^)]*\)', 'none', 'g')"
_PIECES = f"(SELECT *, unnest(regexp_split_to_array(regexp_replace(bare, '@import [^;]*;', '', 'g'), '[{{}};]')) AS piece FROM (SELECT *, {_BARE} AS bare FROM {SHEETS}))"
LEXED = (
    f"(SELECT page_id, css_url, unnest(regexp_extract_all({_BARE}, '@import (?:url\\( *)?\"?([^\" );]+)', 1)) AS ref, 'import' AS kind, NULL AS property FROM {SHEETS} "
    f"UNION ALL SELECT page_id, css_url, unnest(regexp_extract_all(piece, '/[a-z]/[0-9a-f]{{6}}\\.[a-z0-9]+')), 'declaration', regexp_extract(piece, '^ *([-a-z]+):', 1) FROM {_PIECES})"
)
ASSETS = f"(SELECT DISTINCT css_url, CASE WHEN kind = 'import' THEN 'stylesheets' ELSE {S.css_category(S.ext('asset'), 'property')} END AS category, asset, kind, property FROM (SELECT *, 'https://e.com' || CASE WHEN ref LIKE '/%' THEN ref ELSE '/s/' || ref END AS asset FROM {LEXED}))"


@query(f"SELECT page_id, ref, kind, property FROM {LEXED}")
def style_references(spark, d):
    """Style elements of the pages, read by the lexer; data URIs and fragments are left out here."""
    pages = _pages(spark, d).selectExpr("page_id", "url", f"replace(html, '<style>p{{margin:0}}</style>', concat('<style>', {SHEET}, '</style>')) AS html")
    return discover.style_references(pages).filter(~F.col("ref").rlike("^(data:|#)")).select("page_id", "ref", "kind", "property")


@query(f"SELECT page_id, unnest({S.union(S.matches('css', css.CSS_URL), S.matches('css', css.CSS_IMPORT))}) AS ref FROM {SHEETS}")
def extract_css(spark, d):
    return _sheets(spark, d).select("page_id", F.explode(css.css_urls(F.col("css"))).alias("ref"))


@query(f"SELECT DISTINCT css_url, category, asset FROM {ASSETS}")
def discover_css(spark, d):
    return discover.discover_css(_sheets(spark, d))


@query(f"SELECT DISTINCT css_url, category, asset FROM {ASSETS} WHERE kind = 'import' OR {S.isin('property', css.URL_PROPERTIES)}")
def discover_css_properties(spark, d):
    """Only properties that are known to hold a url()."""
    return discover.discover_css(_sheets(spark, d), properties=css.URL_PROPERTIES)


@query(f"SELECT page_id, unnest(regexp_extract_all(css, '/[cno]/[0-9a-f]{{6}}\\.[a-z]+')) AS ref FROM {SHEETS}")
def discover_css_comments(spark, d):
    """What a pattern finds in comments and strings and the lexer does not."""
    sheets = _sheets(spark, d)
    seen = sheets.select("page_id", F.explode(css.css_urls(F.col("css"))).alias("ref"))
    real = discover.sheet_references(sheets, "page_id").select(F.col("css_url").alias("page_id"), "ref")
    return seen.join(real, ["page_id", "ref"], "left_anti")


_STORED = "page_id % 4 <> 1"
_KNOWN = f"(SELECT css_url AS asset FROM {SHEETS} UNION SELECT 'https://e.com/i/' || {K1} || '.png' FROM pages WHERE page_id % 3 = 0)"


def _results(spark, d) -> DataFrame:
    """What fetching gave: the sheets, one in four not, and some images."""
    sheets = _pages(spark, d).selectExpr(f"{CSS_URL} AS url", f"{_STORED} AS success", f"CASE WHEN {_STORED} THEN concat('s/p', page_id, '.css') END AS local_path")
    return sheets.unionByName(_pages(spark, d).filter("page_id % 3 = 0").selectExpr(f"concat('https://e.com/i/', {K1}, '.png') AS url", "true AS success", "'i' AS local_path").distinct())


def _texts(spark, d) -> DataFrame:
    return _sheets(spark, d).select(F.col("css_url").alias("url"), "css")


@query(f"SELECT DISTINCT css_url, category, asset FROM {ASSETS} WHERE css_url IN (SELECT {CSS_URL} FROM pages WHERE {_STORED}) AND asset NOT IN (SELECT asset FROM {_KNOWN})")
def sheet_step(spark, d):
    """What one scan of the fetched sheets adds."""
    return discover.sheet_step(_results(spark, d), _texts(spark, d))


IMPORTS = f"(SELECT DISTINCT css_url AS src, asset AS dst FROM {ASSETS} WHERE kind = 'import')"
_FETCHED = f"(SELECT * FROM {IMPORTS} WHERE src IN (SELECT {CSS_URL} FROM pages WHERE {_STORED}))"


def _closed(edges: str, seeds: str) -> str:
    """The end of a query: nodes within eight steps of the seeds."""
    return f"WITH RECURSIVE edges AS MATERIALIZED (SELECT * FROM {edges}), r(node, depth) AS (SELECT {CSS_URL}, 0 FROM pages WHERE {seeds} UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 8), c AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"


def _seeds(spark, d, which: str) -> DataFrame:
    return _pages(spark, d).filter(which).selectExpr(f"{CSS_URL} AS node")


def _imports(spark, d) -> DataFrame:
    """(src, dst) of all sheets, fetched or not."""
    every = _pages(spark, d).selectExpr(f"{CSS_URL} AS url", "true AS success", "'s' AS local_path")
    return discover.import_edges(every, _texts(spark, d))


@query(f"{_closed(_FETCHED, 'page_id % 40 = 0')} SELECT node, depth FROM c")
def sheet_closure(spark, d):
    """The closure of imports, from fetched sheets."""
    return graph.css_closure(discover.import_edges(_results(spark, d), _texts(spark, d)), _seeds(spark, d, "page_id % 40 = 0"))


@query(f"{_closed(IMPORTS, 'page_id % 50 = 7')} SELECT node, depth FROM c")
def css_closure(spark, d):
    return graph.css_closure(_imports(spark, d), _seeds(spark, d, "page_id % 50 = 7"))


@query(f"{_closed(IMPORTS, 'page_id % 50 = 7')} SELECT max(depth)::BIGINT AS max_depth, count(*) AS files, (SELECT count(*) FROM edges WHERE src IN (SELECT node FROM c)) AS imports FROM c")
def css_depth(spark, d):
    edges = _imports(spark, d)
    return graph.closure_summary(graph.css_closure(edges, _seeds(spark, d, "page_id % 50 = 7")), edges)


#: Which links follow each other in the navigation of a page, by the first letters of their targets.
_NAV = "list_transform(regexp_extract_all(html, '<li><a href=\"/([^\"]{1,3})', 1), lambda x: lower(x))"
HOPS = f"(SELECT DISTINCT src, dst FROM (SELECT unnest(nav[:len(nav) - 1]) AS src, unnest(nav[2:]) AS dst FROM (SELECT {_NAV} AS nav FROM pages WHERE page_id % 2 = 0)))"
_REACH = f"WITH RECURSIVE hops AS MATERIALIZED (SELECT * FROM {HOPS}), reach(s, d) AS (SELECT src, dst FROM hops UNION SELECT r.s, e.dst FROM reach r JOIN hops e ON e.src = r.d), nodes AS (SELECT src AS node FROM hops UNION SELECT dst FROM hops)"


def _hops(spark, d) -> DataFrame:
    nav = _pages(spark, d).filter("page_id % 2 = 0").select(F.transform(F.regexp_extract_all("html", F.lit('<li><a href="/([^"]{1,3})'), F.lit(1)), F.lower).alias("nav"))
    pairs = nav.select(F.explode(F.arrays_zip(F.expr("slice(nav, 1, greatest(size(nav) - 1, 0))").alias("src"), F.expr("slice(nav, 2, greatest(size(nav) - 1, 0))").alias("dst"))).alias("e"))
    return pairs.select("e.*").distinct()


@query(f"{_REACH} SELECT node, least(node, coalesce(m, node)) AS component, coalesce(n, 1) AS size FROM nodes LEFT JOIN (SELECT a.s, min(a.d) AS m, count(DISTINCT a.d) AS n FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s GROUP BY a.s) ON s = node")
def link_components(spark, d):
    """Strongly connected components of the link graph."""
    return graph.strong_components(_hops(spark, d))


@query(f"{_REACH}, cyc AS (SELECT s FROM reach WHERE s = d) SELECT node, node IN (SELECT s FROM cyc) OR node IN (SELECT s FROM reach WHERE d IN (SELECT s FROM cyc)) AS reaches_cycle FROM nodes".replace(HOPS, IMPORTS))
def css_cycles(spark, d):
    return graph.on_cycles(_imports(spark, d))


@query(" UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, unnest({S.matches('css', p)}) AS ref FROM {SHEETS}" for k, p in (("variable", css.CSS_VARIABLE), ("image_set", css.CSS_IMAGE_SET), ("filter", css.CSS_FILTER))))
def extract_modern_css(spark, d):
    kinds = F.create_map(*[x for k, p in (("variable", css.CSS_VARIABLE), ("image_set", css.CSS_IMAGE_SET), ("filter", css.CSS_FILTER)) for x in (F.lit(k), css.all_matches(F.col("css"), p))])
    return _sheets(spark, d).select("page_id", F.explode(kinds).alias("kind", "refs")).select("page_id", "kind", F.explode("refs").alias("ref"))


_SCRIPTS = f"(SELECT page_id, {SCRIPT} AS script FROM pages)"


@query(f"SELECT page_id, unnest({S.union(*(S.matches('script', p) for p in css.SCRIPT_PATTERNS))}) AS ref FROM {_SCRIPTS}")
def extract_script(spark, d):
    return _pages(spark, d).selectExpr("page_id", f"{SCRIPT} AS script").select("page_id", F.explode(css.script_urls(F.col("script"))).alias("ref"))


@query(f"SELECT page_id, unnest({S.union(*(S.matches('script', p) for p in css.WORKER_PATTERNS))}) AS ref FROM {_SCRIPTS} WHERE contains(lower(script), 'serviceworker')")
def extract_workers(spark, d):
    return _pages(spark, d).selectExpr("page_id", f"{SCRIPT} AS script").select("page_id", F.explode(css.worker_urls(F.col("script"))).alias("ref"))


@query(f"SELECT page_id, unnest(list_filter(list_transform(string_split({SRCSET}, ','), lambda p: regexp_extract(trim(p), '^(\\S+)', 1)), lambda u: u <> '')) AS ref FROM pages")
def extract_srcset(spark, d):
    return _pages(spark, d).selectExpr("page_id", f"{SRCSET} AS value").select("page_id", F.explode(css.srcset_urls(F.col("value"))).alias("ref"))


_MOVED = f"(SELECT 'https://e.com/i/' || {K1} || '.png' AS asset FROM pages WHERE page_id % 3 = 0)"


@query(f"SELECT page_id, md5(CASE WHEN hit THEN replace(css, '/i/' || {K1} || '.png', '../img/' || {K1} || '.png') ELSE css END) AS css_md5, CASE WHEN hit THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT *, 'https://e.com/i/' || {K1} || '.png' IN (SELECT asset FROM {_MOVED}) AS hit FROM {SHEETS})")
def rewrite_css(spark, d):
    """Sheets rewritten against the images that some pages stored."""
    sheets = _sheets(spark, d).withColumn("page_dir", F.lit("s"))
    mapping = _pages(spark, d).filter("page_id % 3 = 0").selectExpr(f"concat('https://e.com/i/', {K1}, '.png') AS url", f"concat('img/', {K1}, '.png') AS relative_url").distinct()
    return rewrite.rewrite_sheets(sheets, mapping).select("page_id", F.md5(F.col("css").cast("binary")).alias("css_md5"), "status")


#: Markup for every page that each of the nine extractors reads; what a page has depends on its number.
MARKUP = f"""concat('<img src="/i/', {K1}, '.png" srcset="/s/', {K1}, '.png 1x, /s/', {K2}, '.png 2x"><p style="background:url(/b/', {K2}, '.png)">t</p>',
  '<style>.q{{background:url(/t/', {K3}, '.png);--pic:url(/v/', {K1}, '.svg)}}.r{{backdrop-filter:url(/y/', {K3}, '.svg)}}</style>',
  '<script src="/j/', {K2}, '.js"></script><script>load(', {Q}, '/js/', {K1}, '.js', {Q}, ');',
  CASE WHEN page_id % 3 = 0 THEN concat('navigator.serviceWorker.register(', {Q}, '/sw/', {K3}, '.js', {Q}, ');') ELSE '' END, '</script>',
  CASE WHEN page_id % 4 = 0 THEN concat('<META Property="og:image" content="/o/', {K1}, '.png">') ELSE '' END,
  '<meta name="msapplication-TileImage" content="/w/', {K2}, '.png"><meta http-equiv="refresh" content="5; url=/r/', {K3}, '">',
  '<link rel="Manifest" href="/m/', {K1}, '.json"><link rel="x preload" as="font" href="/p/', {K2}, '.woff2">')"""
_MARKED = f"(SELECT page_id, {K1} AS k1, {K2} AS k2, {K3} AS k3 FROM pages)"
#: What each extractor must find: its name, the reference, the category that it sets, and the pages that have it.
_EXPECTED = [
    ("attribute", "'/i/' || k1 || '.png'", None, "true"), ("attribute", "'/s/' || k1 || '.png'", None, "true"), ("attribute", "'/s/' || k2 || '.png'", None, "true"), ("attribute", "'/j/' || k2 || '.js'", None, "true"),
    ("attribute", "'/r/' || k3", None, "true"), ("attribute", "'/m/' || k1 || '.json'", None, "true"), ("attribute", "'/p/' || k2 || '.woff2'", None, "true"),
    ("inline_style", "'/b/' || k2 || '.png'", None, "true"), ("style_tag", "'/t/' || k3 || '.png'", None, "true"), ("style_tag", "'/v/' || k1 || '.svg'", None, "true"), ("style_tag", "'/y/' || k3 || '.svg'", None, "true"),
    ("script", "'/js/' || k1 || '.js'", None, "true"), ("service_worker", "'/sw/' || k3 || '.js'", "service_workers", "page_id % 3 = 0"), ("script", "'/sw/' || k3 || '.js'", None, "page_id % 3 = 0"),
    ("meta", "'/o/' || k1 || '.png'", None, "page_id % 4 = 0"), ("meta", "'/w/' || k2 || '.png'", "other", "true"), ("manifest", "'/m/' || k1 || '.json'", "manifests", "true"),
    ("preload", "'/p/' || k2 || '.woff2'", "preload", "true"), ("preload", "'/p/' || k2 || '.woff2'", "fonts", "true"), ("modern_css", "'/v/' || k1 || '.svg'", None, "true"), ("modern_css", "'/y/' || k3 || '.svg'", "other", "true"),
]


@query(
    "SELECT page_id, 'attribute' AS via, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS raw, NULL AS category FROM pages UNION ALL "
    + " UNION ALL ".join(f"SELECT page_id, {S.q(via)}, {raw}, {S.q(kind) if kind else 'NULL'} FROM {_MARKED} WHERE {where}" for via, raw, kind, where in _EXPECTED)
)
def page_references(spark, d):
    """All nine extractors over every page and its own links."""
    pages = _pages(spark, d).selectExpr("page_id", "url", f"replace(html, '<body>', concat('<body>', {MARKUP})) AS html")
    return discover.references(discover.parsed(pages)).select("page_id", "via", "raw", "category")
