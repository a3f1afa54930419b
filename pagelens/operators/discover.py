"""From pages and style sheets to a long table of assets.

Pages are parsed once; nine extractors are projections of the element array,
so a page is read, parsed and exploded in one stage without a shuffle.  Set
semantics (one row per page, category and URL) cost one shuffle on those keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, css, csslex, html, urls
from ..functions.pieces import small_batches

PRELOAD_RELS = ("preload", "prefetch", "preconnect", "dns-prefetch", "modulepreload")
CARD_NAMES = ("twitter:image", "twitter:image:src")
CARD_PROPERTIES = ("og:image", "og:video", "og:audio")
TILE_NAMES = ("msapplication-tileimage", "msapplication-config")
AS_CATEGORY = {"style": "stylesheets", "script": "scripts", "image": "images", "font": "fonts"}

_FOUND = "array<struct<raw:string,via:string,tag:string,attr:string,category:string>>"


def parsed(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Pages with ``elements``; the only Python step of discovery."""
    return small_batches(pages).select(*keep, html.parse_elements(F.col(html_col)).alias("elements"))


def _row(raw: Column, via: str, tag: Column | None = None, attr: str | None = None, category: Column | str | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        raw.alias("raw"), F.lit(via).alias("via"), (null if tag is None else tag).alias("tag"), F.lit(attr).cast("string").alias("attr"), (null if category is None else F.lit(category) if isinstance(category, str) else category).alias("category")
    )


def _flat(parts: list[Column]) -> Column:
    return F.flatten(F.array(*[p.cast(_FOUND) for p in parts]))


def _attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def _low(e: Column, name: str) -> Column:
    return F.lower(F.coalesce(_attr(e, name), F.lit("")))


def _each(values: Column, via: str, e: Column | None = None, attr: str | None = None, category: Column | str | None = None) -> Column:
    return F.transform(values, lambda v: _row(v, via, None if e is None else e["tag"], attr, category))


def _if(cond: Column, value: Column) -> Column:
    """A one-element array where the condition holds and the value is not empty, else none."""
    return F.when(F.coalesce(cond & (value["raw"] != ""), F.lit(False)), F.array(value)).otherwise(F.array().cast(_FOUND))


def from_attributes(e: Column) -> Column:
    """Attribute URLs by (attribute, tag) rules, with srcset candidates and refresh targets."""
    parts = []
    for attr, tags in html.URL_ATTRIBUTES.items():
        here = e["tag"].isin(*tags)
        if attr == "srcset":
            parts.append(F.when(here, _each(css.srcset_urls(_attr(e, attr)), "attribute", e, attr)).otherwise(F.array().cast(_FOUND)))
        elif attr == "content":
            parts.append(_if(here & (_low(e, "http-equiv") == "refresh"), _row(css.refresh_url(_attr(e, attr)), "attribute", e["tag"], attr)))
        else:
            parts.append(_if(here, _row(_attr(e, attr), "attribute", e["tag"], attr)))
    return _flat(parts)


def from_inline_style(e: Column) -> Column:
    return _each(css.css_urls(_attr(e, "style")), "inline_style")


def from_style_tag(e: Column) -> Column:
    return F.when(e["tag"] == "style", _each(css.css_urls(e["text"]), "style_tag")).otherwise(F.array().cast(_FOUND))


def from_script(e: Column) -> Column:
    return F.when(e["tag"] == "script", _each(css.script_urls(e["text"]), "script")).otherwise(F.array().cast(_FOUND))


def from_meta(e: Column) -> Column:
    card = _low(e, "name").isin(*CARD_NAMES) | _low(e, "property").isin(*CARD_PROPERTIES)
    tile = ~card & _low(e, "name").isin(*TILE_NAMES)
    meta = e["tag"] == "meta"
    return _flat([_if(meta & card, _row(_attr(e, "content"), "meta")), _if(meta & tile, _row(_attr(e, "content"), "meta", category="other"))])


def _rels(e: Column) -> Column:
    return F.split(F.trim(_low(e, "rel")), r"\s+")


def from_manifest(e: Column) -> Column:
    return _if((e["tag"] == "link") & F.array_contains(_rels(e), "manifest"), _row(_attr(e, "href"), "manifest", category="manifests"))


def from_worker(e: Column, exact_gate: bool = False) -> Column:
    return F.when(e["tag"] == "script", _each(css.worker_urls(e["text"], exact_gate), "service_worker", category="service_workers")).otherwise(F.array().cast(_FOUND))


def from_preload(e: Column) -> Column:
    here = (e["tag"] == "link") & F.arrays_overlap(_rels(e), F.array(*map(F.lit, PRELOAD_RELS)))
    parts = [_if(here, _row(_attr(e, "href"), "preload", category="preload"))]
    for kind, category in AS_CATEGORY.items():
        parts.append(_if(here & (_low(e, "as") == kind), _row(_attr(e, "href"), "preload", category=category)))
    return _flat(parts)


def from_modern_css(e: Column) -> Column:
    """Custom properties (by suffix), image sets (images), filters that are no fragments (other)."""
    parts = []
    for text in (F.when(e["tag"] == "style", e["text"]), _attr(e, "style")):
        parts.append(_each(css.all_matches(text, css.CSS_VARIABLE), "modern_css"))
        parts.append(_each(css.all_matches(text, css.CSS_IMAGE_SET), "modern_css", category="images"))
        parts.append(_each(F.filter(css.all_matches(text, css.CSS_FILTER), lambda u: ~u.startswith("#")), "modern_css", category="other"))
    return _flat(parts)


EXTRACTORS = {
    "attribute": from_attributes,
    "inline_style": from_inline_style,
    "style_tag": from_style_tag,
    "script": from_script,
    "meta": from_meta,
    "manifest": from_manifest,
    "service_worker": from_worker,
    "preload": from_preload,
    "modern_css": from_modern_css,
}


def references(elements: DataFrame, extractors: tuple[str, ...] | None = None) -> DataFrame:
    """One row per raw reference: the columns of ``elements``, then seq, raw, via, tag, attr, category (null: by URL)."""
    chosen = [EXTRACTORS[k] for k in extractors or EXTRACTORS]
    keep = [c for c in elements.columns if c != "elements"]
    one = elements.select(*keep, F.explode("elements").alias("e"))
    # Elements that carry nothing are dropped before any pattern runs.
    one = one.filter((F.size("e.attrs") > 0) | F.col("e.text").isNotNull())
    found = _flat([f(F.col("e")) for f in chosen])
    return one.select(*keep, F.col("e.seq").alias("seq"), F.explode(found).alias("f")).select(*keep, "seq", "f.*")


def resolved(refs: DataFrame, page_url: str = "url", mode: str = "rfc3986", safe_hosts: bool = False) -> DataFrame:
    """Adds ``asset`` (null references are dropped) and fills ``category``."""
    out = refs.withColumn("asset", urls.resolve(F.col("raw"), F.col(page_url), mode, safe_hosts)).filter("asset IS NOT NULL")
    return out.withColumn("category", F.coalesce("category", classify.asset_category(F.col("asset"), F.col("tag"), F.col("attr"))))


def discover(pages: DataFrame, mode: str = "rfc3986", extractors: tuple[str, ...] | None = None, safe_hosts: bool = False) -> DataFrame:
    """Distinct (page_id, url, category, asset) of all pages."""
    return resolved(references(parsed(pages), extractors), mode=mode, safe_hosts=safe_hosts).select("page_id", "url", "category", "asset").distinct()


def asset_map(assets: DataFrame) -> DataFrame:
    """The dictionary view: page_id and a map from category to its sorted URLs."""
    each = assets.groupBy("page_id", "category").agg(F.sort_array(F.collect_set("asset")).alias("urls"))
    return each.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "urls")))).alias("assets"))


def discover_css(sheets: DataFrame, mode: str = "rfc3986", url_col: str = "css_url", css_col: str = "css", properties: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct (css_url, category, asset): imports are style sheets, declarations by property, the rest by suffix.

    Sheets are read by the lexer of ``csslex``: comments and strings hold no
    references.  With ``properties``, only imports and declarations of these
    properties count.
    """
    rows = sheet_references(sheets, url_col, css_col)
    if properties is not None:
        rows = rows.filter((F.col("kind") == "import") | F.col("property").isin(*properties))
    rows = rows.withColumn("asset", urls.resolve(F.col("ref"), F.col("css_url"), mode)).filter("asset IS NOT NULL")
    category = F.when(F.col("kind") == "import", "stylesheets").otherwise(classify.css_asset_category(F.col("asset"), F.coalesce("property", F.lit(""))))
    return rows.select("css_url", category.alias("category"), "asset").distinct()


def sheet_references(sheets: DataFrame, url_col: str = "css_url", css_col: str = "css") -> DataFrame:
    """One row per reference of a sheet: css_url, ref, kind (import, declaration, other), property, rule, func."""
    rows = small_batches(sheets).select(F.col(url_col).alias("css_url"), F.explode(csslex.css_references(F.col(css_col))).alias("f"))
    return rows.select("css_url", F.col("f.url").alias("ref"), "f.kind", "f.property", "f.rule", "f.func")


def style_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, seq, ref, kind, property, rule, func) of the pages' style elements."""
    styles = parsed(pages).select("page_id", "url", F.explode("elements").alias("e")).filter("e.tag = 'style'")
    rows = styles.select("page_id", "url", "e.seq", F.explode(csslex.css_references(F.col("e.text"))).alias("f"))
    return rows.select("page_id", "url", "seq", F.col("f.url").alias("ref"), "f.kind", "f.property", "f.rule", "f.func")


def fetched_sheets(results: DataFrame) -> DataFrame:
    """Results (url, success, local_path, ...) that are style sheets: fetched, stored, to process, and named so."""
    u = F.col("url")
    return results.filter(F.col("success") & F.col("local_path").isNotNull() & urls.should_process(u) & F.lower(u).contains(".css"))


def sheet_step(results: DataFrame, sheets: DataFrame, mode: str = "rfc3986") -> DataFrame:
    """Distinct (css_url, category, asset) of one batch of results: the fetched sheets' texts (url, css), that are not among the results yet."""
    texts = sheets.join(fetched_sheets(results).select("url").distinct(), "url", "left_semi").withColumnRenamed("url", "css_url")
    return discover_css(texts, mode).join(results.select(F.col("url").alias("asset")).distinct(), "asset", "left_anti").select("css_url", "category", "asset")


def import_edges(results: DataFrame, sheets: DataFrame, mode: str = "rfc3986") -> DataFrame:
    """Distinct (src, dst): what the fetched sheets import."""
    texts = sheets.join(fetched_sheets(results).select("url").distinct(), "url", "left_semi")
    rows = sheet_references(texts, "url").filter("kind = 'import'")
    return rows.select(F.col("css_url").alias("src"), urls.resolve(F.col("ref"), F.col("css_url"), mode).alias("dst")).filter("dst IS NOT NULL").distinct()


def per_category(assets: DataFrame) -> DataFrame:
    return assets.groupBy("category").agg(F.count("*").alias("n_assets"), F.count_distinct("asset").alias("n_urls"))


def union_assets(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).distinct()
