"""The whole run over a snapshot: discover, scope, fetch, map, rewrite, account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import paths, urls
from ..operators import accounting, discover, graph, rewrite
from ..sources import readers


def link_closure(pages: DataFrame, settings: Settings) -> DataFrame:
    """(node, depth): the pages that the target's links reach within ``max_depth``."""
    refs = discover.references(discover.parsed(pages), ("attribute",)).filter("tag IN ('a', 'area') AND attr = 'href'")
    edges = discover.resolved(refs).filter(settings.follows(F.col("asset"), F.col("url"))).select(urls.canonical(F.col("url")).alias("src"), F.col("asset").alias("dst"))
    spark = pages.sparkSession
    seed = spark.createDataFrame([(settings.target_url,)], "u string").select(urls.canonical(F.col("u")).alias("node"))
    return graph.closure(edges, seed, settings.max_depth)


def site_run(pages: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Tables of a run over all pages: assets, results, mapping, rewritten pages, summary."""
    assets = discover.discover(pages)
    wanted = assets.filter(settings.in_scope(F.col("asset"))).select(F.col("asset").alias("url")).distinct()
    results = readers.fetch_from_snapshot(wanted, pages).withColumn("ts", F.current_timestamp())
    own = pages.select(urls.canonical(F.col("url")).alias("url"))
    mapping = rewrite.mapping_of_urls(results.filter("success").select("url").union(own), settings.target_url)
    placed = pages.withColumn("local_path", paths.local_path(urls.canonical(F.col("url")), F.lit(settings.target_url))).withColumn("page_dir", F.regexp_replace("local_path", "/?[^/]*$", ""))
    return {
        "assets": assets,
        "results": results.drop("content"),
        "mapping": mapping,
        "pages": rewrite.rewrite_pages(placed, mapping),
        "summary": accounting.run_summary(wanted, results),
    }
