"""Golden vectors, properties and round trips of the page engine."""

import datetime
import importlib
import json
import random
import sys
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.config import Settings
from pagelens.functions import classify, css, csslex, html, paths, urls, validate
from pagelens.operators import accounting, discover, graph, index, netguard, repository, resilience, rewrite
from pagelens.sources import readers, sinks
from pagelens.streaming import events as stream

PAGE = "https://example.com/dir/page.html"

RESOLVED = [
    ("/x.css", None, "https://example.com/x.css"), ("x.css", None, "https://example.com/dir/x.css"), ("?a=1", None, "https://example.com/dir/page.html?a=1"), ("//cdn.ex.com/x.js", "https://cdn.ex.com/x.js", "https://cdn.ex.com/x.js"),
    ("https://Ex.com", "https://ex.com/", "https://ex.com/"), ("HTTP://Ex.com/a//b/./c?b=2&a=1#f", "http://ex.com/a/b/c?a=1&b=2", "http://ex.com/a/b/c?a=1&b=2"), ("https://ex.com/a/../b", None, None), ("https://ex.com/a/..", "https://ex.com/", "https://ex.com/"),
    ("https://ex.com/?flag", "https://ex.com/", "https://ex.com/"), ("https://ex.com/?a=&b=1", "https://ex.com/?b=1", "https://ex.com/?b=1"), ("https://ex.com/?q=a+b%20c~*", "https://ex.com/?q=a+b+c~%2A", "https://ex.com/?q=a+b+c~%2A"),
    ("https://ex.com/a;p?x=1", "https://ex.com/a;p?x=1", "https://ex.com/a;p?x=1"), ("https://ex.com:443/", "https://ex.com:443/", "https://ex.com:443/"), ("https://10.example.com/x", None, None), ("https://172.217.0.1/", None, None), ("#x", None, None), ("mailto:x", None, None), ("", None, None), ("ws://x", None, None), (None, None, None),
]


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_resolve_vectors(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in RESOLVED], "ref string")
    got = [tuple(r) for r in df.select(urls.resolve(F.col("ref"), F.lit(PAGE), "strict"), urls.resolve(F.col("ref"), F.lit(PAGE))).collect()]
    assert got == [(s, r) for _, s, r in RESOLVED]
    with pytest.raises(ValueError):
        urls.resolve(F.col("ref"), F.lit(PAGE), "other")


def test_safe_hosts(spark):
    df = spark.createDataFrame([("https://u:p@127.0.0.1/",), ("https://[::1]/",), ("https://172.217.0.1.nip.io/",)], "u string")
    loose = [r[0] for r in df.select(urls.resolve(F.col("u"), F.lit(PAGE))).collect()]
    safe = [r[0] for r in df.select(urls.resolve(F.col("u"), F.lit(PAGE), safe_hosts=True)).collect()]
    assert loose == ["https://u:p@127.0.0.1/", "https://[::1]/", None] and safe == [None, None, None]


segment = st.text("abcXY12._-~%20+", max_size=6)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(segment, max_size=4), st.lists(st.tuples(segment, segment), max_size=3)), min_size=1, max_size=12))
def test_canonical_is_idempotent(spark, drawn):
    made = [("https://Ex.org/" + "/".join(p) + ("?" + "&".join(f"{k}={v}" for k, v in q) if q else ""),) for p, q in drawn]
    df = spark.createDataFrame(made, "u string").select("u", urls.canonical(F.col("u")).alias("c"))
    for r in df.select("c", urls.canonical(F.col("c")).alias("again"), urls.resolve(F.col("u"), F.lit(PAGE)).alias("joined"), urls.resolve(F.col("u"), F.lit(PAGE), "strict").alias("strict")).collect():
        assert r["c"] == r["again"]
        assert r["strict"] is None or r["strict"] == r["joined"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab./\\%2eE: ‮é", max_size=20), min_size=1, max_size=12))
def test_local_paths_stay_inside(spark, tails):
    df = spark.createDataFrame([("https://e.com/" + t,) for t in tails], "u string")
    for r in df.select(paths.local_path(F.col("u"), F.lit("x")).alias("p")).collect():
        assert not r["p"].startswith("/") and ".." not in r["p"].split("/") and "\\" not in r["p"]


def test_nfkc_names(spark):
    got = one(spark, paths.local_path(F.col("u"), F.lit("x"), unicode=True), u="https://e.com/%EF%AC%81le.png")
    assert got == "e.com/file.png"


def test_long_names_keep_their_suffix(spark):
    got = one(spark, paths.sanitized_name(F.col("n")), n="x" * 150 + ".css")
    assert len(got) == 100 and got.endswith(".css")


def test_formats(spark):
    df = spark.createDataFrame([(1023,), (1024,), (1048576,), (1 << 40,)], "n long")
    assert [r[0] for r in df.select(paths.format_bytes(F.col("n"))).collect()] == ["1023.0 B", "1.0 KB", "1.0 MB", "1.0 TB"]
    assert one(spark, paths.format_seconds(F.col("s")), s=7200.0) == "2.0h"


def test_scope_vectors(spark):
    s = Settings()
    cases = [("https://e.com/a.zip", None, False), ("https://e.com/page", None, True), ("https://e.com/", None, True), ("https://e.com/dir/", None, True), ("https://e.com/v1.2/", None, False), ("https://e.com/x.js", 0, True), ("https://e.com/x.js", 104857600, True), ("https://e.com/x.js", 104857601, False)]
    df = spark.createDataFrame([(u, n) for u, n, _ in cases], "u string, n long")
    assert [r[0] for r in df.select(s.in_scope(F.col("u"), F.col("n"))).collect()] == [ok for _, _, ok in cases]
    blocked = Settings(blocked_domains=frozenset({"facebook.com"}), allowed_domains=frozenset({"www.facebook.com"}))
    assert one(spark, blocked.in_scope(F.col("u")), u="https://www.facebook.com/x.js")


def test_settings_round_trip(tmp_path):
    s = Settings(target_url="https://e.com", blocked_domains=frozenset({"b.c"}), other={"custom_headers": {"A": "b"}})
    s.to_file(str(tmp_path / "c.json"))
    assert Settings.from_file(str(tmp_path / "c.json")) == s and Settings.from_file(str(tmp_path / "none.json")) == Settings()
    for wrong in ({"unknown": 1}, {"max_depth": "3"}, {"allowed_domains": "e.com"}, {"same_domain_only": 1}, [1]):
        (tmp_path / "bad.json").write_text(json.dumps(wrong))
        with pytest.raises(TypeError):
            Settings.from_file(str(tmp_path / "bad.json"))
    assert Settings.of({"retry_delay": 2, "max_depth": True}).other == {"retry_delay": 2}
    assert s.with_flags(max_depth=None, max_retries=2).other["max_retries"] == 2 and s.with_flags(max_depth=None).max_depth == 3 and s.with_flags(max_depth=5).max_depth == 5


def test_rates_and_verdicts_across_slices(spark):
    """Slices of time change nothing: against plain windows over whole keys."""
    from pyspark.sql import Window as W

    from pagelens.operators import resilience

    log = spark.range(3000).select(F.col("id").alias("request_id"), (F.col("id") % 2).alias("domain"), F.timestamp_micros((F.col("id") * F.col("id") * 37_003) % 90_000_000).alias("ts")).withColumn("k", F.lit(1)).withColumn("row", F.lit(2))
    w = W.partitionBy("domain").orderBy(F.unix_micros("ts")).rangeBetween(-999_999, 0)
    want = {r["request_id"]: r["n"] for r in log.select("request_id", F.count("*").over(w).alias("n")).collect()}
    for seconds in (1, 7, 60):
        out = resilience.trailing_rate(log, slice_seconds=seconds)
        assert out.columns == [*log.columns, "in_last_second", "over_limit"]
        assert {r["request_id"]: r["in_last_second"] for r in out.collect()} == want


def test_validators(spark):
    df = spark.createDataFrame([("",), ("a-.com",), ("localhost",), ("e.com\n",)], "d string")
    assert [r[0] for r in df.select(validate.is_domain(F.col("d"))).collect()] == [False, False, True, False]
    assert one(spark, validate.checked_domain(F.col("d")), d="E.com")["value"] == "e.com"
    assert one(spark, validate.checked_url(F.col("u")), u="x")["error"] and not one(spark, validate.checked_url(F.col("u"), allow_relative=True), u="x")["error"]
    assert not one(spark, paths.is_safe_path(F.col("p")), p="a..b") and one(spark, validate.checked_path(F.col("p")), p="a/b")["value"] == "a/b"
    ok = spark.range(1).select(validate.checked_headers(F.create_map(F.lit("X-A"), F.lit("1"))).alias("h"), validate.checked_headers(F.create_map(F.lit("X A"), F.lit("1"))).alias("b")).first()
    assert ok["h"]["error"] is None and ok["b"]["value"] is None
    assert one(spark, validate.is_file_extension(F.col("e"), (".css",)), e=".CSS")


def test_css_and_script_helpers(spark):
    text = "a{b:url( \"https://e.com/x.png\" ); background:url(two.gif)} @import url(c.css)"
    assert one(spark, css.css_urls(F.col("t")), t=text) == ["https://e.com/x.png", "two.gif", "c.css"]
    assert [tuple(r) for r in one(spark, css.css_declarations(F.col("t")), t=text)] == [("b", "https://e.com/x.png"), ("background", "two.gif")]
    assert one(spark, css.refresh_url(F.col("t")), t="5; URL=https://e.com/n; x") == "https://e.com/n"
    assert one(spark, css.worker_urls(F.col("t"), exact_gate=True), t="registerServiceWorker('x.js')") == []


def test_elements_of_broken_html():
    found = html.elements_of("<p>x<b>y<script>var s='</p>';</script><A HREF=a&amp;b href=c>z<style>k{}</style>")
    assert [e["tag"] for e in found] == ["p", "b", "script", "a", "style"]
    assert found[2]["text"] == "var s='</p>';" and dict(found[3]["attrs"]) == {"href": "a&b"} and found[4]["text"] == "k{}"
    assert html.elements_of(None) == html.elements_of("") == []


def test_rewrite_leaves_all_else_untouched():
    page = "<!DOCTYPE html><DIV CLASS=a>&amp; &#39;<a href=/x>1</a><a HREF = '/x'>2</a></DIV><script>a='<img src=/x>'</script><!-- <a href=/x> -->"
    assert html.rewritten_html(page, {"/y": "z"}) == page == html.rewritten_html(page, {})
    assert html.rewritten_html(page, {"/x": "l\"&"}).count("l") > page.count("l")
    assert csslex.rewritten("URL( \"U\" )", {"U": "new"}) == "URL( \"new\" )" and csslex.rewritten("URL( \"V\" )", {"U": "new"}) == "URL( \"V\" )"
    assert html.rewritten_srcset("a 1x,, b 2x,", {"a": "c"}) == "c 1x, b 2x"


def test_rewrite_with_empty_mapping_is_a_no_op(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("page_dir", F.lit("a"))
    out = rewrite.rewrite_pages(pages, spark.createDataFrame([], "url string, relative_url string"))
    assert out.filter("status <> 'unchanged'").count() == 0
    assert out.select("page_id", "html").exceptAll(pages.select("page_id", "html")).count() == 0


def test_rewrite_against_site(spark):
    pages = spark.createDataFrame([(1, "https://e.com/d/p", "<a href='x'>x</a>", "")], "page_id long, url string, html string, page_dir string")
    mapping = spark.createDataFrame([("https://e.com/x", "local.html")], "url string, relative_url string")
    assert rewrite.rewrite_pages(pages, mapping).first()["status"] == "unchanged"
    assert rewrite.rewrite_pages(pages, mapping, against="site", site_url="https://e.com/").first()["html"] == "<a href='local.html'>x</a>"


def test_discovery_of_nothing(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", None), (2, None, "<a href=/x>x</a>"), (3, "https://e.com/", "")], "page_id long, url string, html string")
    assert discover.discover(pages).count() == 0
    both = discover.union_assets(discover.discover(pages), discover.discover(pages))
    assert both.count() == 0


def test_glob_matches_all(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", F.lit("p").alias("local_path"), F.lit(None).cast("map<string,string>").alias("metadata"), F.col("page_id").alias("seq"))
    built = index.build(pages)
    assert index.by_glob(built, "*").count() == built.count()
    d = built.first()["domain"]
    assert 0 < index.by_domain(built, d.upper()).count() <= built.count()


def test_index_ambiguity_and_merge(spark):
    rows = [("https://sub.e.com", "a", {"k": "1", "x": "1"}, 1), ("https://e.com/sub/", "b", {"k": "2"}, 2)]
    records = spark.createDataFrame(rows, "url string, local_path string, metadata map<string,string>, seq long")
    got = index.search(index.build(records), spark.createDataFrame([("https://e.com/sub",)], "url string")).collect()
    assert [(r["url"], r["local_path"], r["metadata"]) for r in got] == [("https://e.com/sub/", "b", {"k": "2", "x": "1"})]
    assert index.build(records, strict_host=True).count() == 2
    assert index.tokens(F.lit("x")) is not None


def test_attempts_across_slices(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, u, start + datetime.timedelta(minutes=25 * k)) for k in range(8) for u in ("a", None)] + [(90, "a", None), (91, "b", None)]
    rng = random.Random(1)
    rng.shuffle(rows)
    got = {(r["url"], r["request_id"]): (r["attempt"], r["within"]) for r in accounting.attempts(spark.createDataFrame(rows, "request_id long, url string, ts timestamp").withColumn("within", F.lit("x"))).collect()}
    want = {(u, k): (k + 1 + (u == "a"), "x") for k in range(8) for u in ("a", None)} | {("a", 90): (1, "x"), ("b", 91): (1, "x")}
    assert got == want


def test_repository_cycle(spark, tmp_path):
    t = repository.add(repository.empty(spark), spark.createDataFrame([("https://a.b/x",), ("https://a.b/y",), ("https://a.b/x",)], "url string"))
    assert repository.count(t).first()["n"] == 2
    t = repository.add(t, spark.createDataFrame([("https://a.b/x", "new")], "url string, local_path string"))
    assert repository.get(t, "https://a.b/x").first()["local_path"] is None
    t = repository.update(t, spark.createDataFrame([("https://a.b/x", "failed", "HTTP 500")], "url string, status string, last_error string"))
    assert [r["url"] for r in repository.find_by_status(t, "failed").collect()] == ["https://a.b/x"]
    assert repository.update(t, spark.createDataFrame([("https://a.b/x", 1)], "url string, other int")) is t
    twice = repository.update(t, spark.createDataFrame([("https://a.b/x", "failed", "a", 2), ("https://a.b/x", "failed", "b", 1)], "url string, status string, last_error string, seq int"))
    assert [r["last_error"] for r in twice.filter("url = 'https://a.b/x'").collect()] == ["a"]
    repository.save(t, str(tmp_path / "repo"))
    back = repository.load(spark, str(tmp_path / "repo"))
    assert repository.statistics(back).first().asDict() == {"total": 2, "pending": 1, "downloading": 0, "completed": 0, "failed": 1}
    assert repository.find_by_domain(back, "A.b").count() == 2 and repository.clear(back).count() == 0
    assert repository.delete(back, back.filter("status = 'failed'")).count() == 1


REFERENCES = [
    ("/* a{b:url(no.png)} */ @import /* x */ \"b.css\" supports(url(x));", [("b.css", "import", None, None, None)]),
    ("@import url( 'c d.css' ) screen; @namespace svg url(http://n); @charset \"u\";", [("c d.css", "import", None, None, "url")]),
    (".s:hover{content:'/* no';background:url(yes\\29 .png) , url(\"t*/.svg\")}", [("yes).png", "declaration", "background", None, "url"), ("t*/.svg", "declaration", "background", None, "url")]),
    ("@media print{@supports (x:y){.a[href=\"x\"]{MASK:image-set(\"a.webp\" type(\"image/webp\") 1x, url(b.png) 2x)}}} p{src:url(q)}", [("a.webp", "declaration", "mask", "supports", "image-set"), ("b.png", "declaration", "mask", "supports", "image-set"), ("q", "declaration", "src", None, "url")]),
    (".v{--X:url(v.svg);filter:URL('#f')} .bad{x:url(a b.png);y:url(ok.png)}", [("v.svg", "declaration", "--X", None, "url"), ("#f", "declaration", "filter", None, "url"), ("ok.png", "declaration", "y", None, "url")]),
    ("a{b:\"never ends\n;c:url(x.cur)} /* open url(never.png)", [("x.cur", "declaration", "c", None, "url")]),
    ("url(alone.png) .x{y:myurl(no.png);z:url()}", [("alone.png", "other", None, None, "url")]),
    ("", []),
]


@pytest.mark.parametrize("text, want", REFERENCES)
def test_sheet_references(text, want):
    assert [r[:5] for r in csslex.references(text)] == want
    assert csslex.rewritten(text, {}) == text
    moved = csslex.rewritten(text, {r[0]: f"m{k}(" for k, r in enumerate(want)})
    assert [r[0] for r in csslex.references(moved)] == [f"m{k}(" for k in range(len(want))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="url(@import \"'\\);{}:/*a-\n", max_size=60))
def test_any_sheet_is_read_and_copied(text):
    found = csslex.references(text)
    assert all(0 <= r[5] <= r[6] <= len(text) for r in found) and [r[5] for r in found] == sorted(r[5] for r in found)
    assert csslex.rewritten(text, {"no such": "x"}) == text


def test_long_and_deep_sheets_are_linear(spark):
    data = "data:image/png;base64," + "QUJD" * 250_000
    sheets = [f'a{{b:url("{data}");c:url(x.png)}}', f"a{{b:url({data})}} @import 'y.css';", "{" * 200_000 + "a:url(z.png)", "url(" * 100_000, "a(" * 100_000 + "'x'", '"' + "\\\"" * 200_000, "/*" + "*" * 500_000]
    df = spark.createDataFrame([(f"https://e.com/s/{k}.css", t) for k, t in enumerate([*sheets, None])], "css_url string, css string")
    began = time.perf_counter()
    got = {(r["css_url"][-5:], r["asset"]) for r in discover.discover_css(df).collect()}
    assert got == {("0.css", "https://e.com/s/x.png"), ("1.css", "https://e.com/s/y.css"), ("2.css", "https://e.com/s/z.png")}
    assert time.perf_counter() - began < 60
    assert discover.style_references(spark.createDataFrame([(1, "https://e.com/", f"<style>{sheets[0]}</style>")], "page_id long, url string, html string")).count() == 2


def test_strong_components_equal_brute_force(spark):
    rng = random.Random(1)
    random_edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(55)]
    path = [(f"p{k}", f"p{k + 1}") for k in range(40)] + [("p40", "p20"), ("x", "x"), ("x", "x"), (None, "p1"), ("p2", None)]
    edges = random_edges + path
    out = {}
    for a, b in edges:
        if a and b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set())
    reach = {}
    for n in out:
        seen, todo = set(), [n]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reach[n] = seen
    parts = {n: {n} | {m for m in reach[n] if n in reach[m]} for n in out}
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r["node"]: (r["component"], r["size"]) for r in graph.strong_components(df).collect()}
    assert got == {n: (min(p), len(p)) for n, p in parts.items()}
    assert graph.strong_components(df.filter("src = 'none'")).collect() == []


def test_closures_do_not_shuffle_edges(spark):
    edges = spark.createDataFrame([(f"a{k % 50}", f"b{k}") for k in range(500)], "src string, dst string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with graph.by_source(edges) as stored:
            plan = edges.select(F.col("src").alias("node")).join(stored, F.col("node") == F.col("src"))._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "hashpartitioning(src" not in plan and "hashpartitioning(node" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_closure_caps_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("b", "d")], "src string, dst string")
    assert {r["node"]: r["reaches_cycle"] for r in graph.on_cycles(edges).collect()} == {"a": True, "b": True, "c": True, "d": False}
    seeds = spark.createDataFrame([("c",)], "node string")
    assert {r["node"]: r["depth"] for r in graph.closure(edges, seeds, 9).collect()} == {"c": 0, "a": 1, "b": 2, "d": 3}
    assert graph.css_closure(edges, seeds, graph.Caps(files=2)).count() == 2
    many = spark.createDataFrame([("x", f"y{k:03d}") for k in range(70)], "src string, dst string")
    assert graph.capped_imports(many).count() == 50
    big = many.withColumn("src_bytes", F.lit(11 * 1024**2))
    assert graph.capped_imports(big).count() == 0


def test_css_closure_counts_reached_imports_only(spark):
    other = [(f"a{k:04d}", f"b{k:04d}") for k in range(2500)]
    edges = spark.createDataFrame(other + [("y", "y1"), ("y1", "y2"), ("z", "z1"), ("z", "z2"), ("z1", "z3"), ("z1", "z4"), ("z2", "z5"), ("z3", "z6")], "src string, dst string")
    reach = lambda rows, schema, **caps: {tuple(r) for r in graph.css_closure(edges, spark.createDataFrame(rows, schema), graph.Caps(**caps)).collect()}
    y = {("y", 0), ("y1", 1), ("y2", 2)}
    z = {("z", 0), ("z1", 1), ("z2", 1), ("z3", 2), ("z4", 2), ("z5", 2), ("z6", 3)}
    both = [("y",), ("z",)]
    assert reach(both, "node string") == y | z
    # Files and imports are counted for each seed; z2 passes the cap of four imports and is not followed.
    assert reach(both, "node string", files=3) == y | {("z", 0), ("z1", 1), ("z2", 1)}
    assert reach(both, "node string", imports=4) == y | z - {("z5", 2), ("z6", 3)}
    # Seeds of one target share its caps.
    assert reach([("t", "y"), ("t", "z")], "target string, node string", files=3) == {("t", "y", 0), ("t", "z", 0), ("t", "y1", 1)}


def test_breaker_vectors():
    b = resilience.Breaker()
    for t in range(5):
        assert b.offer(float(t), False)
    assert b.state == "open" and not b.offer(63.0, True)
    assert b.offer(64.0, True) and b.state == "half_open"
    assert b.offer(65.0, True) and b.state == "closed" and b.failed == 0
    for t in range(100, 105):
        b.offer(float(t), False)
    assert b.offer(170.0, True) and b.offer(171.0, False) and (b.state, b.succeeded) == ("open", 0)


def log_rows():
    t0 = datetime.datetime(2024, 1, 1)
    return [(k, f"d{k % 3}", t0 + datetime.timedelta(seconds=k * 7), k % 4 == 0) for k in range(200)]


def test_batch_and_stream_breakers_agree(spark, tmp_path):
    log = spark.createDataFrame(log_rows(), "request_id long, domain string, ts timestamp, ok boolean")
    batch = {r["request_id"]: (r["executed"], r["state"]) for r in resilience.breaker_replay(log).collect()}
    for k in range(2):
        log.filter(F.floor(F.col("request_id") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = stream.breaker_stream(source).writeStream.format("memory").queryName("breaker").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["request_id"]: (r["executed"], r["state"]) for r in spark.sql("SELECT * FROM breaker").collect()} == batch
    assert {r["domain"] for r in resilience.breaker_status(resilience.breaker_replay(log)).collect()} == {"d0", "d1", "d2"}


def test_windowed_event_stats(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("download_completed", t0 + datetime.timedelta(minutes=m), 10) for m in (0, 1, 6, 40, 90)] + [("download_failed", t0, None)]
    df = spark.createDataFrame(rows, "event_type string, ts timestamp, size long")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = stream.windowed_stats(source).writeStream.format("memory").queryName("stats").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["start"]: (r["completed"], r["failed"], r["bytes"]) for r in spark.sql("SELECT * FROM stats").collect()}
    assert got[t0] == (2, 1, 20)


def test_limiter_waits_beyond_burst(spark):
    t0 = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([(k, "d", t0) for k in range(12)], "request_id long, domain string, ts timestamp")
    waits = [r["wait"] for r in resilience.limiter_schedule(log, per_second=10, burst=5).orderBy("request_id").collect()]
    assert waits[:10] == [0.0] * 10 and waits[10] == pytest.approx(1.0)


def test_event_phases_and_rates(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("phase_completed", t0 + datetime.timedelta(seconds=2), None, "b"), ("phase_completed", t0, None, "a"), ("download_completed", t0, 5, None), ("error_occurred", t0, None, None)]
    got = accounting.event_stats(spark.createDataFrame(rows, "event_type string, ts timestamp, size long, phase string")).first()
    assert got["phases_completed"] == ["a", "b"] and got["success_rate"] == 1.0 and got["errors"] == 1
    none = accounting.event_stats(spark.createDataFrame([], "event_type string, ts timestamp, size long, phase string")).first()
    assert none["success_rate"] == 0.0 and none["phases_completed"] == []
    results = spark.createDataFrame([("u", True, 10, None, t0)], "url string, success boolean, file_size long, error string, ts timestamp")
    assert accounting.download_stats(results).first()["download_rate"] == 0.0
    assert accounting.as_events(results).count() == 2


def test_verification_with_files(spark):
    t0 = datetime.datetime(2024, 1, 1)
    results = spark.createDataFrame([("u1", True, "a", None, t0), ("u2", True, "b", None, t0), ("https://e.com/gtag.js", False, None, "HTTP 404", t0)], "url string, success boolean, local_path string, error string, ts timestamp")
    files = spark.createDataFrame([("a", 0), ("b", 3)], "local_path string, size long")
    got = {(r["url"], r["issue"], r["essential"]) for r in accounting.verification(results.select("url"), results, files).collect()}
    assert got == {("u1", "missing_file", True), ("https://e.com/gtag.js", "failed", False)}


def test_guards(spark):
    ips = [("a", "172.32.0.1"), ("b", "172.16.0.1"), ("c", "fe80::1"), ("d", "2606:4700::1")]
    dns = spark.createDataFrame(ips, "hostname string, ip string")
    assert {r["hostname"]: r["allowed"] for r in netguard.dns_guard(dns, ipv6=True).collect()} == {"a": True, "b": False, "c": False, "d": True}
    asks = spark.createDataFrame([("a",), ("b",), ("unknown.com",), ("10.0.0.1",), ("8.8.8.8",)], "hostname string")
    got = {r["hostname"]: r["allowed"] for r in netguard.guarded(asks, netguard.dns_guard(dns)).collect()}
    assert got == {"a": True, "b": False, "unknown.com": True, "10.0.0.1": False, "8.8.8.8": True}
    assert netguard.guarded(asks, netguard.dns_guard(dns), literal_bypass=True).filter("hostname = '10.0.0.1'").first()["allowed"]


def test_headers(spark):
    h = spark.range(1).select(netguard.merged_headers(netguard.basic_header(F.lit("u"), F.lit("p")), netguard.bearer_header(F.lit("t"))).alias("h")).first()["h"]
    assert h == {"Authorization": "Bearer t"}
    assert spark.range(1).select(netguard.redacted(netguard.bearer_header(F.lit("t"))).alias("h")).first()["h"] == {"Authorization": "***"}
    with pytest.raises(ValueError):
        netguard.headers_of({"type": "composite"})
    assert netguard.headers_of({"type": "cookie"}) == {} and netguard.headers_of({"type": "basic", "username": "u", "password": "p"}) == {"Authorization": "Basic dTpw"}


def test_files_in_and_out(spark, tmp_path):
    root = tmp_path / "site"
    files = spark.createDataFrame([("a/b.html", "<p>é</p>"), ("../evil", "x"), ("/abs", "x"), ("c.css", "p{}")], "local_path string, content string")
    written = {r["local_path"]: r["written"] for r in sinks.site_tree(files, f"file://{root}").collect()}
    assert written == {"a/b.html": True, "../evil": False, "/abs": False, "c.css": True}
    (root / "latin.htm").write_bytes("é".encode("latin-1"))
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in readers.text_files(spark, str(root)).collect()}
    assert got == {"b.html": "<p>é</p>", "c.css": "p{}", "latin.htm": "é"}
    sinks.site_table(files, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    assert sinks.with_index(files.filter("local_path LIKE 'a%'"), "a/b.html").count() == 2


def test_state_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    assert readers.load_state(spark, path, "https://e.com") is None
    sinks.save_state(spark, path, "https://e.com", discovered=spark.range(3))
    assert readers.load_state(spark, path, "https://other.com") is None
    assert readers.load_state(spark, path, "https://e.com")["discovered"].count() == 3
    sinks.clear_state(spark, path)
    assert readers.load_state(spark, path, "https://e.com") is None


def test_metadata_and_event_log(spark, tmp_path):
    sinks.json_row(spark.range(1).select(F.lit(1).alias("total_files")), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first()["total_files"] == 1
    sinks.json_mapping(spark.createDataFrame([("u", "p", 1)], "url string, relative_url string, x int"), str(tmp_path / "map"))
    assert spark.read.json(str(tmp_path / "map")).columns == ["relative_url", "url"]
    events = spark.createDataFrame([("download_started", datetime.datetime(2024, 1, 1), "u")], "event_type string, ts timestamp, url string")
    sinks.event_log(events, str(tmp_path / "log"))
    sinks.event_log(events, str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ['2024-01-01 00:00:00 download_started {"url":"u"}'] * 2


def test_site_run(spark):
    from pagelens.plans.snapshot import link_closure, site_run

    pages = spark.createDataFrame([(1, "https://e.com/", "<a href='/a'>a</a><a href='/b'>b</a>"), (2, "https://e.com/a", "<a href='/b/c'>c</a>"), (3, "https://e.com/b/c", "<img src=/i.png>")], "page_id long, url string, html string")
    s = Settings(target_url="https://e.com/")
    assert {r["node"]: r["depth"] for r in link_closure(pages, s).collect()} == {"https://e.com/": 0, "https://e.com/a": 1, "https://e.com/b": 1, "https://e.com/b/c": 2}
    out = site_run(pages, s)
    assert out["summary"].first()["downloaded_files"] == 2 and out["summary"].first()["failed_files"] == 2
    first = out["pages"].filter("page_id = 2").first()
    assert first["status"] == "changed" and "../../e.com/b/c/index.html" in first["html"]


def test_category_of_contexts(spark):
    cases = [("https://e.com/x.pdf", "a", "href", "documents"), ("https://e.com/x", "a", "href", "other"), ("https://e.com/x", "link", "href", "stylesheets"), ("https://e.com/x", "source", "src", "media")]
    df = spark.createDataFrame([c[:3] for c in cases], "u string, t string, a string")
    assert [r[0] for r in df.select(classify.asset_category(F.col("u"), F.col("t"), F.col("a"))).collect()] == [c[3] for c in cases]


def test_entry_imports_without_the_optional_folders(monkeypatch):
    """The driver may delete the training-data folders: the rest has to import and answer."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("pagelens.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m.startswith("pagelens.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "asset_census" in entry.queries() and not [q for q in entry.queries() if q.startswith("op")] and "pipeline" not in entry.queries()
