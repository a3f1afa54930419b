"""What larger tables hold and the small ones do not: long backlogs, URLs of several pages, texts whose marks come late."""

import time
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelens import plans
from pagelens.functions import csslex, html, pieces
from pagelens.operators import repository, resilience
from pagelens.plans import stored
from pagelens.sources import sinks
from pagelens.streaming import events


def plain_limiter(times, per_second, burst):
    """The limiter with its whole list of starts."""
    recent, used, reset, clock, waits = [], 0, times[0], times[0], []
    for t in times:
        now = max(t, clock)
        if now - reset >= 1.0:
            used, reset = 0, now
        recent = [x for x in recent if now - x < 1.0]
        start = now
        if used < burst:
            used += 1
        elif len(recent) >= per_second:
            start = max(now, recent[0] + 1.0)
        recent.append(start)
        clock = start
        waits.append(start - t)
    return waits


def test_limiter_with_a_long_backlog(spark):
    log = lambda n, step: spark.range(n).select(F.col("id").alias("request_id"), F.lit("a").alias("domain"), F.timestamp_micros(F.col("id") * step).alias("ts"))
    for n, step in ((3000, 3), (3000, 1009), (3000, 70001)):
        got = [r.wait for r in resilience.limiter_schedule(log(n, step)).orderBy("request_id").collect()]
        assert got == plain_limiter([k * step / 1e6 for k in range(n)], 10, 5)
    # Rounding lets very many start at one moment; as a list they took the square of their number.
    began = time.monotonic()
    assert resilience.limiter_schedule(log(200_000, 3)).agg(F.max("wait").alias("w")).first().w > 0.9
    assert time.monotonic() - began < 60


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def shared_urls(tmp_path_factory):
    """Pages of which five share a URL, with all states among them, and the SQL over them."""
    d = str(tmp_path_factory.mktemp("shared"))
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS page_id, 'https://h' || range // 5 % 2 || '.example.com/p' || range // 5 AS url, '<html></html>' AS html FROM range(60) ORDER BY md5(range::VARCHAR)) TO '{d}/pages.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    return d, con


def same_as_sql(spark, shared_urls, name):
    d, con = shared_urls
    df = plans.QUERIES[name](spark, d)
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES[name]})").fetchall()
    assert rows(df) == sorted(expected)


@pytest.mark.parametrize("name", ["status_histogram", "repo_delete", "repo_find", "repo_upsert"])
def test_pages_that_share_a_url_are_records_of_their_own(spark, shared_urls, name):
    same_as_sql(spark, shared_urls, name)


def test_state_merge_of_pages_that_share_a_url(spark, shared_urls):
    same_as_sql(spark, shared_urls, "state_merge")


def test_versions_with_one_number(spark):
    versions = spark.createDataFrame([("u", -n % 7, 0) for n in range(70)] + [("v", 9, 0), ("v", 1, 2), ("v", 0, 2)], "url string, page_id int, version int").coalesce(1)
    assert rows(repository.upsert_latest(versions)) == [("u", 6), ("v", 1)]


def test_mapping_stats_of_pages_that_share_a_url(spark, shared_urls):
    same_as_sql(spark, shared_urls, "mapping_stats")


def test_code_pages_of_late_and_repeated_marks(spark, tmp_path):
    late = "plain words and more of them. " * 400
    words = {"de": "Äen Änder über fünf Öfen schöner Straße", "fr": "éen été père à ceux réen éenne créen", "es": "año niño señal acción está más"}
    texts = [late + w for w in words.values()] + [w + " the end" for w in words.values()] * 3 + ["Die Äen Äen Äen Äen Änder über", "un éen éen créen père", late + "Die Öfen"] + ["les éen et les éen"] * 4
    rows_ = [(7 * n + kind, t) for n, t in enumerate(texts) for kind in range(7)] + [(100_002, ""), (100_003, None), (100_004, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    df = plans.QUERIES["decode_documents"](spark, d)
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES['decode_documents']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))


def test_batches_become_objects_by_pieces():
    lengths = []

    def each(texts, numbers):
        lengths.append((len(texts), sum(len(t or b"") for t in texts)))
        return [None if t is None else f"{len(t)}:{n}" for t, n in zip(texts, numbers)]

    texts = ["a" * 300_000] * 40 + [None] + ["é"] * 2000 + ["b" * 3_000_000, ""]
    got = pieces.in_pieces(each, pa.string(), pa.array(texts), pa.array(range(len(texts))))
    assert got.to_pylist() == [None if t is None else f"{len(t)}:{k}" for k, t in enumerate(texts)]
    assert max(n for n, _ in lengths) <= pieces.ROWS and max(b for n, b in lengths if n > 1) < 4_500_000
    for f, kind in ((html._parse, html._ELEMENT_TYPE), (csslex._lex, csslex._TYPE)):
        assert f(pa.array([], pa.string())) == pa.array([], kind)
        assert len(f(pa.array(["a{b:url(c)}", None] * 3000)[1:])) == 5999


@pytest.mark.parametrize("name", ["strict_links", "style_references", "css_cycles", "rewrite_css"])
def test_documents_come_in_small_batches(spark, shared_urls, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, held in (("64m", str(pieces.BATCH)), ("1m", "1m")):
            spark.conf.set(key, given)
            plans.QUERIES[name](spark, shared_urls[0])
            assert spark.conf.get(key).removesuffix("b") in (held, held.replace("1m", "1048576"))
    finally:
        spark.conf.set(key, before)


def test_verdict_stream_of_a_busy_host(spark, tmp_path):
    """Ten thousand verdicts and as many requests of one host within one TTL: as pairs they are fifty million."""
    n, t0 = 20_000, 1_709_251_200_000_000
    log = spark.range(n).select("id", F.lit("h").alias("hostname"), F.timestamp_micros(F.lit(t0) + F.col("id") * 10_000).alias("ts"))
    end = spark.sql("SELECT -1L AS id, 'h' AS hostname, TIMESTAMP'2030-01-01' AS ts UNION ALL SELECT -2L, 'h', TIMESTAMP'2030-01-01'")
    log.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    verdicts = stream.filter("id % 2 = 0").select("hostname", F.col("ts").alias("checked_at"), F.col("id").alias("verdict_id"), (F.col("id") % 3 == 0).alias("allowed"))
    result = events.verdict_stream(stream.filter("id % 2 <> 0").withColumnRenamed("id", "request_id"), verdicts)
    began = time.monotonic()
    run = result.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(60)
    finally:
        run.stop()
    assert time.monotonic() - began < 60
    got = spark.read.schema(result.schema).parquet(str(tmp_path / "out")).select("request_id", "cached_verdict")
    assert rows(got) == [(k, (k - 1) % 3 == 0) for k in range(1, n, 2)]


@pytest.mark.parametrize("name", ["dns_ttl_stream", "event_phase_stream"])
def test_replay_is_two_batches_of_one_state(spark, tmp_path, monkeypatch, name):
    """A batch of each state store costs a commit, whatever the table holds; there were four, of two stores a partition for the verdicts."""
    # Copies of hosts and times, so that one instant has several requests and verdicts.
    duckdb.sql(f"""COPY (SELECT k * 4 + j AS event_id, TIMESTAMP '2024-03-01' + INTERVAL (k // 3 * 47) SECOND AS ts, k % 5 AS user_id, ['view', 'error', 'signup', 'purchase'][1 + (k * 7 + j * j) % 4] AS event_type, 1.5::DOUBLE AS value, '' AS props
        FROM range(150) a(k), range(4) b(j)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    places, scratch = {}, sinks.scratch
    monkeypatch.setattr(sinks, "scratch", lambda spark, name: places.setdefault(name, scratch(spark, name)))
    settings = {k: spark.conf.get(k, None) for k in stored.STATE | stored.CHANGES}
    df = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert Counter(map(tuple, df.collect())) == Counter(con.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES[name]})").fetchall())
    state = Path(places["replay-state"].removeprefix("file://"))
    assert len([f for f in (state / "commits").iterdir() if f.name.isdigit()]) == 2
    assert len(list((state / "state").iterdir())) == 1
    assert {k: spark.conf.get(k, None) for k in settings} == settings
