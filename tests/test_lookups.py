"""The index in token order, trigram lists and networks against plain versions."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from pagelens.functions import charset
from pagelens.operators import accounting, index, intervals, netguard, trigrams


def records(spark, urls):
    return spark.createDataFrame([(u, f"p/{k}", {}, k) for k, u in enumerate(urls)], "url string, local_path string, metadata map<string,string>, seq long")


@pytest.fixture(scope="module")
def site():
    r = random.Random(3)
    urls = [f"https://h{r.randrange(4)}.example.{r.choice(['com', 'org'])}/" + "/".join(r.choice("abA") * r.randrange(1, 3) for _ in range(r.randrange(5))) + r.choice(["", "?q=1", "?q=1&r=*"]) for _ in range(400)]
    return urls + ["", "x", "mailto:a@b", "https://h1.example.com/é/\U0010ffff\U0010ffff/z", "https://h1.example.com/é/\U0010ffff"]


@pytest.fixture(scope="module")
def built(spark, site):
    return index.build(records(spark, site))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("parts", [1, 7])
def test_intervals_against_prefix_joins(spark, site, built, parts):
    labelled = intervals.label(built, parts)
    positions = [r.pos for r in labelled.rows.orderBy("key").collect()]
    assert positions == list(range(built.count()))
    asked = spark.createDataFrame([(p,) for p in ["", "https:", "https://com", "https://h1.example.com/a", "https://h1.example.com/é", "https://h1.example.com/é/\U0010ffff", "zz://q", "https://zz", *site[::3], None, "https:"]], "prefix string")
    expected = rows(index.starts_with_any(built, asked.distinct()))
    for block in (1, 8, 4096):
        assert rows(intervals.starts_with_any(labelled, asked, block)) == expected
    for p in ("https://h2.example.org/a", "nothing"):
        assert rows(intervals.starts_with(labelled, p).select("url")) == rows(index.starts_with(built, p).select("url"))
    assert intervals.stats(labelled).first() == index.stats(built).first()


def test_one_prefix_reaches_the_scan(spark, built):
    labelled = intervals.label(built, 4)
    plan = intervals.starts_with(labelled, "https://com")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(key", plan)


@pytest.mark.parametrize("parts", [1, 5])
def test_many_globs(spark, built, parts):
    labelled = intervals.label(built, parts)
    globs = ["*", "", "?", "*a*", "https://*", "HTTPS://H1.*", "*/ab/*", "*example.com/?", "*q=1&r=*", "*(.org)*", "*zzz*", "https://h1.example.com/é/*", "*example.???/*/aa*", "*.[a]+", None, "*"]
    found = rows(trigrams.match(labelled, trigrams.postings(labelled), spark.createDataFrame([(g,) for g in globs], "pattern string")))
    urls = [(r.url, r.local_path) for r in built.collect()]
    expected = sorted((g, u, p) for g in set(globs) - {None} for u, p in urls if re.match(index.glob_pattern(g), u))
    assert found == expected


def test_empty_index(spark):
    labelled = intervals.label(index.build(records(spark, [])))
    asked = spark.createDataFrame([("https://a",), ("",)], "prefix string")
    assert rows(intervals.intervals(labelled, asked)) == [("", 0, -1), ("https://a", 0, -1)]
    assert rows(intervals.starts_with_any(labelled, asked)) == []
    assert tuple(intervals.stats(labelled).first()) == (0, 0, 0, 1)
    assert rows(trigrams.match(labelled, trigrams.postings(labelled), spark.createDataFrame([("*",), ("abc",)], "pattern string"))) == []


def test_ipv6_digits_and_networks(spark):
    r = random.Random(5)
    good = [str(ipaddress.IPv6Address(r.getrandbits(128) & r.getrandbits(128) & r.getrandbits(128))) for _ in range(60)] + [str(ipaddress.IPv6Address(r.getrandbits(k))) for k in range(1, 128)]
    good += [ipaddress.IPv6Address(g).exploded.upper() for g in good[:20]] + ["::", "1::", "::1", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1.2.3.4", "255.255.255.255"]
    bad = ["", ":", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "1::2::3", "12345::", "g::", "::1.2.3", "::1.2.3.256", "1:2:3:4:5:6:7:8::", "1.2.3", ":1:2:3:4:5:6:7:8", "::1\n", "1.2.3.4.5", None]
    frame = spark.createDataFrame([(g,) for g in good + bad], "ip string")
    for ip, digits in frame.select("ip", netguard.address_hex(frame.ip)).collect():
        assert digits == (None if ip in bad else ipaddress.ip_address(ip).packed.hex()), ip
    nets = ["::/0", "0.0.0.0/0", "1.2.3.0/24", "1.2.3.4", "::ffff:0:0/96", "8000::/1", "fe80::/10", "::/99", "bad/8", "1.2.3.4/33", "1.2.3.4/x", None] + [f"{g}/{r.randrange(129)}" for g in good[:100]]
    read = {n: ipaddress.ip_network(n, strict=False) for n in nets if n and n not in ("bad/8", "1.2.3.4/33", "1.2.3.4/x")}
    table = spark.createDataFrame([(n,) for n in nets], "network string")
    expected = sorted((ip, n) for ip in good for n, net in read.items() if ipaddress.ip_address(ip) in net)
    assert rows(netguard.in_networks(frame, table)) == expected
    best = {}
    for ip, n in expected:
        best[ip] = max(best.get(ip, (-1, "")), (read[n].prefixlen, n))
    assert rows(netguard.longest_network(frame.union(frame), table)) == sorted((ip, n) for ip, (_, n) in best.items())


RUSSIAN = "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства."
FRENCH = "Dès Noël où un zéphyr haï me vêt de glaçons würmiens, je dîne d'exquis rôtis de bœuf au kir à l'aÿ d'âge mûr."


def test_encodings(spark):
    pages = ("cp1252", "mac_roman", "cp850", "cp1251", "koi8_r", "cp866")
    texts = spark.createDataFrame([(RUSSIAN,), (RUSSIAN.upper(),), (FRENCH,), (None,), ("",), ("plain",)], "text string").repartition(3)
    counts = charset.pair_counts(texts, pages)
    shares = charset.model(counts, pages)
    plain = {}
    for s in (RUSSIAN, RUSSIAN.upper(), FRENCH):
        b = b" " + s.encode("cp1251", "ignore") + b" "
        for x, y in zip(b, b[1:]):
            if x > 127 or y > 127:
                plain[x * 256 + y] = plain.get(x * 256 + y, 0) + 1
    assert {r.pair: r.n for r in counts.filter("page = 'cp1251'").collect()} == plain
    cases = [(RUSSIAN[:60], p) for p in pages[3:]] + [("dîne à l'âge mûr, où ", p) for p in pages[:3]] + [(t, e) for t in (RUSSIAN, FRENCH, "plain") for e in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32")]
    cases += [("é" * 300_000 + "x", "utf-8"), ("", "utf-8"), (None, "utf-8")]
    rows_ = [(k, None if t is None else t.encode(e)) for k, (t, e) in enumerate(cases)] + [(len(cases), b"\xff\xfe\x00"), (len(cases) + 1, b"a\x00b\x81"), (len(cases) + 2, b"\x81\x8d")]
    frame = spark.createDataFrame(rows_, "k int, content binary")
    found = {r.k: r.d for r in frame.select("k", charset.detector(shares, pages)(F.col("content")).alias("d")).collect()}
    for k, (t, e) in enumerate(cases):
        assert (found[k] and found[k].text) == t, e
        if t and e in pages:
            assert found[k].encoding == e
    assert all(found[k].text is not None for k in range(len(cases), len(cases) + 3))
    # Pages that lack a byte are passed over.
    assert charset.detect(b"\x81\x8d", charset.model(counts, ("cp1252",)), ("cp1252",))[0] == "iso-8859-1"


@pytest.mark.parametrize("parts", [1, 6])
def test_phases_in_order(spark, parts):
    r = random.Random(9)
    log = [(r.choice(["phase_completed", "warning_raised"]), r.choice([None, *range(40)]), r.choice(["a", "b", None])) for _ in range(500)] + [("phase_completed", 7, "hot")] * 300
    got = rows(accounting.completed_phases(spark.createDataFrame(log, "event_type string, ts long, phase string"), parts))
    known = sorted(((t, p) for e, t, p in log if e == "phase_completed"), key=lambda x: tuple((v is not None, v if v is not None else 0) for v in x[:1]) + ((x[1] is not None, x[1] or ""),))
    assert got == [(k, *x) for k, x in enumerate(known)]
    assert rows(accounting.completed_phases(spark.createDataFrame([], "event_type string, ts long, phase string"), parts)) == []
