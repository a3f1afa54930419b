"""Inline inputs shared by queries and their SQL, for cases that the driver's tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE = "https://example.com/dir/page.html"

URLS = [
    "https://example.com", "https://example.com/", "https://example.com/page", "https://example.com/page?x=1", "https://example.com/a.css?v=2", "https://example.com/?x=1", "https://example.com/a.php",
    "https://example.com:8080/a.png", "https://example.com/a.tar.gz", "https://example.com/x.exe", "https://example.com/CON/x.js", "https://example.com/a%2Fb.png", "https://example.com/v1.2/", "https://Ex.com",
    "http://Ex.com/a//b/./c?b=2&a=1#f", "https://ex.com/a/..", "https://ex.com/a/b/../c/./d/", "https://ex.com/?flag", "https://ex.com/?a=&b=1", "https://ex.com/?q=a+b%20c~*", "https://ex.com/?b=2&a=2&a=1&b=1",
    "https://ex.com/a;p?x=1", "https://ex.com:443/", "https://10.example.com/x", "https://172.217.0.1/", "https://u:p@127.0.0.1/", "https://www.facebook.com/x.js", "https://e.com/gtag.js", "https://e.com/.hidden", "https://e.com/name.", "https://e.com/x.WOFF2",
]

REFS = [
    "/x.css", "x.css", "?a=1", "//cdn.ex.com/x.js", "https://Ex.com", "HTTP://Ex.com/a//b/./c?b=2&a=1#f", "https://ex.com/a/../b", "https://ex.com/a/..", "https://ex.com/?flag", "https://ex.com/?a=&b=1", "https://ex.com/?q=a+b%20c~*",
    "https://ex.com/a;p?x=1", "https://ex.com:443/", "https://10.example.com/x", "https://172.217.0.1/", "#x", "mailto:x@y.z", "", "ws://x", "  /trim.png ", "sub/a/./b.js?z=1&y=2#frag", "JavaScript:void(0)", "https://localhost/x", "http://", "./", "..",
]

DOMAINS = ["Ex.com", "localhost", "a-.com", "-a.com", "a..com", "e.com.", "a.b-c.d9", "e.com/x", "../x", "a/b.css"]

#: Settings files, good and bad.
CONFIGS = [(1, '{"max_depth":3,"target_url":"https://e.com","same_domain_only":true,"allowed_domains":["e.com"],"retry_delay":1.5}'), (2, '{"max_depth":"3","retry_delay":2,"custom_headers":{"A":"b"},"unknown":1,"user_agent":null}'), (3, '{"max_depth":true,"same_domain_only":1,"blocked_domains":{},"custom_headers":[]}'), (4, "[1]"), (5, "no json"), (6, "{}")]

DNS = [("ok.com", "93.184.216.34"), ("mixed.com", "93.184.216.34"), ("mixed.com", "10.1.2.3"), ("link.com", "169.254.1.1"), ("edge.com", "172.32.0.1"), ("in.com", "172.16.0.1"), ("bad.com", "not an address"), ("six.com", "2606:2800:220:1::1"), ("loop6.com", "::1"), ("local6.com", "fd12:3456::1"), ("link6.com", "fe80::1"), ("both.com", "2606:2800:220:1::1"), ("both.com", "10.1.2.3"), ("wrong6.com", "2606:::1")]

AUTH = {
    "type": "domain_based",
    "default": {"type": "custom", "headers": {"X-Client": "lens"}},
    "domains": {"example.com": {"type": "bearer", "token": "dummy-1"}, "api.example.com": {"type": "custom", "headers": {"X-Api": "dummy-2"}}, "ex.com": {"type": "basic", "username": "u", "password": "p"}},
}

BYTES = ["636166c3a9", "636166e9", "", "ff00", "68656c6c6f"]

HTML = [
    (1, "https://e.com/d/p.html", "<html manifest=app.manifest><head><link rel=preload as=font href=https://e.com/f><link rel='stylesheet' href=/s.css><meta property='og:image' content='/og.png'><meta http-equiv=Refresh content='5; url=https://e.com/n'></head><body style=\"background:url(bg.gif)\"><img src=i.png data-src=l.jpg srcset='a.png 1x, b.png 2x,'><a href='/x.pdf'>x</a><a href=/x>y</a></body></html>"),
    (2, "https://e.com/", "<link rel=manifest href=/m.json><script>navigator.serviceWorker.register('/sw.js')</script><style>@import \"z.css\"; .a{--v:url(v.woff)}</style><video poster=p.jpg><source src=/x></video><script src=/a.js></script><!-- <img src=no.png> -->"),
    (3, "https://e.com/q", "<a href='#top'>t</a><a href='mailto:a@b.c'>m</a><meta name='msapplication-TileImage' content='/tile'>"),
]

#: What discovery finds in HTML, by page.
HTML_ASSETS = [
    (1, "other", "https://e.com/d/app.manifest"), (1, "preload", "https://e.com/f"), (1, "fonts", "https://e.com/f"), (1, "stylesheets", "https://e.com/f"), (1, "stylesheets", "https://e.com/s.css"), (1, "images", "https://e.com/og.png"),
    (1, "other", "https://e.com/n"), (1, "images", "https://e.com/d/bg.gif"), (1, "images", "https://e.com/d/i.png"), (1, "images", "https://e.com/d/l.jpg"), (1, "images", "https://e.com/d/a.png"), (1, "images", "https://e.com/d/b.png"),
    (1, "documents", "https://e.com/x.pdf"), (1, "other", "https://e.com/x"),
    (2, "manifests", "https://e.com/m.json"), (2, "stylesheets", "https://e.com/m.json"), (2, "service_workers", "https://e.com/sw.js"), (2, "scripts", "https://e.com/sw.js"), (2, "stylesheets", "https://e.com/z.css"), (2, "fonts", "https://e.com/v.woff"),
    (2, "images", "https://e.com/p.jpg"), (2, "media", "https://e.com/x"), (2, "scripts", "https://e.com/a.js"),
    (3, "other", "https://e.com/tile"),
]


def literal(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows, *columns: str) -> str:
    """A SQL table of the rows."""
    body = ", ".join("(" + ", ".join(literal(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
