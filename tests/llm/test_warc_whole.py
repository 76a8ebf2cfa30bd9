"""Whole WARC derivatives: every entity and the whole source head."""

from wakeline.llm import warc

HEAD = "HTTP/1.1 404 Not Found\r\nServer: nginx\r\nX-Content-Type: no\r\ncontent-type:text/html\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nLast-Modified: Mon, 01 Jan 2024\r\n 10:00:00 GMT\r\nodd line\r\n\r\n"
BODY = (
    "<html><head><title>On &Eacute;t&eacute;</title><style>p{}</style></head><body><nav><a href='/x'>Home</a></nav><!-- no --><p>&copy; 2024 &middot; a&nbsp;b &#8212; &#x20AC;"
    " &amp;lt; &lt;b&gt; &apos;&#39;&quot; &nosuch; &#xD800;</p><script>var no;</script></body></html>"
)
TEXT = "On Été\nHome\n© 2024 · a b — € &lt; <b> ''\" &nosuch; �"
FIELDS = [
    "source-status: HTTP/1.1 404 Not Found", "source-header-Server: nginx", "source-header-X-Content-Type: no", "source-header-content-type: text/html", "source-header-Set-Cookie: a=1",
    "source-header-Set-Cookie: b=2", "source-header-Last-Modified: Mon, 01 Jan 2024 10:00:00 GMT", "source-line: odd line", "source-content-type: text/html",
]


def test_whole_records(spark, tmp_path):
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", HEAD, BODY), ("<urn:uuid:2>", "http://b/", "2024-01-01T00:00:00Z", None, "")]
    source = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_head string, body string")
    folder = f"file://{tmp_path}/warc"
    warc.write_warc(warc.derivatives(source), folder)
    got = {(r.refers_to, r.record_type): bytes(r.block).decode() for r in warc.read_warc(spark, folder).collect()}
    assert len(got) == 4
    assert got["<urn:uuid:1>", "conversion"] == TEXT and got["<urn:uuid:2>", "conversion"] == ""
    assert got["<urn:uuid:1>", "metadata"].split("\r\n")[: len(FIELDS)] == FIELDS
    assert got["<urn:uuid:2>", "metadata"].startswith("source-content-type: \r\nsource-content-length: 0\r\n")
