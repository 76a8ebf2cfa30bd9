"""WARC records against their SQL and against Python's own decoding: entities, nulls, repeats, long bodies, damage, small files, other columns."""

import html

import duckdb
import pandas as pd
import pytest

from wakeline.llm import warc

PAGES = "page_id long, url string, html string, body string, text string"
COLUMNS = ["record_id", "record_type", "refers_to", "target_uri", "source_digest", "content_type", "block_digest", "block_bytes"]
ENTITIES = "&copy; &copy &copyx &notit; &notin; &amp;lt; & &; &# &#; &#65; &#x41 &#X4a; &#128; &#0; &#xD800; &#x110000; &#11; &unknown; &ampamp; &AMP &middot;&nbsp;&fjlig; &zwnj;&#8212;&euro;&#13;&quot;"
BODIES = [f"<html><head><title>A&nbsp;b</title></head><nav>menu</nav><p>{ENTITIES}</p></html>", None, "", "<p>a</p><!-- &copy; --><script>x</script><a href='x'>y</a>", "plain", "é漢😀 &eacute;", "<p>" + "long words " * 60_000 + "</p>", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3"]
ROWS = [(k, None if k == 3 else f"http://a.b/{k}", b) for k, b in enumerate(BODIES)] + [(0, "http://a.b/0", BODIES[0]), (None, "x", "no id")]


def read_back(spark, rows, folder):
    warc.write_warc(warc.derivatives(warc.responses(spark.createDataFrame([(*r, "b", "t") for r in rows], PAGES))), folder)
    return warc.read_warc(spark, folder)


@pytest.mark.parametrize("most", [64 << 20, 40_000])
def test_agrees_with_sql(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "FILE_BYTES", most)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(ROWS, columns=["page_id", "url", "html"]).astype({"page_id": "Int64", "url": object, "html": object}))
    cur = con.execute(warc.OP3_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in read_back(spark, ROWS, f"file://{tmp_path}/w").collect()) == want and len(want) == 2 * len(ROWS)


def test_entities_are_decoded_as_python_does(spark):
    df = spark.createDataFrame([(ENTITIES,)], "x string").select(warc.plain_text(warc.F.col("x")).alias("y"))
    assert df.first().y.split() == html.unescape(ENTITIES).replace(" ", " ").split()


def test_damage_is_refused():
    record = "WARC/1.1\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [b for _, b in warc.parse_warc(record.encode() * 2)] == [b"hello"] * 2
    for cut in (record[:-6], record[:20]):
        with pytest.raises(ValueError):
            list(warc.parse_warc(cut.encode()))


def test_empty_table(spark, tmp_path):
    assert read_back(spark, [], f"file://{tmp_path}/none").collect() == []
