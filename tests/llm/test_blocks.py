"""Main text of pages of many makes."""

from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from occgraph.llm.blocks import extract_main_text, main_text
from occgraph.llm.common import table

LONG = "The old house on the hill was not far from the sea and it had been empty for many years, so that the people of the village did not go there in the evening. "
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
FOOT = "<footer>&copy; 2024 The Site. All rights of the site are reserved and so on.</footer>"


def page(body: str) -> str:
    return f"<!doctype html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body>{MENU}{body}{FOOT}</body></html>"


@pytest.mark.parametrize(("body", "want"), [
    (f"<article><h1>Head &amp; more</h1><p>{LONG * 2}<p>Short.<p>{LONG}</article>", ["Head & more", (LONG * 2).strip(), "Short.", LONG.strip()]),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</p><aside>Buy this now, it is the best of all.</aside><p>End.</p></article>", ["Head", LONG.strip(), "End."]),
    (f"<div class='cookie-notice'>{LONG}</div><main><p>{LONG}</p><form>Name <input> {LONG}</form></main>", [LONG.strip()]),
    (f"<article><p>{LONG}</p></article><section class='comments'><article><p>{LONG}</p></article></section>", [LONG.strip()]),
    (f"<article><p>{LONG}</p><article class=reply><p>I liked it. {LONG}</p></article></article>", [LONG.strip()]),
    (f"<div><p>{LONG * 2}</p><p>And then he left.</p><p>{LONG * 2}</p></div><div class=sidebar><p>{LONG}</p></div>", [(LONG * 2).strip(), "And then he left.", (LONG * 2).strip()]),
    (f"<article><p>one <b>bold</b><i>er</i>\n  word&nbsp;&lt;b&gt; {LONG}</p><!-- no --><style>p{{}}</style></article>", [f"one bolder word <b> {LONG.strip()}"]),
    (f"<article><p>{LONG}<br><br>{LONG}</p></article>", [LONG.strip(), LONG.strip()]),
    (f"<article><p>{LONG}</p><ul><li><a href=x>Another story of ours</a></li><li><a href=y>More</a></li></ul></article>", [LONG.strip()]),
    ("<article><p>Kurz.</p></article>", ["Kurz."]),
    ("<p>ad</p>", []),
], ids=range(11))
def test_makes_of_pages(body, want):
    assert main_text(page(body)) == "\n".join(want)


@pytest.mark.parametrize("text", ["", " ", "<", "<<p>", "<p", "</p></div>", "<!-- ", "<script>", "<a href='", "&am", "plain words only", "<article>", "<article><p>x</article", "\x00"])
def test_broken_pages_do_not_break(text):
    assert isinstance(main_text(text), str)


def test_pages_of_the_table(spark, sf):
    rows = table(spark, sf, "pages").withColumn("got", extract_main_text(F.col("html"))).collect()
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|li|ul|div|br)\b[^>]*>", body)]
        assert " ".join(r["got"].split()) == " ".join(x for x in blocks if x)


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, page(f"<article>{'<p>' + LONG:s}</article>")), (3, page(f"<article><p>{LONG * 3000}</article>"))], "page_id long, html string")
    got = [r[0] for r in df.withColumn("text", F.lit("own")).select(extract_main_text(F.col("html"))).collect()]
    assert got == ["", "", LONG.strip(), (LONG * 3000).strip()]
    assert df.limit(0).select(extract_main_text(F.col("html"))).count() == 0
