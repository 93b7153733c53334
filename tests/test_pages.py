"""Main content of pages against a version that walks each page's tree, and on the given pages."""

import html
import re
from collections import Counter

from gazetta.plans import queries
from gazetta.sources import pages as P

LONG = "A long sentence, with commas, that stands in the article and has enough of its own to say about the world. " * 3


def plain_content(page):
    """The same rules over a tree of elements, one page at a time."""
    blocks, nodes = P.parsed(page)
    around = {n["id"]: n["around"] for n in nodes}
    base = {n["id"]: n["base"] for n in nodes}
    if any(len(b["text"]) >= 25 and not b["unlikely"] for b in blocks):
        blocks = [b for b in blocks if not b["unlikely"]]

    def up(i):
        out = [i]
        while around[out[-1]] is not None:
            out.append(around[out[-1]])
        return out

    score = {}
    for b in blocks:
        if len(b["text"]) >= 25:
            s = 1 + b["text"].count(",") + min(len(b["text"]) / 100, 3)
            for i, part in zip(up(b["own"])[1:3], (1, 0.5)):
                score[i] = score.get(i, 0) + s * part
    final = {}
    for i, s in score.items():
        inside = [b for b in blocks if i in up(b["own"])]
        final[i] = round((s + base[i]) * (1 - sum(b["linked"] for b in inside) / sum(len(b["text"]) for b in inside)), 6)
    if not final:
        return "\n".join(b["text"] for b in blocks)
    top = max(final, key=lambda i: (final[i], -i))
    chosen = {top} | {i for i in final if around[i] == around[top] and final[i] >= max(10, 0.2 * final[top])}
    return "\n".join(b["text"] for b in blocks if chosen & set(up(b["own"])))


ODD = [
    None, "", "no tags at all", "<p>short</p>", f"<html><body><div class=sidebar><p>{LONG}</p></div></body></html>",
    f"<html><head><title>t</title></head><body><nav>menu, menu</nav><article><h1>H</h1><p>one <b>two</b>, {LONG}</p><script>x()</script></article><footer>f</footer></body></html>",
    f"<body><div id=content><p>{LONG}<p>{LONG} more</div><div class='related'><p>{LONG}</p></div><div><a href=x>{LONG}</a></div></body>",
    f"<body><div><p>{LONG}</p></div><div><p>{LONG} too</p></div><ul><li><a href=y>link, link, link, link, link, link</a></ul></body>", "</div></p><div><td>x", "<p>a &amp; b&nbsp;c, and it is long enough to count</p>",
]


def test_content_is_that_of_the_tree(spark, small):
    given = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    rows = list(enumerate(ODD + given))
    df = spark.createDataFrame(rows + [(999, ODD[5])], "page_id long, html string").repartition(3)
    got = {r.page_id: r.content for r in P.main_content(df).collect()}
    assert got == {i: plain_content(x) for i, x in rows} | {999: plain_content(ODD[5])}
    assert got[0] == got[1] == "" and got[2] == "no tags at all" and got[4] == LONG.strip() and got[5].startswith("H\none two, A long")
    assert LONG.strip() in got[6] and got[6].count("\n") == 1
    assert P.main_content(df.limit(0)).count() == 0


def test_articles_of_the_given_pages(spark, small):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r.content for r in queries.QUERIES["html_main_content"](spark, small).collect()}
    found = all_found = all_kept = 0
    for i, page in rows.items():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = Counter(html.unescape(re.sub("<[^>]*>", " ", " ".join(re.findall(r"<p>(.*?)</p>", inner, re.S)))).split())
        have = Counter(got[i].split())
        found, all_found, all_kept = found + (want & have).total(), all_found + want.total(), all_kept + have.total()
    assert found > 0.95 * all_found and found > 0.85 * all_kept
