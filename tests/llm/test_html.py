"""HTML extraction: against a plain two-pass version, without the pages' own marks, and on hostile pages."""

import html
import re
import time
from html.parser import HTMLParser

import duckdb
import pytest

from gazetta.llm import htmltext as H

PAGES = "/root/testdata/sf0.01/pages.parquet"


class Plain(HTMLParser):
    """Blocks of a well-formed page with the path of the containers that they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.count, self.blocks, self.text, self.linked, self.link, self.heading, self.skip = [], 0, [], "", 0, False, False, False

    def flush(self):
        text = re.sub(r"\s+", " ", self.text).strip()
        if text:
            self.blocks.append({"text": text, "linked": self.linked, "path": [n for _, n, _ in self.path], "tags": [t for t, _, _ in self.path], "named": any(x for _, _, x in self.path), "heading": self.heading})
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in H.RAW_TAGS:
            self.skip = True
        if tag == "a":
            self.link = True
        elif tag == "br":
            self.text += " "
        elif tag in H.BLOCK_TAGS or tag in H.OUT_TAGS:
            self.flush()
            self.heading = bool(re.fullmatch("h[1-6]", tag))
            if not self.heading and tag not in ("p", "li"):
                self.count += 1
                self.path.append((tag, self.count, dict(attrs).get("class") == "ad"))

    def handle_endtag(self, tag):
        if tag in H.RAW_TAGS:
            self.skip = False
        elif tag == "a":
            self.link = False
        elif tag in H.BLOCK_TAGS or tag in H.OUT_TAGS:
            self.flush()
            self.heading = False
            if any(t == tag for t, _, _ in self.path):
                while self.path.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            if self.link:
                self.linked += len(" ".join(data.split()))


def plain_main_text(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.flush()
    blocks = p.blocks
    for b in blocks:
        words = re.findall(r"[^\W\d_]+", b["text"].lower())
        stops = sum(w in H.stop_words() for w in words) / len(words) if words else 0
        n, links, b["main"] = len(b["text"]), b["linked"] / len(b["text"]), bool({"article", "main"} & set(b["tags"]))
        if b["named"] or H.OUT_TAGS & set(b["tags"]) or links > 0.33 or ("©" in b["text"] and not b["main"]):
            b["label"] = "bad"
        elif n < 70 or b["heading"]:
            b["label"] = "short"
        elif stops >= 0.2 and n >= (70 if b["main"] else 140):
            b["label"] = "good"
        elif stops >= 0.12:
            b["label"] = "near"
        else:
            b["label"] = "bad" if links > 0.05 and not b["main"] else "thin"
    first = [b["label"] for b in blocks]
    if "good" not in first:
        some = [b for b in blocks if b["main"] and b["label"] != "bad"] or [b for b in blocks if b["label"] == "near"] or [b for b in blocks if b["label"] != "bad"]
        for b in some:
            b["label"] = "good"
    if any(b["main"] and b["label"] == "good" for b in blocks):
        for b in blocks:
            b["label"] = b["label"] if b["main"] or b["label"] == "good" else "bad"
    first = [b["label"] for b in blocks]

    def common(i, j):
        return sum(x == y for x, y in zip(blocks[i]["path"], blocks[j]["path"]))

    final = list(first)
    for i, label in enumerate(first):
        if label not in ("good", "bad"):
            left = next((j for j in range(i - 1, -1, -1) if first[j] in ("good", "bad")), None)
            right = next((j for j in range(i + 1, len(blocks)) if first[j] in ("good", "bad")), None)
            sides = [j for j in (left, right) if j is not None]
            if not sides:
                final[i] = "bad"
            else:
                final[i] = first[max(sides, key=lambda j: (common(i, j), -abs(i - j), (first[j] == "good") == (label != "thin")))]
    for i in range(len(blocks)):
        if blocks[i]["heading"] and first[i] not in ("good", "bad"):
            k = next((j for j in range(i + 1, len(blocks)) if not blocks[j]["heading"] or first[j] in ("good", "bad")), None)
            if k is not None:
                final[i] = final[k]
    return "\n\n".join(b["text"] for b, f in zip(blocks, final) if f == "good")


def without_marks(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def without_names(page):
    for tag in ("article", "nav", "footer"):
        page = page.replace(f"<{tag}>", "<div>").replace(f"</{tag}>", "</div>")
    return page.replace(' class="ad"', "")


@pytest.fixture(scope="module")
def pages():
    return [p for (p,) in duckdb.sql(f"select html from '{PAGES}'").fetchall()]


@pytest.mark.parametrize("change", [str, without_marks, without_names])
def test_is_the_plain_two_passes(pages, change):
    for page in pages:
        assert H.main_text(change(page)) == plain_main_text(change(page))


def blocks_of_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return [x for x in (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x)))).strip() for x in re.split(r"</?p>|</?h1>", inner)) if x]


@pytest.mark.parametrize("change,recall,precision", [(str, 1.0, 1.0), (without_marks, 0.99, 0.99), (without_names, 0.98, 0.97)])
def test_articles_are_found_without_their_marks(pages, change, recall, precision):
    found = kept = all_found = all_kept = 0
    for page in pages:
        want, got = blocks_of_article(page), [x for x in H.main_text(change(page)).split("\n\n") if x]
        found, all_found = found + sum(x in set(got) for x in want), all_found + len(want)
        kept, all_kept = kept + sum(x in set(want) for x in got), all_kept + len(got)
    assert found >= recall * all_found and kept >= precision * all_kept


HOSTILE = [
    '<script x="' * 100_000, "<a " * 300_000, "<div>" * 100_000 + "</table>" * 100_000, '<a ">"' * 150_000, "<" * 1_000_000, "<!--" * 200_000, "&" * 1_000_000, "<a x='>'" * 100_000,
    "<div class=a><p>x" * 60_000, '<a "' * 250_000 + ">", "<textarea>" * 100_000, "&#x" * 300_000, "<a =" + " " * 500_000 + '"' + ' "' * 200_000, '<a x=">" ' * 100_000 + '<b x="', "x</div>" * 120_000,
]


@pytest.mark.parametrize("page", HOSTILE, ids=lambda p: p[:12])
def test_time_follows_length(page):
    """Twice the page takes about twice the CPU time: no fixed limit, as machines differ."""

    def cpu(text):
        began = time.process_time()
        H.main_text(text)
        return time.process_time() - began

    half = page[: len(page) // 2]
    assert min(cpu(page), cpu(page)) < 4 * min(cpu(half), cpu(half)) + 0.1


def as_named_div(page):
    return page.replace("<article>", '<div class="post tag-news">').replace("</article>", "</div>")


def without_head_end(page):
    return page.replace("</head>", "")


def in_a_form(page):
    return re.sub("</body>", "</form></body>", re.sub("(<body[^>]*>)", r"\1<form action=x>", page))


def in_a_named_container(name):
    def change(page):
        return re.sub("</body>", "</div></body>", re.sub("(<body[^>]*>)", rf'\1<div class="{name}">', page))

    return change


CHANGES = [as_named_div, without_head_end, in_a_form, *map(in_a_named_container, ("content with-sidebar", "popular-science", "header-alert-story", "has-sidebar"))]


@pytest.mark.parametrize("change", CHANGES, ids=str)
def test_a_name_or_an_open_tag_does_not_lose_the_page(pages, change):
    found = kept = all_found = all_kept = 0
    for page in pages:
        assert change(page) != page
        want, got = blocks_of_article(page), [x for x in H.main_text(change(page)).split("\n\n") if x]
        found, all_found = found + sum(x in set(got) for x in want), all_found + len(want)
        kept, all_kept = kept + sum(x in set(want) for x in got), all_kept + len(got)
    assert found >= 0.95 * all_found and kept >= 0.95 * all_kept


def test_marked_parts_still_go(pages):
    prose = "This is what a reader thinks about the article and it is as long as the article itself, with all of the words that one would have in it. " * 3
    for name in ("comments", "sidebar", "ad", "related-posts", "newsletter-signup"):
        for page in pages[:40]:
            more = page.replace("</article>", f'</article><div class="{name}"><p>{prose}</p></div>')
            assert H.main_text(more) == H.main_text(page)
    for heading in ("Comments", "3 Comments", "Comments (12)", "Kommentare", "Reader comments"):
        for page in pages[:20]:
            more = page.replace("</article>", f"<h2>{heading}</h2><ul><li><p>{prose}</p></li><li><p>I like it.</p></li></ul></article>")
            assert H.main_text(more) == H.main_text(page)
    assert H.main_text(f"<article><h1>A</h1><p>{prose}</p><h2>Comments</h2><p>{prose} no</p><h2>What is next</h2><p>{prose}</p></article>") == f"A\n\n{prose.strip()}\n\nWhat is next\n\n{prose.strip()}"


def test_prose_beside_an_article_stays():
    prose = "This is the text of the article and it is about all of the things that you would like to know in this world. " * 2
    more = prose.replace("this world", "that world")
    assert H.main_text(f"<article><p>{prose}</p></article><div><p>{more}</p><p>Top</p></div>") == f"{prose.strip()}\n\n{more.strip()}"


def test_density_links_and_neighbours_decide():
    prose = "This is the text of the article and it is about all of the things that you would like to know in this world. " * 2
    page = f"<div><p>Top</p><p>{prose}</p><p>Short one.</p><p><a href=x>{'linked words ' * 9}</a></p><p>{prose}</p></div><div><p>Buy now</p><p><a href=y>more</a></p></div>"
    assert [b.label for b in H.classify(page)] == ["good", "good", "good", "bad", "good", "bad", "bad"]
    assert H.main_text(f"<div><p>{prose}</p></div><div id=comments><p>{prose} I like it.</p></div>") == prose.strip()
    assert H.main_text("<ul><li><a href=x>Home</a></ul><div><p>A few words.</p></div>") == "A few words."
    assert H.main_text(f"<article><h1>Head</h1><p>{prose}</p><h2>Related</h2><ul><li><a href=z>Other</a></ul></article>") == f"Head\n\n{prose.strip()}"


def test_quotes():
    assert H.main_text("<p title=it's>one</p><p>two</p>") == "one\n\ntwo"
    assert H.main_text('<p title="a>b">one</p>') == "one"
    assert H.main_text('<p>one</p><p title="never closed>two</p>') == "one\n\ntwo"


def test_blocks_as_a_column(spark):
    prose = "This is the text of the article and it is about all of the things that you would like to know in this world. " * 2
    page = f"<article><p>{prose}</p><p><a href=x>{'linked words ' * 9}</a></p></article>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: [(b.text, b.linked, b.label) for b in r.blocks] for r in H.html_blocks(rows).collect()}
    assert got == {1: [(prose.strip(), 0, "good"), (("linked words " * 9).strip(), len(("linked words " * 9).strip()), "bad")], 2: []}
