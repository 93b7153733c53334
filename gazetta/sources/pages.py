"""The main content of pages by scores of their paragraphs.

A page is read into blocks: the texts of its innermost block elements, each with the elements around it. The rest is
joins and sums over blocks, by page: a block of 25 characters or more gives its score (one, its commas, its
hundreds of characters up to three) to the element around its own one, and half of it to the next. An element starts from
what its tag and its names are worth; what it has is cut by the share of its text in links. The best element of a page is its content,
with those beside it that have a fifth of its score. Elements whose names say that they are no content count only if a
page has nothing else; a page without any score is its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gazetta.scratch import materialize

#: Elements that never hold content, those that end a text, and those without an end.
SKIPPED = frozenset("script style nav noscript template footer aside form head".split())
BLOCKS = frozenset("html body article section main header div p pre td th tr table tbody thead blockquote ul ol li dl dt dd h1 h2 h3 h4 h5 h6 address figure figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an element is worth by its tag, and by names that speak against it or for it.
TAG_SCORES = {"div": 5, "article": 10, "main": 10, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
AGAINST = re.compile(r"comment|footer|sidebar|sponsor|promo|related|widget|masthead|menu|social|share|banner|\bad\b|\bads\b|advert|cookie|breadcrumb|pager|popup", re.I)
FOR = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
NAMED, LEAST_TEXT, BESIDE, BESIDE_LEAST = 25, 25, 0.2, 10
PARSED = "blocks array<struct<n:int,own:int,above:array<int>,text:string,linked:int,unlikely:boolean>>, nodes array<struct<id:int,around:int,base:double>>"


class _Blocks(HTMLParser):
    """The blocks of a page and the elements that they stand in; element 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.nodes: list[dict] = [{"id": 0, "around": None, "base": 0.0}]
        self.blocks: list[dict] = []
        self.skipped: list[str] = []
        self.parts: list[str] = []
        self.linked, self.links = 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            own = self.open[-1]
            self.blocks.append({"n": len(self.blocks), "own": own[1], "above": [i for _, i, _ in self.open], "text": text, "linked": self.linked, "unlikely": own[2]})
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skipped.append(tag)
        elif tag == "a":
            self.links += 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.flush()
            if tag == "p" and self.open[-1][0] == "p":
                self.open.pop()
            names = " ".join(v for k, v in attrs if k in ("class", "id") and v)
            against, good = bool(AGAINST.search(names)), bool(FOR.search(names))
            around = self.open[-1]
            node = len(self.nodes)
            self.nodes.append({"id": node, "around": around[1], "base": float(TAG_SCORES.get(tag, 0) + NAMED * (good - against))})
            self.open.append((tag, node, around[2] or (against and not good)))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipped:
            del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS:
            self.flush()
            if any(t == tag for t, _, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def parsed(page: str | None) -> tuple[list[dict], list[dict]]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.blocks, parser.nodes


def parse(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """keep's columns, blocks and nodes of each page."""
    out = StructType([*pages.select(*keep).schema.fields, *_parse_datatype_string(PARSED).fields])
    arrow = to_arrow_schema(out)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [parsed(x) for x in part.column(width).to_pylist()]
                new = [pa.array([r[i] for r in rows], arrow.types[width + i]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(arrow.types[i]) for i in range(width)), *new], schema=arrow)

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, out)


def main_content(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep's columns and content: the texts of the best element's blocks, one a line (empty for pages without text)."""
    rows = materialize(parse(pages.withColumn("__row", F.monotonically_increasing_id()), html, ["__row", *keep]))
    blocks = rows.select("__row", F.explode("blocks").alias("b")).select("__row", "b.*", F.length("b.text").alias("size"))
    # blocks in unlikely elements count only in pages where no other can have a score
    able = F.col("size") >= LEAST_TEXT
    plain = blocks.groupBy("__row").agg(F.max(able & ~F.col("unlikely")).alias("plain"))
    blocks = blocks.join(plain, "__row").where(~F.col("unlikely") | ~F.col("plain")).drop("plain")
    commas = F.size(F.split("text", ",")) - 1
    score = 1 + commas + F.least(F.col("size") / 100, F.lit(3.0))
    # above ends with the block's own element
    given = F.array(F.struct(F.get("above", F.size("above") - 2).alias("id"), score.alias("s")), F.struct(F.get("above", F.size("above") - 3).alias("id"), (score / 2).alias("s")))
    scores = blocks.where(able).select("__row", F.explode(given).alias("g")).select("__row", "g.*").where("id is not null").groupBy("__row", "id").agg(F.sum("s").alias("s"))
    texts = blocks.select("__row", F.explode("above").alias("id"), "size", "linked").groupBy("__row", "id").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    nodes = rows.select("__row", F.explode("nodes").alias("x")).select("__row", "x.*")
    # rounded, so that the order in which parts are added up does not count
    judged = scores.join(nodes, ["__row", "id"]).join(texts, ["__row", "id"]).select("__row", "id", "around", F.round((F.col("s") + F.col("base")) * (1 - F.col("linked") / F.col("size")), 6).alias("score"))
    best = judged.groupBy("__row").agg(F.max(F.struct("score", (-F.col("id")).alias("first"), "around")).alias("top"), F.collect_list(F.struct("id", "around", "score")).alias("all"))
    beside = F.filter("all", lambda x: x["around"].eqNullSafe(F.col("top.around")) & (x["score"] >= F.greatest(F.lit(float(BESIDE_LEAST)), BESIDE * F.col("top.score"))))
    chosen = best.select("__row", F.array_union(F.array(-F.col("top.first")), F.transform(beside, lambda x: x["id"])).alias("chosen"), F.lit(True).alias("scored"))
    kept = blocks.join(chosen, "__row", "left").where(F.col("scored").isNull() | F.arrays_overlap("above", "chosen"))
    lines = kept.groupBy("__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return rows.select("__row", *keep).join(lines, "__row", "left").select(*keep, F.coalesce("content", F.lit("")).alias("content"))
