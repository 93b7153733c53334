"""License scans: fuzzy search for short notices.

A text becomes its words (A-Z lower-cased, all but letters, digits and non-ASCII characters taken as borders), joined
by single spaces. A notice that may differ by k edits is cut into k + 1 pieces: if it occurs with k edits, at least
one piece occurs unchanged. These seeds locate candidates by exact search; a pattern with bounded errors (best match
first) verifies each span of whole words that a seed allows, and counts its edits. The words that name a license must
stand in the span unchanged, so "kit license" is no MIT license. Of spans of a notice that overlap, the one with fewest
edits counts, then the first, then the shortest.

Exact places of a notice are a case of this with no edits. They are found through the seeds as well, and a notice's
first word must start and its last word end at word borders.

Defined results: null, empty or wordless texts have no words, no places, empty labels and score 0; overlapping
places of one notice all count; repeated rows repeat their result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import map_texts
from gazetta.llm.decontam import words_of


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    edits: int
    base: bool = False
    name: str = ""


#: Short notices, their labels, the edits they may differ by, and the words that may not differ.
NOTICES = (
    Notice("mit license", "mit", 1, base=True, name="mit"),
    Notice("apache license", "apache", 2, base=True, name="apache"),
    Notice("general public license", "gpl", 3, base=True, name="general public"),
    Notice("lesser general public license", "lgpl", 3, name="lesser general public"),
    Notice("mozilla public license", "mpl", 3, name="mozilla"),
    Notice("eclipse public license", "epl", 3, name="eclipse"),
    Notice("bsd license", "bsd", 1, name="bsd"),
    Notice("isc license", "isc", 1, name="isc"),
    Notice("creative commons attribution", "cc", 3, name="creative commons"),
    Notice("released into the public domain", "public domain", 3, name="public domain"),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("licensed under the apache license version 2 0", "apache", 4, name="apache"),
    Notice("you may not use this file except in compliance with the license", "apache", 5),
    Notice("spdx license identifier", "spdx", 2, name="spdx"),
    Notice("all rights reserved", "all rights reserved", 2),
)


def seeds(words: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice's edits + 1 pieces and where they start."""
    raw, n = words.encode(), edits + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def plans(notices: tuple[Notice, ...]) -> list[tuple[Notice, list[tuple[int, bytes]], regex.Pattern]]:
    return [(n, seeds(n.words, n.edits), regex.compile(rf"(?b:{regex.escape(n.words, special_only=True, literal_spaces=True)}){{e<={n.edits}}}")) for n in notices]


def edits_of(part: bytes, notice: Notice, pattern: regex.Pattern) -> int | None:
    """The edits of a span of whole words; None if they are too many or change the name."""
    if part == notice.words.encode():
        return 0
    if notice.name and f" {notice.name} ".encode() not in b" " + part + b" ":
        return None
    text = part.decode("utf-8", "replace")
    m = pattern.fullmatch(text) if abs(len(text) - len(notice.words)) <= notice.edits else None
    return sum(m.fuzzy_counts) if m else None


def search(text: bytes, notice: Notice, cut: list[tuple[int, bytes]], pattern: regex.Pattern) -> list[tuple[int, int, int]]:
    """Spans (start, end, edits) of a notice in space-framed words, in order; bytes. Spans do not overlap.

    A character may have up to four bytes, so an inserted one moves a border by as many.
    """
    n, slack = len(notice.words), 4 * notice.edits
    found: dict[tuple[int, int], int | None] = {}
    # equal spans have equal edits: in a text that repeats a notice few are looked at
    known: dict[bytes, int | None] = {}
    for start, seed in cut:
        at = text.find(seed)
        while at >= 0:
            starts = [p for p in range(max(1, at - start - slack), at - start + slack + 1) if text[p - 1 : p] == b" "]
            ends = [q for q in range(at - start + n - slack, min(at - start + n + slack, len(text) - 1) + 1) if text[q : q + 1] == b" "]
            for p in starts:
                for q in ends:
                    if q > p and (p, q) not in found:
                        part = text[p:q]
                        if part not in known:
                            known[part] = edits_of(part, notice, pattern)
                        found[p, q] = known[part]
            at = text.find(seed, at + 1)
    return chosen((e, p, q) for (p, q), e in found.items() if e is not None)


def chosen(spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (edits, start, end) that overlap the best one, as (start, end, edits) in order."""
    starts, ends, out = [], [], []
    for e, p, q in sorted(spans):
        k = bisect_left(starts, p)
        if (k < len(starts) and starts[k] < q) or (k and ends[k - 1] > p):
            continue
        starts.insert(k, p)
        ends.insert(k, q)
        out.append((p, q, e))
    return sorted(out)


def scan(text: str, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[dict]]:
    """The number of words, and every match: label, base, first and last word, edits and the notice's length."""
    words = words_of(text)
    if not words:
        return 0, []
    joined = b" " + b" ".join(words) + b" "
    hits = []
    for notice, cut, pattern in plans(notices):
        if not any(seed in joined for _, seed in cut):
            continue
        done, upto = 0, 0
        for a, b, edits in search(joined, notice, cut, pattern):
            done += joined.count(b" ", upto, a)
            upto = a
            hits.append(
                {"label": notice.label, "base": notice.base and edits == 0, "first_word": done - 1, "last_word": done - 1 + joined.count(b" ", a, b), "edits": edits, "length": len(notice.words)}
            )
    return len(words), hits


_HIT = "label:string,base:boolean,first_word:long,last_word:long,edits:int,length:int"


def license_hits(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """keep's columns, n_words, hits: each verified notice with its span in words (from 0, last included) and its edits."""
    return map_texts(docs, text, list(keep), lambda: lambda x: scan(x, notices), f"n_words long, hits array<struct<{_HIT}>>")


def license_digest(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base places, labels and a score: the best match's share of unchanged characters, 0 without a match."""
    hits = license_hits(docs, text, keep)
    base = F.filter("hits", lambda h: h["base"])
    score = F.array_max(F.transform("hits", lambda h: 1 - h["edits"] / h["length"]))

    def labels(of):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda h: h["label"]))))

    return hits.select(
        *keep,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("hits").alias("labels"),
        F.coalesce(score, F.lit(0.0)).cast("double").alias("score"),
        F.size("hits").cast("long").alias("n_hits"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["edits"])), F.lit(0)).cast("long").alias("most_edits"),
    )
