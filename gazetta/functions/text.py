"""Cleaning, titles, language by script, entity names, snippets, chunks and embedding input."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gazetta.functions import vectors as V

#: Character references that are resolved without Python; the ampersand comes last.
COMMON_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&reg;": "®", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}

#: What cleaning keeps besides word characters and white space. "compat" is the range that the original
#: pattern's escapes really name (so ASCII loses only ! to /); "strict" is what they were meant to name.
KEPT_COMPAT = r"\x{30}-\x{2cea}\x{3300}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}"
KEPT_STRICT = r"\x{3300}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{20000}-\x{2a6df}\x{2a700}-\x{2ceaf}"

#: What counts as white space at the ends of a text.
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

HAN, KANA, HANGUL = r"\x{4e00}-\x{9fff}", r"\x{3040}-\x{30ff}", r"\x{ac00}-\x{d7af}"


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


#: Rows, and bytes of texts on average, of an Arrow batch that become Python objects at once.
SLICE, SLICE_BYTES = 256, 1 << 20


def pieces(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of Arrow batches, a slice at a time: the objects that a worker holds follow the slice and not the batch."""
    for a in parts:
        rows = max(1, min(SLICE, SLICE_BYTES * len(a) // max(1, a.nbytes)))
        for at in range(0, max(1, len(a)), rows):
            yield a.slice(at, rows)


def slices(parts: Iterator[pa.Array]) -> Iterator[pd.Series]:
    for a in pieces(parts):
        yield a.to_pandas()


@F.arrow_udf(StringType())
def _unescape_all(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in slices(parts):
        yield pa.Array.from_pandas(s.map(html.unescape, na_action="ignore"), type=pa.string())


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


@F.arrow_udf(StringType())
def _unescape_closed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in slices(parts):
        yield pa.Array.from_pandas(s.map(lambda x: _CLOSED.sub(_closed, x), na_action="ignore"), type=pa.string())


def strip(c: Column) -> Column:
    """c without white space at its ends, line breaks and tabs too."""
    return F.trim(c, F.lit(WHITE))


def unescape(c: Column, entities: str = "full") -> Column:
    """Character references resolved: all of HTML's in Python ("full"; "closed": only those that end in a semicolon), or the common ones as an expression ("common")."""
    if entities in ("full", "closed"):
        return (_unescape_all if entities == "full" else _unescape_closed)(c)
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), COMMON_ENTITIES.items(), c)


def clean_text(c: Column, mode: str = "compat", entities: str = "full") -> Column:
    """References resolved, tags removed (no space instead), white space to one space, odd characters removed, trimmed.

    Null and empty become empty.
    """
    text = unescape(F.coalesce(c, F.lit("")), entities)
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.regexp_replace(text, rf"(?U)[^\w\s{KEPT_COMPAT if mode == 'compat' else KEPT_STRICT}]", "")
    return F.trim(text)


def normalize_text(c: Column, **options) -> Column:
    return F.lower(clean_text(c, **options))


def _first_of(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), clean_text(F.regexp_extract(c, pattern, 1), entities="common"))


def extract_title(c: Column) -> Column:
    """The first title element on one line, else the first h1, else null. An empty title is a title."""
    return F.coalesce(_first_of(c, r"(?i)<title[^>]*>(.*?)</title>"), _first_of(c, r"(?i)<h1[^>]*>(.*?)</h1>"))


def extract_meta_description(c: Column) -> Column:
    """The content of a meta element whose name comes first; null without one."""
    return _first_of(c, r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""")


def extract_author(c: Column) -> Column:
    """The content of the author meta element; null without one."""
    return _first_of(c, r"""(?i)<meta[^>]*name=["']author["'][^>]*content=["']([^"']*)["']""")


def extract_published(c: Column) -> Column:
    """The content of the article:published_time meta element; null without one."""
    pattern = r"""(?i)<meta[^>]*property=["']article:published_time["'][^>]*content=["']([^"']*)["']"""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def script_share(c: Column, characters: str) -> Column:
    """Share of the characters of a class; 0 for null and empty."""
    text = F.coalesce(c, F.lit(""))
    share = F.length(F.regexp_replace(text, f"[^{characters}]", "")) / F.length(text)
    return F.when(F.length(text) > 0, share).otherwise(0.0)


def detect_language(c: Column, variant: str = "service") -> Column:
    """zh-cn, ja, ko or en by shares of scripts above a tenth.

    Variant "translator": code zh, kana alone for ja, and texts under three characters are en.
    """
    if variant == "service":
        return (
            F.when(script_share(c, HAN) > 0.1, "zh-cn").when(script_share(c, KANA + HAN) > 0.1, "ja").when(script_share(c, HANGUL) > 0.1, "ko").otherwise("en")
        )
    found = F.when(script_share(c, HAN) > 0.1, "zh").when(script_share(c, KANA) > 0.1, "ja").when(script_share(c, HANGUL) > 0.1, "ko").otherwise("en")
    return F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) < 3, "en").otherwise(found)


def language_confidence(c: Column) -> Column:
    """Struct of the four shares; Han counts for zh and for ja, as in detect_language."""
    zh, ja, ko = script_share(c, HAN), script_share(c, KANA + HAN), script_share(c, HANGUL)
    return F.struct(zh.alias("zh"), ja.alias("ja"), ko.alias("ko"), F.greatest(1 - zh - ja - ko, F.lit(0.0)).alias("en"))


def needs_translation(language: Column, text: Column) -> Column:
    code = F.lower(F.coalesce(language, F.lit("unknown")))
    return ~code.isin("en", "english") & (F.length(F.coalesce(text, F.lit(""))) > 10)


def normalize_entity(c: Column) -> Column:
    """Trimmed, single spaces, lower case, no leading article, no trailing company form."""
    name = F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " "))
    name = F.regexp_replace(name, r"^(the|a|an)\s+", "")
    return F.regexp_replace(name, r"\s+(inc|corp|llc|ltd|co|company|corporation)$", "")


def snippet(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def first_line(c: Column, size: int = 100) -> Column:
    """A title for texts that have none: the first line's first characters."""
    return F.substring(F.substring_index(F.coalesce(c, F.lit("")), "\n", 1), 1, size)


def chunk_text(c: Column, size: int = 100_000) -> Column:
    """Chunks of sentences (parted by ". ") packed while they stay under size; a longer sentence is a chunk by itself.

    A text of at most size characters is one chunk as it is. Null is no chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(state: Column, sentence: Column) -> Column:
        piece, held = F.concat(sentence, F.lit(". ")), state["open"]
        fits = F.length(held) + F.length(sentence) < size
        done = F.when(fits | (F.length(held) == 0), state["done"]).otherwise(F.array_append(state["done"], F.trim(held)))
        return F.struct(done.alias("done"), F.when(fits, F.concat(held, piece)).otherwise(piece).alias("open"))

    def finish(state: Column) -> Column:
        return F.when(F.length(state["open"]) == 0, state["done"]).otherwise(F.array_append(state["done"], F.trim(state["open"])))

    packed = F.aggregate(F.split(c, r"\. ", -1), start, pack, finish)
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.length(c) <= size, F.array(c)).otherwise(packed)


def translation_chunks(text: str, size: int = 450) -> list[str]:
    """Chunks of at most size characters for services with a limit: by sentences, long sentences by words, long words in pieces; no character but white space is lost."""
    if len(text) <= size:
        return [text]
    chunks: list[str] = []
    held = ""

    def add(piece: str) -> None:
        nonlocal held
        if held and len(held) + len(piece) > size:
            chunks.append(held.strip())
            held = ""
        held += piece

    parts = text.split(". ")
    for i, part in enumerate(parts):
        sentence = part if i == len(parts) - 1 else part + (" " if part.endswith(".") else ". ")
        if len(sentence) <= size or held:
            add(sentence)
            if len(held) <= size:
                continue
            sentence, held = held, ""
        for word in sentence.split():
            for at in range(0, len(word), size - 1):
                add(word[at : at + size - 1] + " ")
    if held.strip():
        chunks.append(held.strip())
    return chunks


@F.arrow_udf(ArrayType(StringType()))
def split_for_translation(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in slices(parts):
        yield pa.array([translation_chunks(x or "") for x in s], type=pa.list_(pa.string()))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "), r"(?U)[^\w\s.,!?\-:]", " ")


def embedding_text(title: Column, content: Column, tags: Column | None = None, entities: Column | None = None, size: int = 2000) -> Column:
    """Title, content (cut at size characters, with "..."), "Topics: ..." and "Entities: ...", joined by spaces."""

    def some(c: Column) -> Column:
        return V.let(c, lambda x: F.when(F.length(x) > 0, x))

    def listed(name: str, values: Column | None) -> Column:
        if values is None:
            return F.lit(None).cast("string")
        kept = F.transform(F.filter(values, lambda x: F.length(x) > 0), _plain)
        return F.when(F.size(kept) > 0, F.concat(F.lit(f"{name}: "), F.concat_ws(" ", kept)))

    return F.concat_ws(" ", some(_plain(title)), some(V.let(_plain(content), lambda x: snippet(x, size))), listed("Topics", tags), listed("Entities", entities))
