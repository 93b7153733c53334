"""Line dedup: later copies of repeated runs of lines go. DataFrame operations only.

All lines of all documents form one sequence of line ids, in order of document id; gid is a line's place in it. The
suffix ranks of that sequence are found by prefix doubling: the rank class of the 2 ** (k + 1) lines from a place is
given by the classes of its two halves, and is named by its first place. Places whose class has one member leave, so
the work follows the repeated lines. Joins are always by a shuffle: the files of these tables, by which Spark sizes them, are
a small part of their rows in memory.

A run that occurs before (a maximal repeat) is deleted if it has more than min_words words. The intervals of suffixes
that share such a prefix are found without a sequential scan: from each place, the fewest lines that have more than
min_words words are a window, and so are the fewest that end at a place. Equal runs have equal windows, so a
window's interval (its lcp value is at least the window's length) is keyed by two overlapping classes that cover it, and
all but the interval's first place are later copies. The union of the windows of a repeat is the repeat: a line with
enough words behind it lies in its own window, and any other in the one that ends the repeat. A window has at most
min_words + 1 lines, as a line counts its blanks plus one, so log2(min_words) doublings decide all.

Defined results: a null text is one empty line; the earliest copy (by id, nulls first; then by text hash) stays; rows
that agree in id and text are one document and get the same text; lines are compared as they are, by 128 bits of hash;
copies that overlap in one document lose all but the first period; columns of docs other than text stay as they are, but
for columns named as the added ones, which these replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.llm.common import materialize

#: A repeated run with more words than this is deleted where it occurs again.
MIN_WORDS = 50
ADDED = ("n_lines", "n_removed")
_KEY = ["__id", "__k1", "__k2"]


def _hashes(column: str, a: str, b: str) -> list:
    return [F.xxhash64(F.col(column)).alias(a), F.xxhash64(F.lit(7), F.col(column)).alias(b)]


def line_table(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """One row per line: document key, pos, gid, line hash, and the lengths in lines of the windows that begin and end there."""
    whole = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    lines = F.transform(
        F.split("__t", "\n", -1),
        lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long").alias("w")),
    )
    # written first: finding the ranges reads all rows once more, and this reads hashes and no texts
    rows = materialize(whole.select("__id", *_hashes("__t", "__k1", "__k2"), lines.alias("__lines"))).repartitionByRange(*_KEY)
    # range partitions hold equal keys together, so the windows below need no further exchange
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.lit(1)))).where("__n = 1").drop("__n")
    placed = one.sortWithinPartitions(*_KEY).select(*_KEY, F.size("__lines").alias("n"), F.posexplode("__lines").alias("pos", "x"))
    placed = placed.select(*_KEY, "n", "pos", F.monotonically_increasing_id().alias("gid"), "x.h1", "x.h2", "x.w")
    by_doc = Window.partitionBy(*_KEY)
    placed = placed.withColumn("c", F.sum("w").over(by_doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("last_c", F.max("c").over(by_doc)).withColumn("s", F.col("c") - F.col("w"))
    behind = F.min("pos").over(by_doc.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, -(min_words + 1)))
    before = F.max("pos").over(by_doc.orderBy("c").rangeBetween(Window.unboundedPreceding, -(min_words + 1)))
    whole_tail = F.when(F.col("last_c") - F.col("s") > min_words, F.col("n"))
    whole_head = F.when(F.col("c") > min_words, F.lit(-1))
    return placed.select(
        *_KEY,
        "n",
        "pos",
        "gid",
        "h1",
        "h2",
        (F.coalesce(behind, whole_tail) - F.col("pos")).cast("long").alias("ahead"),
        (F.col("pos") - F.coalesce(before, whole_head)).cast("long").alias("back"),
    )


def _classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Classes with several members, named by their first place."""
    return materialize(rows.groupBy(*by).agg(F.min("gid").alias("name"), F.count("*").alias("__m")).where("__m > 1").drop("__m"))


def _level(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks of runs of 2 ** (k + 1) lines from those of 2 ** k: gid, last gid of the document, name."""
    step = 1 << k
    right = ranks.select((F.col("gid") - step).alias("__g"), F.col("name").alias("__right"), F.col("last").alias("__last"))
    pairs = materialize(ranks.join(right.hint("merge"), (F.col("gid") == F.col("__g")) & (F.col("last") == F.col("__last"))).select("gid", "last", F.col("name").alias("__left"), "__right"))
    named = _classes(pairs, ["__left", "__right"]).select(F.col("__left").alias("__a"), F.col("__right").alias("__b"), "name")
    return materialize(pairs.join(named.hint("merge"), (F.col("__left") == F.col("__a")) & (F.col("__right") == F.col("__b"))).select("gid", "last", "name"))


def repeats(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows that are later copies: document key, pos, and end, the last line's pos."""
    ahead = lines.where("ahead is not null").select(*_KEY, "pos", "gid", F.col("ahead").alias("size"))
    back = lines.where("back > 1").select(*_KEY, (F.col("pos") - F.col("back") + 1).alias("pos"), (F.col("gid") - F.col("back") + 1).alias("gid"), F.col("back").alias("size"))
    first = _classes(lines.select("gid", "h1", "h2"), ["h1", "h2"]).withColumnsRenamed({"h1": "__a", "h2": "__b"})
    ranks = materialize(
        lines.select("gid", "h1", "h2", (F.col("gid") - F.col("pos") + F.col("n") - 1).alias("last"))
        .join(first.hint("merge"), (F.col("h1") == F.col("__a")) & (F.col("h2") == F.col("__b")))
        .select("gid", "last", "name")
    )
    windows = None
    levels = (min_words + 1).bit_length()
    for k in range(levels):
        # sizes from 2 ** k up to the next power: two runs of 2 ** k lines cover the window
        mine = ahead.unionByName(back).where((F.col("size") >= 1 << k) & (F.col("size") < 2 << k))
        left = ranks.select(F.col("gid").alias("__g"), F.col("name").alias("__left"))
        right = ranks.select(F.col("gid").alias("__h"), F.col("name").alias("__right"))
        both = mine.join(left.hint("merge"), F.col("gid") == F.col("__g")).drop("__g")
        both = both.join(right.hint("merge"), F.col("gid") + F.col("size") - (1 << k) == F.col("__h")).drop("__h") if k else both.withColumn("__right", F.col("__left"))
        windows = both if windows is None else windows.unionByName(both)
        if k + 1 < levels:
            ranks = _level(ranks, k)
    # a window's size tells its k, so one pass over (size, first class, last class) finds the intervals of all levels
    windows = materialize(windows)
    named = _classes(windows, ["size", "__left", "__right"]).withColumnsRenamed({"size": "__s", "__left": "__a", "__right": "__b"})
    same = (F.col("size") == F.col("__s")) & (F.col("__left") == F.col("__a")) & (F.col("__right") == F.col("__b"))
    late = windows.join(named.hint("merge"), same).where("gid > name").select(*_KEY, "pos", (F.col("pos") + F.col("size") - 1).alias("end"))
    return materialize(late)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less its later copies of repeated runs; adds n_lines (before) and n_removed, in place of such columns of docs."""
    lines = materialize(line_table(docs, doc_id, text, min_words))
    late = repeats(lines, min_words)
    reach = late.groupBy(*_KEY, "pos").agg(F.max("end").alias("end"))
    touched = late.select(*[F.col(c).alias(f"_{c}") for c in _KEY]).distinct()
    match = F.col("__id").eqNullSafe(F.col("___id")) & (F.col("__k1") == F.col("___k1")) & (F.col("__k2") == F.col("___k2"))
    rows = lines.select(*_KEY, "pos").join(touched.hint("merge"), match, "left_semi")
    ends = reach.select(*[F.col(c).alias(f"_{c}") for c in _KEY], F.col("pos").alias("__p"), "end")
    rows = rows.join(ends.hint("merge"), match & (F.col("pos") == F.col("__p")), "left").select(*_KEY, "pos", "end")
    far = F.max("end").over(Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    flags = rows.withColumn("kept", F.coalesce(far < F.col("pos"), F.lit(True))).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "kept"))).alias("__flags"))
    flags = materialize(flags.select(*[F.col(c).alias(f"_{c}") for c in _KEY], F.transform("__flags", lambda x: x["kept"]).alias("__kept")))
    keyed = docs.withColumns({"__id": F.col(doc_id), "__t": F.coalesce(F.col(text), F.lit(""))})
    keyed = keyed.withColumns({"__k1": F.xxhash64("__t"), "__k2": F.xxhash64(F.lit(7), F.col("__t"))})
    # always by a shuffle: the flags grow with the input, and a plan that changes with their size is hard to budget for
    joined = keyed.join(flags.hint("merge"), match, "left")
    parts = F.split("__t", "\n", -1)
    left = F.filter(parts, lambda _, i: F.get("__kept", i))
    new = F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.concat_ws("\n", left))
    removed = F.coalesce(F.size(F.filter("__kept", lambda x: ~x)), F.lit(0)).cast("long")
    out = joined.withColumns({text: new, "n_lines": F.size(parts).cast("long"), "n_removed": removed})
    return out.select(*[c for c in docs.columns if c not in ADDED], *ADDED)


#: The same in DuckDB's SQL, by comparing the windows' texts themselves. {0}: min_words.
ORACLE = r"""
with lines as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), sums as (
  select *, sum(w) over (partition by doc_id order by pos) as c from (select *, length(line) - length(replace(line, ' ', '')) + 1 as w from lines)
), spans as (
  select a.doc_id, a.pos as first, min(b.pos) as last from sums a join sums b on a.doc_id = b.doc_id and b.pos >= a.pos and b.c - a.c + a.w > {0} group by all
  union
  select b.doc_id, max(a.pos) as first, b.pos as last from sums a join sums b on a.doc_id = b.doc_id and b.pos >= a.pos and b.c - a.c + a.w > {0} group by b.doc_id, b.pos
), texts as (
  select s.doc_id, s.first, s.last, string_agg(l.line, chr(10) order by l.pos) as t
  from spans s join lines l on l.doc_id = s.doc_id and l.pos between s.first and s.last group by all
), late as (
  select * from (select *, row_number() over (partition by t order by doc_id, first) as k, min(doc_id * 1000000 + first) over (partition by t) as least from texts)
  where doc_id * 1000000 + first > least
), gone as (
  select distinct l.doc_id, l.pos from lines l join late on l.doc_id = late.doc_id and l.pos between late.first and late.last
)
select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
  coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text
from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
"""


def oracle(min_words: int = MIN_WORDS) -> str:
    return ORACLE.replace("{0}", str(min_words))
