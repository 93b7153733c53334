"""Operators that map texts: against the library, round trips and plain searches."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

from gazetta.llm import htmltext, licenses, media, pieces, tokens
from tests.llm.conftest import ROWS

MODEL = pieces.default_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts(small):
    return [t for (t,) in duckdb.sql(f"select text from '{small}/documents.parquet'").fetchall()]


def awkward(n=2000):
    r = random.Random(7)
    for i in range(1, 40):
        yield " " * i + "foo" + " " * i
    for _ in range(n):
        yield "".join(r.choice("abcdeé ßñ\n\r \t<>=-_*/{}();019thTHeE🙂▁中\x7f") for _ in range(r.randint(0, 30)))


def test_pieces_equal_library(library, texts):
    enc = pieces.encoder(MODEL)
    for t in [*texts, *awkward()]:
        want = library.encode(t, add_eos=True)
        assert enc.encode(t) == want
        assert enc.table.decode(want) == library.decode(want)


def test_pair_test_is_the_merge_rule(library):
    table, r = pieces.piece_table(MODEL), random.Random(3)
    some = [i for i in r.sample(range(300, 32000), 600) if table.stands(i) and pieces.MARK not in table.text[i]]
    for a in some[:150]:
        for b in r.sample(some, 10):
            assert table.follows(a, b) == (table.merged(table.text[a] + table.text[b]) == [table.text[a], table.text[b]])


def test_pieces_odd_rows(odd, empty, library):
    got = {r.doc_id: r for r in pieces.piece_digests(odd, MODEL).collect()}
    assert len(pieces.piece_digests(odd, MODEL).collect()) == len(ROWS)
    for i, t, *_ in ROWS:
        ids = library.encode(t or "", add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(empty, MODEL).count() == 0


def test_counts_equal_library(spark, library, texts, odd, empty):
    rows = list(enumerate([*texts, *awkward(300)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in rows}
    assert sorted(r.n_tokens for r in tokens.count_tokens(odd).collect()) == sorted(len(library.encode(t or "")) for _, t, *_ in ROWS)
    assert tokens.count_tokens(empty).count() == 0


def test_small_caches_change_nothing(library, texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 8)
    monkeypatch.setattr(pieces, "CACHED", 8)
    monkeypatch.setattr(pieces, "PAIRS", 8)
    lengths, enc = tokens.Lengths(MODEL, {}), pieces.Encoder(MODEL)
    for t in texts[:20]:
        assert lengths.count(t) == len(library.encode(t)) and enc.encode(t, end=False) == library.encode(t)


# --- media


def random_jpeg(seed, restart=0):
    """A small progressive JPEG written bit by bit, and its coefficients: DC differences, runs, refinement with new coefficients."""
    r = random.Random(seed)
    wide, high = 3, 2
    blocks = [[0] * 64 for _ in range(wide * high)]
    for b in blocks:
        b[0] = r.randint(-60, 60)
        for k in range(1, 64):
            if r.random() < 0.15:
                b[k] = r.choice([-1, 1]) * r.choice([1, 1, 1, 2, 3, 7, 12])
    dc_codes = {s: format(s, "04b") for s in range(12)}
    ac_symbols = sorted({run << 4 | size for run in range(16) for size in range(5)})
    ac_codes = {s: format(i, "07b") for i, s in enumerate(ac_symbols)}

    def bits(v, size):
        return format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def stuffed(s):
        s += "1" * (-len(s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")

    def parts(n, one):
        step = restart or n
        out = b""
        for k, at in enumerate(range(0, n, step)):
            out += (b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + stuffed(one(range(at, min(n, at + step))))
        return out

    def shifted(v, low):
        return (abs(v) >> low) * (1 if v > 0 else -1)

    def dc_first(group):
        s, before = "", 0
        for i in group:
            d = (blocks[i][0] >> 1) - before
            before = blocks[i][0] >> 1
            s += dc_codes[abs(d).bit_length()] + bits(d, abs(d).bit_length())
        return s

    def ac_first(first, last):
        def one(group):
            s = ""
            for i in group:
                run = 0
                for k in range(first, last + 1):
                    v = shifted(blocks[i][k], 1)
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        s, run = s + ac_codes[0xF0], run - 16
                    n = abs(v).bit_length()
                    s += ac_codes[run << 4 | n] + bits(v, n)
                    run = 0
                if run:
                    s += ac_codes[0]
            return s

        return one

    def ac_refine(first, last):
        def one(group):
            s = ""
            for i in group:
                run, held = 0, ""
                newest = max([k for k in range(first, last + 1) if abs(blocks[i][k]) == 1], default=-1)
                for k in range(first, last + 1):
                    v = abs(blocks[i][k])
                    if v > 1:
                        held += str(v & 1)
                        continue
                    if v == 0:
                        run += 1
                        if run == 16 and k < newest:
                            s += ac_codes[0xF0] + held
                            run, held = 0, ""
                        continue
                    s += ac_codes[run << 4 | 1] + ("1" if blocks[i][k] > 0 else "0") + held
                    run, held = 0, ""
                if run or held:
                    s += ac_codes[0] + held
            return s

        return one

    seg = media._segment
    table = lambda kind, codes, n: seg(0xC4, bytes([kind, *[len(codes) if k == n else 0 for k in range(1, 17)], *codes]))
    out = b"\xff\xd8" + seg(0xDB, bytes([0, *range(1, 65)])) + table(0, dc_codes, 4) + table(0x10, ac_codes, 7)
    out += seg(0xC2, bytes([8, 0, high * 8, 0, wide * 8, 1, 1, 0x11, 0]))
    if restart:
        out += seg(0xDD, bytes([0, restart]))
    n = len(blocks)
    out += media._header(1, 0, 0, 0, 1, 1, 0) + parts(n, dc_first)
    out += media._header(1, 1, 5, 0, 1, 1, 0) + parts(n, ac_first(1, 5)) + media._header(1, 6, 63, 0, 1, 1, 0) + parts(n, ac_first(6, 63))
    out += media._header(1, 1, 63, 1, 0, 1, 0) + parts(n, ac_refine(1, 63))
    out += media._header(1, 0, 0, 1, 0, 1, 0) + parts(n, lambda g: "".join(str(blocks[i][0] & 1) for i in g))
    return out + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize("seed", range(5))
def test_reads_any_progressive_jpeg(seed, restart):
    data, want = random_jpeg(seed, restart)
    image = media.read(data)
    assert (image.components[1].values == want).all()
    q = np.arange(1, 65)
    c = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    block = np.zeros((8, 8))
    block.reshape(64)[media.zigzag()] = want[4] * q
    plain = np.clip(np.rint(c.T @ block @ c + 128), 0, 255)
    assert (media.tensor(data)[8:16, 8:16, 0] == plain).all()


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 70_001])
def test_payloads_come_back(n):
    raw = random.Random(n).randbytes(n)
    payload = media.padded(raw)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and set(payload[n:]) <= {255} and len(payload) - n < 577
    assert media.payload_of(media.read(media.write(payload))) == payload


def test_chroma_is_upsampled():
    image = media.read(media.write(media.padded(bytes(range(256)) * 9)))
    y, cb = image.components[1], image.components[2]
    assert (y.wide, y.high) == (2 * cb.wide, 2 * cb.high)
    assert np.concatenate(list(media.strips(image))).shape == (image.height, image.width, 3)


def test_media_odd_rows(odd, empty):
    got = media.media_digest(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ROWS) and by[2][1:] == by[3][1:] and by[1][1:] == by[5][1:]
    for i, t, *_ in ROWS:
        p = media.padded((t or "").encode())
        assert (by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert media.media_digest(empty).count() == 0
    row = media.to_tensors(media.to_media(odd.where("doc_id = 1"))).first()
    assert len(row.rgb) == row.height * row.width * 3


# --- licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base_places(t):
    w = plain_words(t)
    return sorted((k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())


LICENSES = [
    "Released under the MIT License. Also MIT-license, mit licenses and summit license.", "Apache  License, version 2; apache licence", "GNU General Public License general public license",
    "the mit licence", "mit\nlicense mit license mit", None, "", "!!!", "Permission is hereby granted, free of charge, to any person", "permision is hereby grantd free of charge to", "MIT LICENSE" * 3,
]


def test_base_places(spark, texts):
    rows = list(enumerate([*LICENSES, *texts]))
    got = {r.doc_id: r for r in licenses.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        places, r = base_places(t), got[i]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(plain_words(t)), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_fuzzy_notices():
    assert [(h["label"], h["edits"], h["base"]) for h in licenses.scan("the mit licence")[1]] == [("mit", 1, False)]
    n, hits = licenses.scan("x permision is hereby grantd free of charge to")
    assert [(h["label"], h["first_word"], h["last_word"], h["edits"]) for h in hits] == [("mit", 1, 7, 2)]
    assert licenses.scan("limit licenses admit a licence of lies")[1] == []


def test_license_odd_rows(odd, empty):
    assert licenses.license_digest(odd).count() == len(ROWS) and licenses.license_digest(empty).count() == 0


# --- pages

PROSE = "This is the text of the article and it is about all of the things that you would like to know in this world. " * 3


@pytest.mark.parametrize("open_tag,close_tag", [("<article>", "</article>"), ("<div>", "</div>"), ("<main class=x>", "</main>")])
def test_page(open_tag, close_tag):
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <!-- <p>no</p> --><div class="cookie-notice">We use cookies and this is the text that you have to read.</div><div class=ad>Buy this now.</div>
    {open_tag}<h1>Head &amp; line</h1><p>{PROSE}<p>Short  one<br>goes on.</p><script>var t="</p>";</script><p>{PROSE}</p>{close_tag}
    <form><label>Name</label><input></form><div id="comments"><p>{PROSE}</p></div><aside>More</aside><footer>&copy; me</footer></body></html>"""
    prose = PROSE.strip()
    assert htmltext.main_text(page) == f"Head & line\n\n{prose}\n\nShort one goes on.\n\n{prose}"


def test_header_of_an_article_is_part_of_it():
    page = f"<div class=page-header>Site</div><article><div class='post-header'><h1>Head</h1></div><p>{PROSE}</p><div class=share-bar>Share</div></article>"
    assert htmltext.main_text(page) == f"Head\n\n{PROSE.strip()}"


def test_page_odd_cases(spark, empty):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed"), (4, "u", "<script>never ends <p>x</p>"), (5, "u", "just text"), (6, "u", "a < b <p> & c"), (6, "u", "a < b <p> & c")]
    got = htmltext.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 4)} == {""}


def test_article_of_every_test_page(small):
    for (page,) in duckdb.sql(f"select html from '{small}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        import html

        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x)))).strip() for x in re.split(r"</?p>|</?h1>", article)]
        assert htmltext.main_text(page) == "\n\n".join(filter(None, want))


def test_frequent_parts_come_from_all_rows(spark):
    from gazetta.llm import tokens
    from gazetta.llm.pieces import default_model

    df = spark.createDataFrame([(i, "early" if i < 2_500 else "late late") for i in range(5_000)], "doc_id long, text string").coalesce(1)
    assert any("late" in p for p in tokens.frequent_parts(df, "text", default_model()))


def test_runs_of_marks(library):
    import time

    enc = pieces.encoder(MODEL)
    for n in [*range(1, 120), *range(120, 5001, 61), 4999, 5000]:
        for t in (" " * n, f"x{' ' * n}y", f"{' ' * n}ü\n{pieces.MARK * n}"):
            assert enc.encode(t, end=False) == library.encode(t)
    assert enc.table.longest_run == 16
    for n in range(1, 200):
        assert enc.table.run_of_marks(n) == [enc.table.ids[x] for x in enc.table.merged(pieces.MARK * n)]
    for t in (" " * 1_000_000, "a" * 1_000_000, "\n" * 1_000_000, "a," * 500_000, pieces.MARK * 1_000_000):
        began = time.perf_counter()
        enc.encode(t)
        assert time.perf_counter() - began < 6


def test_texts_are_cut_only_where_no_piece_crosses(library, monkeypatch):
    pattern = pieces._CROSSES
    assert not any(pattern.search(p) for p in pieces.piece_table(MODEL).ids)
    import re

    monkeypatch.setattr(pieces, "_CROSSES", re.compile("the"))
    with pytest.raises(ValueError, match="crosses"):
        pieces.PieceTable(MODEL)
    r = random.Random(11)
    enc = pieces.encoder(MODEL)
    for _ in range(1500):
        t = "".join(r.choice(["a", "é", "Word", ",", ".", ",,", ". ", " ", "\n", "1", "²", ")", "the", "..", "_", "ÿ"]) for _ in range(r.randint(1, 25)))
        assert enc.encode(t, end=False) == library.encode(t)


def test_workers_keep_what_they_made():
    from gazetta.llm.common import KEPT, Remembered, once_per_worker

    made = []
    for key in ("a", "b", "a", "a", "b"):
        once_per_worker(f"test-{key}", lambda: made.append(1) or object())
    assert len(made) == 2
    for i in range(KEPT):
        once_per_worker(f"more-{i}", object)
    once_per_worker("test-a", lambda: made.append(1))
    assert len(made) == 3
    seen = Remembered(lambda k: k * 2, 4, 3, {"z": 0})
    for k in ("a", "b", "c", "a", "long", "long", "z"):
        assert seen[k] == (0 if k == "z" else k * 2)
    assert "long" not in seen and len(seen) <= 4


def test_no_exchange_of_parts(spark, odd):
    plan = tokens.count_tokens(odd.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]
