"""SentencePiece encoding and decoding with a prefix table.

A merge-type vocabulary merges the adjacent pair whose concatenation has the best score, leftmost first. For
every prefix of a string the result then has one last token, and a token can follow another exactly if the two,
encoded together, stay as they are. So one pass of an automaton over the string, which lists the pieces that end
at each place, and a test of each against the last token before it fill a table of last tokens; the ids are read
from its end backwards. No merge loop over the text is needed.

No piece of these vocabularies has a space mark behind another character or a comma or full stop behind a letter, and
none joins a line feed to anything (the table refuses a vocabulary that does). No merge crosses such a place, so text is
cut there without changing a single id, and each worker remembers the cut parts that it has encoded.

Defined results: null and empty texts have the end id alone; texts of any length are cut and handled whole; bytes
outside the vocabulary fall back to byte pieces; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import chain

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from gazetta.llm.common import Remembered, map_texts

MARK = "▁"
#: Letters that no piece has before a comma or a full stop.
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: The parts that are encoded one by one: space marks with what follows, or a line's first word, or line feeds; letters
#: before a comma or a full stop end a part.
PARTS = re.compile(rf"[ {MARK}]+(?:{LETTER}++(?=[,.])|[^ {MARK}\n]*)|{LETTER}++(?=[,.])|[^ {MARK}\n]+|\n+")
#: What a piece may not hold if texts are cut into these parts.
_CROSSES = re.compile(rf"[^{MARK}]{MARK}|{LETTER}[,.]|.\n|\n.", re.S)
#: Parts that a worker remembers, pairs whose test it remembers, and the longest part remembered.
CACHED, PAIRS, LONGEST = 400_000, 1_000_000, 64


class PieceTable:
    """The vocabulary of a model file as an automaton with pair tests."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        size = range(model.get_piece_size())
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in size if model.is_byte(i)}
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.ids = {piece: i for i, piece in self.text.items()}
        crossing = next((piece for piece in self.ids if _CROSSES.search(piece)), None)
        if crossing is not None:
            raise ValueError(f"the piece {crossing!r} crosses the places where texts are cut")
        self.score = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.raw = [b""] * len(size)
        for i, piece in self.text.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self.unknown = model.unk_id()
        self.decimal = [str(i) for i in size]
        self.fits: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: The place of each piece in the order of merges.
        self.order = [0] * len(size)
        for place, i in enumerate(sorted(plain, key=lambda i: -model.get_score(i))):
            self.order[i] = place
        #: The pieces that the rule makes at all, to be listed where they end in a text.
        self.found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.stands(i):
                self.found.add_word(piece, (len(piece), i))
        self.found.make_automaton()
        self.sizes = [len(self.text.get(i, "x")) for i in size]
        #: Marks of the longest piece of marks that a run of its length becomes, if all such pieces have one score; else 0.
        runs = [piece for piece in self.ids if set(piece) == {MARK}]
        longest = max(map(len, runs), default=0)
        same = len({self.score[piece] for piece in runs}) == 1
        self.longest_run = longest if same and self.merged(MARK * longest) == [MARK * longest] else 0

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for the few characters of one or two pieces."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                value = score.get(parts[i] + parts[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, i: int) -> bool:
        """Whether a piece, encoded alone, stays one piece; the rule never makes the others."""
        return self.split(i) is not None

    def split(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i (i twice: a single character), or None if nothing makes it."""
        if i in self.halves:
            return self.halves[i]
        parts, made = list(self.text[i]), (i, i)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                value = self.score.get(parts[k] + parts[k + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, k
            if best is None:
                made = None
                break
            made = (self.ids[parts[at]], self.ids[parts[at + 1]]) if parts[at] in self.ids and parts[at + 1] in self.ids else None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.halves[i] = made
        return made

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can stand behind piece a.

        Merges are undone from the latest back. Wherever the two pieces that then touch would have merged before the
        merge just undone, the rule would have joined them across the border.
        """
        text, ids, order = self.text, self.ids, self.order
        left, right = a, b
        limit = len(order)
        while True:
            joined = ids.get(text[left] + text[right])
            if joined is not None and order[joined] < limit:
                return False
            made_left = order[left] if len(text[left]) > 1 else -1
            made_right = order[right] if len(text[right]) > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = made_left, self.split(left)[1]
            else:
                limit, right = made_right + 1, self.split(right)[0]

    def run_of_marks(self, n: int) -> list[int]:
        """Space marks alone: their pieces have equal scores, where pair tests say too little.

        Of equal scores the leftmost pair merges first, so marks gather at the run's start until its piece is the longest
        one, which merges with nothing; the rest is a run by itself. Thus all but less than one longest piece is known.
        """
        longest = self.longest_run
        head = [self.ids[MARK * longest]] * (n // longest) if longest else []
        return head + [self.ids[x] for x in self.merged(MARK * (n - len(head) * longest))]

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of one part, in which spaces are marks."""
        n = len(part)
        head = n - len(part.lstrip(MARK))
        if head > 1:
            if head == n:
                return tuple(self.run_of_marks(n))
            if head > 2 or self.merged(part[: head + 1])[-1] != MARK + part[head]:
                return self.marked(part, head)
        last = [-1] * (n + 1)
        fits = self.fits
        for at, (length, i) in self.found.iter(part):
            at += 1
            if last[at] >= 0:
                continue
            if length < at and (a := last[at - length]) >= 0:
                good = fits.get(key := a << 20 | i)
                if good is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    good = fits[key] = self.follows(a, i)
                if not good:
                    continue
            last[at] = i
        return self.backwards(part, last)

    def marked(self, part: str, head: int) -> tuple[int, ...]:
        """A run of space marks before a word. The word takes the last mark if any piece begins so, since those score higher."""
        tail = self.encode_part(part[head - 1 :])
        first = self.text.get(tail[0], "")
        if first.startswith(MARK) and len(first) > 1:
            return (*self.run_of_marks(head - 1), *tail)
        return (*self.run_of_marks(head), *tail[1:])

    def backwards(self, part: str, last: list[int]) -> tuple[int, ...]:
        out, at, sizes = [], len(part), self.sizes
        while at:
            if last[at] < 0:
                out.extend(self.byte.get(b, self.unknown) for b in reversed(part[at - 1].encode()))
                at -= 1
            else:
                out.append(last[at])
                at -= sizes[last[at]]
        return tuple(reversed(out))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the one put before the text goes, control ids have no text."""
        return self.text_of(b"".join(map(self.raw.__getitem__, ids)))

    @staticmethod
    def text_of(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder(Remembered):
    """Ids by part. encode() has the ids of a text."""

    def __init__(self, path: str):
        self.table = table = piece_table(path)
        super().__init__(lambda part: table.encode_part(part.replace(" ", MARK)), CACHED, LONGEST)

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = list(chain.from_iterable(map(self.__getitem__, PARTS.findall(f" {text}")))) if text else []
        if end:
            ids.append(self.table.end)
        return ids


class Digester(Remembered):
    """Number of ids, the ids in decimal, and the bytes they decode to, by part; digest() puts a text's parts together."""

    def __init__(self, path: str):
        self.table = table = piece_table(path)

        def of(part: str) -> tuple[int, str, bytes]:
            ids = table.encode_part(part.replace(" ", MARK))
            return len(ids), " ".join(map(table.decimal.__getitem__, ids)), b"".join(map(table.raw.__getitem__, ids))

        super().__init__(of, CACHED, LONGEST)

    def digest(self, text: str) -> tuple[int, str, str]:
        """The number of ids with the end id, and the hashes of the ids and of the decoded text."""
        counts, said, raw = zip(*map(self.__getitem__, PARTS.findall(f" {text}")), strict=True) if text else ((), (), ())
        decimals = " ".join([*said, self.table.decimal[self.table.end]])
        decoded = self.table.text_of(b"".join(raw))
        return sum(counts) + 1, hashlib.sha256(decimals.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@cache
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def digester(path: str) -> Digester:
    return Digester(path)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, n_tokens, ids (with the end id), decoded: the ids of each whole text and their text."""

    def make():
        enc = encoder(model)

        def one(x: str) -> tuple:
            ids = enc.encode(x)
            return len(ids), ids, enc.table.decode(ids)

        return one

    return map_texts(docs, text, list(keep), make, "n_tokens long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Like encode_pieces, but only the hashes of ids and decoded text leave the worker."""

    return map_texts(docs, text, list(keep), lambda: digester(model).digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")
