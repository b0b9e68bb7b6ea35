"""Unigram token counts without making tokens.

The vocabulary is a public SentencePiece file's normal pieces with their stored scores, taken as a unigram model
with byte fallback. An Aho-Corasick automaton gives all pieces that end at each character, longest first; dynamic
programming keeps, per position, the best score and the number of pieces that reach it. Tie rules are those of the
public unigram tokenizers: a later start replaces an earlier one only with a strictly better score, and a character
that no one-character piece covers may also be unknown, at 10 below the least score; unknown characters count their
UTF-8 bytes.

No piece holds the space sign after another character, and none holds a line feed (both are checked when the
vocabulary is read), so a best path breaks wherever a space run begins and around line feeds, and the stored scores
are whole numbers, so sums over the parts are exact. Each part is therefore solved by itself, and short ones are
remembered per worker.

Defined results: null and empty texts have 0 tokens and score 0; white space other than U+0020 is ordinary text;
any length of text is taken whole, in time proportional to it; a null ``doc_id`` stays null; repeated rows stay; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent

SPACE = "▁"
#: Parts of up to so many characters are remembered, twice so many per worker.
REMEMBER_CHARS, REMEMBER = 40, 200_000
_part = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")


def pieces_of(model_file: str) -> dict[str, float]:
    """Normal pieces of a SentencePiece file with their scores."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    odd = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not odd(i)}


class UnigramCounter:
    """Best score and piece count of a text under ``pieces``, a dict of piece to whole-number score."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if score != int(score):
                raise ValueError("whole-number scores are needed: those of a text's parts are added up")
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"{piece!r} has a space sign inside or a line feed")
            self.pieces.add_word(piece, (len(piece), int(score)))
        self.pieces.make_automaton()
        self.unknown = int(min(pieces.values(), default=0)) - 10
        self.known = Recent(REMEMBER, REMEMBER_CHARS, self.part)

    def part(self, s: str) -> tuple[int, int]:
        """``(score, count)`` of the best path over one part."""
        best: list[float] = [0, *[float("-inf")] * len(s)]
        count = [0] * (len(s) + 1)
        at, single = 0, True  # the position in hand, and whether a one-character piece ends there

        def unknown(p: int) -> None:
            if (value := best[p - 1] + self.unknown) > best[p]:
                best[p], count[p] = value, count[p - 1] + len(s[p - 1].encode("utf-8", "surrogatepass"))

        for last, (size, score) in self.pieces.iter(s):
            end = last + 1
            if end != at:
                if not single:
                    unknown(at)
                for p in range(at + 1, end):
                    unknown(p)
                at, single = end, False
            if (value := best[end - size] + score) > best[end]:
                best[end], count[end] = value, count[end - size] + 1
            single |= size == 1
        if not single:
            unknown(at)
        for p in range(at + 1, len(s) + 1):
            unknown(p)
        return int(best[-1]), count[-1]

    def count(self, text: str | None) -> tuple[int, int]:
        """``(tokens, score)`` of a whole text."""
        tokens = total = 0
        for score, count in map(self.known.__getitem__, _part.findall(SPACE + text.replace(" ", SPACE)) if text else ()):
            total += score
            tokens += count
        return tokens, total


_counters: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """``(doc_id, n_tokens, score)``; ``model_file`` is a path that every executor has."""

    def run(batches):
        if model_file not in _counters:
            _counters[model_file] = UnigramCounter(pieces_of(model_file))
        counter = _counters[model_file]
        for b in batches:
            found = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([float(s) for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, score double")
