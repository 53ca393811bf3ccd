"""Token counts of a unigram tokenizer, without building tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at a place; dynamic programming carries
the best score up to it and the number of pieces on that path. Ties go as in the tokenizer: a path
replaces another only if it is strictly better, and paths are tried from the earliest start of their
last piece on, so of equal ones the longest last piece stays. A character that no piece covers costs
the unknown score (the lowest score less 10) and counts as its UTF-8 bytes (byte fallback), or, without
that, as one token for a whole run.

A blank (space) is written as MARK, and a text starts with one. If no piece has a MARK behind another
character and all scores are whole numbers, whose sums are exact, the best path of a text is that of its
parts between blanks; a task then looks up parts that it has met. Otherwise whole texts are searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _arrow_type
from .common import released, whole_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
PARTS = regex.compile(r" +[^ ]*|[^ ]+")
# Parts that a task remembers, and the longest of them; when full, it starts anew.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 48


class Counter:
    """Counts pieces of texts for a vocabulary of (piece, score)."""

    def __init__(self, pieces: Iterable[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        lowest, self.divisible = 0.0, True
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), float(score)))
            lowest = min(lowest, score)
            inner = MARK in piece.lstrip(MARK)
            self.divisible = self.divisible and not inner and float(score).is_integer() and abs(score) < 1 << 32
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.known: dict[str, int] = {}
        if not byte_fallback:  # a run of unknown characters may go on behind a blank
            self.divisible = False

    def search(self, text: str) -> int:
        """Pieces on the best path of a text in which blanks are marked already."""
        size = len(text)
        best, count, unknown_last = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        matches = self.automaton.iter(text)
        end_of_match, value = next(matches, (size, None))
        for end in range(size):
            top, pieces, single, chosen_unknown = None, 0, False, False
            # At one end the automaton gives the longest piece first.
            while end_of_match == end:
                length, score = value
                start = end + 1 - length
                total = score + best[start]
                if top is None or total > top:
                    top, pieces = total, count[start] + 1
                single = single or length == 1
                end_of_match, value = next(matches, (size, None))
            if not single:
                total = self.unknown + best[end]
                if top is None or total > top:
                    top, chosen_unknown = total, True
                    if self.byte_fallback:
                        pieces = count[end] + len(text[end].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[end] + (not unknown_last[end])
            best[end + 1], count[end + 1], unknown_last[end + 1] = top, pieces, chosen_unknown
        return count[size]

    def count(self, text: str) -> int:
        """Tokens of a whole text; the empty text has none."""
        if not text:
            return 0
        if not self.divisible:
            return self.search(MARK + text.replace(" ", MARK))
        known, total = self.known, 0
        for part in PARTS.findall(" " + text.replace(MARK, " ")):
            found = known.get(part)
            if found is None:
                found = self.search(part.replace(" ", MARK))
                if len(part) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = found
            total += found
        return total


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file and their scores; control and byte pieces are none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = (model.is_control, model.is_byte, model.is_unknown, model.is_unused)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not any(kind(i) for kind in special)
    ]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens of every row, over the whole text.

    The vocabulary (its size is that of the file) is read once and sent to the tasks. Null texts are
    empty and have 0 tokens; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_of(model_path))
    id_type, arrow_id = docs.schema[id_col].dataType.simpleString(), _arrow_type(docs, id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow_id), pa.array(counts, pa.int64())], names=[id_col, "n_tokens"]
            )

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text_of"))
    return rows.mapInArrow(released(run), f"`{id_col}` {id_type}, n_tokens long")
