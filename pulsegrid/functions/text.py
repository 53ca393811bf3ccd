"""Text expressions: words, and their counts within one text, row by row inside the JVM; and the words of many
texts at once as numbers, for tasks that only count them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is two or more letters, digits or underscores, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"
_BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
# ASCII that is in no word becomes a blank; other bytes stay.
_BLANKED = np.array([b if b > 127 or chr(b).isalnum() or b == ord("_") else 32 for b in range(256)], np.uint8)
# Text that a task takes apart at once.
_BYTES_AT_ONCE = 16 << 20


def words(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case words in order, stop words left out; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda word: ~word.isin(list(stop_words)))


def word_counts(found: Column) -> Column:
    """``array<struct<term, n>>`` of an array of words: sort, then measure each run.

    Nothing is shuffled. One-element arrays bind the intermediate results, so that each is
    computed once per text.
    """

    def runs(word: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(word) - 1), lambda i: (i == 0) | (word[i] != word[i - 1])
        )
        counts = F.transform(
            F.array(starts),
            lambda start: F.transform(
                start,
                lambda at, i: F.struct(
                    word[at].alias("term"),
                    (F.when(i + 1 < F.size(start), start[i + 1]).otherwise(F.size(word)) - at)
                    .cast("long")
                    .alias("n"),
                ),
            ),
        )[0]
        return F.when(F.size(word) > 0, counts)

    return F.transform(F.array(F.sort_array(found)), runs)[0]


def lowered(text: Column) -> Column:
    """Lower-case text; null is empty."""
    return F.lower(F.coalesce(text, F.lit("")))


def blanked(low: Column) -> Column:
    """Lower-case text for ``numbered_words``: beyond ASCII, Spark decides what is in a word."""
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(low, _BETWEEN_WORDS, " "))


def text_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some 16 MB of ``text`` each."""
    piece = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // _BYTES_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every word of ``blanked`` texts, the row and the number of its term; and the distinct terms. As ``words``
    finds them, but single characters (and empty terms) are among them."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(_BLANKED[np.frombuffer(data or b"", np.uint8)])
    found = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, data, offset=texts.offset))
    rows = np.repeat(np.arange(len(texts)), found.value_lengths().to_numpy())
    encoded = found.flatten().dictionary_encode()
    return rows, encoded.indices.to_numpy(), encoded.dictionary
