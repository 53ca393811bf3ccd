"""BPE by content-defined chunk reuse: chunks that several texts share are encoded once.

A gear hash rolls over the bytes of a text; where its upper bits are 0 the text is cut, so texts with a
common passage cut it at the same places and share the chunks in between. A chunk that several different
texts have is encoded once, where its first holder is. Its ids then go to the other texts that have it,
and there each end of the chunk is repaired: the chunk knows nothing of what stands beside it, so its
first and last ids can be wrong. A window that begins at a pre-token boundary inside the chunk before and
ends at one inside the chunk behind is encoded anew, and the chunk's own ids are used only from the place
on where both agree; while they do not, the window grows by one more boundary.

The boundaries are places between a letter or digit and a following space or line break. No pre-token
spans one (blanks stand at the beginning of a pre-token or are a run of their own), and no special token
contains one, so ids on both sides depend on nothing beyond. Chunks without such places are encoded with
their neighbours.

Merges are those of the tokenizer file. They run in tiktoken: every token of the file merges to itself
alone (``ranks_of`` checks that the ids stand in merge order, the tests check the rest), and then merging
the pair with the lowest id is the same as merging the pair that stands first in the list of merges.

Whole texts move once, by the digest of the text and without copies; chunks move as digests of 16 bytes,
and the places of shared chunks are written to the checkpoint folder.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import cut_lineage
from .bpe import _batches, _rows
from .common import released, whole_text

# One byte in 2 ** CUT_BITS may be cut; a chunk has at least SHORTEST bytes and about LONGEST at most.
CUT_BITS, SHORTEST, LONGEST = 10, 256, 8192
# The hash has 16 bits, so it forgets a byte after 16 steps.
WINDOW = 16
GEAR = np.random.default_rng(11).integers(0, 1 << WINDOW, 256, np.uint16)
BOUNDARY = re.compile(r"(?<=[^\W_])(?=[ \n])")
# Boundaries of a chunk that are tried on either side before it is encoded anew.
TRIALS = 4


def cuts(data: bytes) -> list[int]:
    """Places at which UTF-8 bytes are cut, from 0 to the length; none lies inside a character."""
    size = len(data)
    if size <= SHORTEST:
        return [0, size]
    found = np.frombuffer(data, np.uint8)
    gears = GEAR[found]
    hashed = np.zeros(size, np.uint16)
    for k in range(WINDOW):
        hashed[k:] += gears[: size - k] << np.uint16(k)
    may = (hashed >> np.uint16(WINDOW - CUT_BITS)) == 0
    may[: WINDOW - 1] = False
    may[:-1] &= (found[1:] & 0xC0) != 0x80
    at = [0]
    for place in [*(np.flatnonzero(may) + 1).tolist(), size]:
        while place - at[-1] > LONGEST:
            forced = at[-1] + LONGEST
            while data[forced] & 0xC0 == 0x80:
                forced -= 1
            at.append(forced)
        if place - at[-1] >= SHORTEST and place < size:
            at.append(place)
    at.append(size)
    return at


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of a byte-level BPE tokenizer file by their bytes, and its special tokens.

    Raises unless its merges can be run by rank: byte-level, no normaliser, ids in the order of merges.
    """
    file = json.loads(vocabulary)
    model = file["model"]
    kind = (file["pre_tokenizer"] or {}).get("type"), (file["decoder"] or {}).get("type"), file["normalizer"]
    if kind != ("ByteLevel", "ByteLevel", None) or file["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("the tokenizer file is not a plain byte-level BPE")
    of = byte_of_character()
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items()}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError("the ids of the tokenizer file do not stand in the order of its merges")
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(BOUNDARY.search(t) for t in special):
        raise ValueError("a special token contains a boundary")
    return ranks, special


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable characters of Latin-1 are
    themselves, the other bytes follow in order from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Codec:
    """Encodes as the tokenizers library does without adding special tokens (their strings in a text are
    special tokens, unless ``plain``), and decodes by joining bytes."""

    def __init__(self, vocabulary: str, pattern: str, plain: bool = False):
        ranks, special = ranks_of(vocabulary)
        known = {} if plain else special
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=known)
        self.allowed = set(known)
        self.table = {i: token for token, i in ranks.items()} | {i: t.encode() for t, i in special.items()}

    def encode(self, text: str) -> np.ndarray:
        return self.own.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def agreement(tokens: Codec, chunk: str, ids: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(first, last, ids between): the outermost boundaries of a chunk between which its ids hold in every
    text, because the ends, encoded alone, give just the ids that the chunk has there."""
    places = [m.start() for m in BOUNDARY.finditer(chunk)]
    first = last = None
    for place in places[:TRIALS]:
        head = tokens.encode(chunk[:place])
        if np.array_equal(ids[: len(head)], head):
            first, before = place, len(head)
            break
    for place in places[: -TRIALS - 1 : -1]:
        tail = tokens.encode(chunk[place:])
        if np.array_equal(ids[len(ids) - len(tail) :], tail):
            last, behind = place, len(ids) - len(tail)
            break
    if first is None or last is None or first >= last:
        return None
    return first, last, ids[before:behind]


def stitched(tokens: Codec, text: str, known: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of a text: chunks (start, end in bytes, ids) as given, and what lies between them and around
    their joins encoded here."""
    if not known:
        return tokens.encode(text)
    data = text.encode()
    parts, at = [], 0
    for start, end, ids in sorted(known):
        chunk = data[start:end].decode()
        held = agreement(tokens, chunk, np.frombuffer(ids, "<u4"))
        if held is None:
            continue
        first, last, inner = held
        first, last = start + len(chunk[:first].encode()), start + len(chunk[:last].encode())
        parts += [tokens.encode(data[at:first].decode()), inner]
        at = last
    parts.append(tokens.encode(data[at:].decode()))
    return np.concatenate(parts)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """key, text of every different text; copies are dropped map-side before texts move."""
    return rows.groupBy("key").agg(F.first("text").alias("text"))


def chunk_places(rows: DataFrame) -> DataFrame:
    """digest, key, start, end of every chunk of every row's text; a task skips the copies of a text."""
    schema = pa.schema([("digest", pa.binary()), ("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        def found():
            seen = set()
            for key, text in _rows(batches):
                if key in seen:
                    continue
                seen.add(key)
                data = text.encode()
                at = cuts(data)
                for a, b in zip(at, at[1:]):
                    if b > a:
                        yield digest(data[a:b]), key, a, b

        yield from _batches(found(), schema)

    return rows.select("key", "text").mapInArrow(released(run), "digest binary, key binary, start long, end long")


def shared_places(rows: DataFrame) -> DataFrame:
    """digest, key, start, end, holder of the chunks that different texts have; holder is the smallest key."""
    places = chunk_places(rows)
    shared = places.groupBy("digest").agg(F.min("key").alias("holder"), F.max("key").alias("other"))
    shared = shared.where("holder <> other").select(F.col("digest").alias("shared"), "holder")
    uses = places.join(shared, F.col("digest") == F.col("shared")).select("digest", "key", "start", "end", "holder")
    return uses.dropDuplicates(["key", "start"])


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
) -> DataFrame:
    """Encode every whole text: id, ids (binary, little-endian unsigned 32-bit), decoded (string), one row
    per row; with ``digests`` id, n_tokens, ids_sha256, decoded_sha256 instead, so that ids stay in their tasks.

    ``vocabulary`` is the path of a tokenizer file, read once and sent to the tasks (about two megabytes);
    ``pattern`` divides texts before merging. Special tokens are not added, their strings in a text are
    special tokens. Null texts are empty and have no ids; equal texts are encoded once and repeated rows
    stay; a null id stays null; texts of any length stay in one task each; other columns are not read; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    # Never null; said here, so that every use of the texts has the same plan and shares one shuffle.
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32))).where("key is not null")
    texts = distinct_texts(rows)

    # Narrow rows; written, so that the next job reads which chunks are shared and cuts nothing again.
    uses = cut_lineage(shared_places(rows))

    held = uses.where("key = holder").groupBy(F.col("key").alias("of")).agg(
        F.collect_list(F.struct("digest", "start", "end")).alias("chunks")
    )

    def encode_chunks(batches):
        tokens = codec(content.value, pattern)
        schema = pa.schema([("digest", pa.binary()), ("ids", pa.binary())])

        def made():
            done = set()
            for text, chunks in _rows(batches):
                data = text.encode()
                for chunk in chunks:
                    if chunk["digest"] not in done:
                        done.add(chunk["digest"])
                        yield chunk["digest"], tokens.encode(data[chunk["start"] : chunk["end"]].decode()).tobytes()
                done.clear()

        yield from _batches(made(), schema)

    encoded = texts.join(held, F.col("key") == F.col("of")).select("text", "chunks")
    encoded = encoded.mapInArrow(released(encode_chunks), "digest binary, ids binary")
    known = (
        uses.select(F.col("digest").alias("used"), "key", "start", "end")
        .join(encoded, F.col("used") == F.col("digest"))
        .groupBy(F.col("key").alias("of"))
        .agg(F.collect_list(F.struct("start", "end", "ids")).alias("known"))
    )

    def stitch(batches):
        tokens = codec(content.value, pattern)
        outputs = (
            [("n_tokens", pa.int64()), ("ids_sha256", pa.binary()), ("decoded_sha256", pa.binary())]
            if digests
            else [("ids", pa.binary()), ("decoded", pa.string())]
        )

        def made():
            for key, text, chunks in _rows(batches):
                ids = stitched(tokens, text, [(c["start"], c["end"], c["ids"]) for c in chunks or ()])
                decoded = tokens.decode(ids)
                if digests:
                    yield key, len(ids), hashlib.sha256(ids.tobytes()).digest(), hashlib.sha256(decoded.encode()).digest()
                else:
                    yield key, ids.tobytes(), decoded

        yield from _batches(made(), pa.schema([("key", pa.binary()), *outputs]))

    outputs = "n_tokens long, ids_sha256 binary, decoded_sha256 binary" if digests else "ids binary, decoded string"
    results = texts.join(known, F.col("key") == F.col("of"), "left").select("key", "text", "known")
    results = results.mapInArrow(released(stitch), f"key binary, {outputs}")
    results = results.withColumnRenamed("key", "of")
    found = rows.select("id", "key").join(results, F.col("key") == F.col("of")).drop("key", "of")
    if digests:
        found = found.withColumns({c: F.lower(F.hex(c)) for c in ("ids_sha256", "decoded_sha256")})
    return found
