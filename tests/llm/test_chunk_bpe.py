"""BPE by chunk reuse against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import chunk_bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def tokens():
    with open(FILE, encoding="utf-8") as file:
        return chunk_bpe.Codec(file.read(), PATTERN)


def of_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def prose(seed, words):
    pick = random.Random(seed)
    pool = ["".join(pick.choice("abcdefghijklmnop éüß") for _ in range(pick.randint(1, 12))) for _ in range(400)]
    ends = [" ", " ", " ", " ", ", ", ".\n", "  ", "\n\n", " 12,345 ", "'s "]
    return "".join(pick.choice(pool) + pick.choice(ends) for _ in range(words))


def texts():
    shared, other = prose(1, 900), prose(2, 500)
    return [
        prose(3, 300) + shared + prose(4, 200),
        prose(5, 100) + shared + other,
        shared[700:] + prose(6, 50),
        "x" + shared,
        shared,
        shared,
        "<|endoftext|>" + shared + "<|endoftext|> and <|endoftext" + other,
        shared + "   <|endoftext|>" + other,
        "日本語の長い文字列" * 900,
        prose(7, 40) + "日本語の長い文字列" * 900,
        "a" * 9000 + shared + "a" * 9000,
        " " * 3000 + shared + "\t\n\x0b\x1c\x85  " * 400,
        "́é 😀🏽 ﻿" * 700,
        "",
        None,
        " ",
        "short",
    ]


def test_same_ids_and_text_as_the_library(spark, library):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts())] + [(None, "no id", "clash", 0), (4, texts()[4], "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, key long").repartition(5)
    got = chunk_bpe.encode(docs, FILE, PATTERN).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, of_library(library, t or ""))
    for row in got:
        assert (bytes(row.ids), row.decoded) == want[row.id], row.id
    digests = chunk_bpe.encode(docs, FILE, PATTERN, digests=True).collect()
    assert sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (str(i), len(want[i][0]) // 4, hashlib.sha256(want[i][0]).hexdigest(), hashlib.sha256(want[i][1].encode()).hexdigest())
        for i, *_ in rows
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunk_bpe.encode(docs, FILE, PATTERN).collect() == []


def test_shared_chunks_are_found_behind_insertions():
    shared = prose(1, 900).encode()
    chunks = [
        {data[a:b] for a, b in zip(at, at[1:])}
        for data in (b"one" + shared, prose(9, 30).encode() + shared)
        for at in [chunk_bpe.cuts(data)]
    ]
    assert sum(map(len, chunks[0] & chunks[1])) > len(shared) * 0.6


def test_cuts_cover_the_text_between_characters():
    for text in texts():
        data = (text or "").encode()
        at = chunk_bpe.cuts(data)
        assert at[0] == 0 and at[-1] == len(data) and at == sorted(at)
        assert all(b - a <= chunk_bpe.LONGEST + chunk_bpe.SHORTEST for a, b in zip(at, at[1:]))
        assert "".join(data[a:b].decode() for a, b in zip(at, at[1:])) == (text or "")


def test_wrong_ends_of_a_chunk_are_encoded_anew(tokens):
    """Ids that do not hold at a chunk's ends are not used there, nor a chunk without any agreement."""
    chunk = " the first words and the last wor"
    ids = tokens.encode(chunk)
    first, last, inner = chunk_bpe.agreement(tokens, chunk, ids)
    assert (chunk[:first], chunk[last:]) == (" the", " wor") and np.array_equal(inner, ids[1:-1])
    wrong = ids.copy()
    wrong[0] += 1
    assert chunk_bpe.agreement(tokens, chunk, wrong) is None
    text = "say" + chunk + "ds"
    known = [(3, 3 + len(chunk), i.tobytes()) for i in (ids, wrong)]
    for use in known:
        assert np.array_equal(chunk_bpe.stitched(tokens, text, [use]), tokens.encode(text))


def test_merging_by_rank_is_the_library(library, tokens):
    """Every token merges to itself alone, and every character is of the same class in both libraries."""
    of = {b: c for c, b in chunk_bpe.byte_of_character().items()}
    special = {library.token_to_id("<|endoftext|>")}
    for i, token in tokens.table.items():
        if i not in special:
            assert [x.id for x in library.model.tokenize("".join(of[b] for b in token))] == [i]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 50_000):
        sample = [f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)}  {chr(c)} x" for c in points[low : low + 50_000]]
        for text, encoded in zip(sample, library.encode_batch_fast(sample, add_special_tokens=False)):
            assert tokens.encode(text).tolist() == encoded.ids


def test_other_tokenizer_files_raise():
    with pytest.raises(ValueError):
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
            chunk_bpe.ranks_of(file.read())


def test_hot_chunk_over_many_partitions(spark, library):
    """A third of all texts shares a passage; another third is one text."""
    shared, same = prose(1, 300), prose(2, 300)
    rows = [(i, [f"{i} {shared} {i}", same, f"{i} alone"][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.id: bytes(r.ids) for r in chunk_bpe.encode(docs, FILE, PATTERN).where(F.length("decoded") > 0).collect()}
    assert got == {i: of_library(library, t)[0] for i, t in rows}
