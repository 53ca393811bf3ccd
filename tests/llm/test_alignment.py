"""Token alignment against byte offsets, and the sparse products against dense ones."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pulsegrid.llm import alignment
from pulsegrid.llm.chunk_bpe import byte_of_character

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """Ids and bytes of both, by the libraries on the whole text; empty if the bytes differ."""
    a, b = libraries
    if not text:
        return [], [], [], []
    of = byte_of_character()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(of[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = []
    for piece in map(b.id_to_piece, b_ids):
        byte = piece.startswith("<0x") and piece.endswith(">") and len(piece) == 6
        b_bytes.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode())
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], []
    return a_ids, b_ids, a_bytes, b_bytes


def ends(found):
    return np.cumsum([len(x) for x in found]).tolist()


def brute(libraries, texts):
    """One row per text, and each text's links, from byte offsets."""
    made, total = [], Counter()
    for text in texts:
        a_ids, b_ids, a_bytes, b_bytes = tokens(libraries, text)
        at_b = {e: j for j, e in enumerate(ends(b_bytes))}
        links = [(i, at_b[e]) for i, e in enumerate(ends(a_bytes)) if e in at_b]
        groups, a, b = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a_ids[a : i + 1])) + "|" + ",".join(map(str, b_ids[b : j + 1])))
            a, b = i + 1, j + 1
        pairs = [(a_ids[i], b_ids[j]) for i, j in links]
        total.update(pairs)
        made.append((len(a_ids), len(b_ids), hashlib.sha256(";".join(groups).encode()).hexdigest() if a_ids else "", pairs))
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (n_a, n_b, len(p), len(p), sum(total[x] == best[x[1]] for x in p), sum(total[x] for x in p), digest)
        for n_a, n_b, digest, p in made
    ]


def texts():
    pick = random.Random(3)
    pool = ["".join(pick.choice("abcdefgeeinrst éüßñ日本") for _ in range(pick.randint(1, 14))) for _ in range(300)]
    ends_ = [" ", " ", " ", " ", ", ", ".\n", "  ", "\n\n", "\n ", " 12,345 ", "'s ", "_ ", "\t ", "\r\n"]
    odd = [
        "",
        None,
        " ",
        "   ",
        "a ",
        "a\n",
        "\n",
        " leading",
        "trailing   ",
        "<|endoftext|> <s> </s> <unk> <0x41>",
        "a literal ▁ in it",
        "日本語の長い文字列" * 500,
        "a" * 20_000,
        " " * 5_000 + "x" + " " * 70,
        "é 😀🏽 ﻿\x00\x01 ﬁ \x85 x",
        "x y　z w",
        "A\tB\tC \r\n D",
    ]
    return odd + ["".join(pick.choice(pool) + pick.choice(ends_) for _ in range(pick.randint(1, 400))) for _ in range(60)]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_same_rows_as_byte_offsets(spark, libraries):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    rows += [(None, "no id and text", "clash", 1), (3, texts()[-1], "again", 1), (3, texts()[-1], "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n_a int").repartition(6)
    got = alignment.alignment_counts(docs, A, PATTERN, B).collect()
    want = [(r[0], *w) for r, w in zip(rows, brute(libraries, [r[1] for r in rows]))]
    assert sorted((str(r.id), *(r[n] for n in NAMES)) for r in got) == sorted((str(w[0]), *w[1:]) for w in want)


def test_every_link_of_the_general_operator(spark, libraries):
    rows = [(i, t) for i, t in enumerate(texts()) if not t or len(t) < 3_000]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, PATTERN, B)
    of = dict(rows)
    assert len(kept := found.collect()) == len(rows)
    for row in kept:
        a_ids, b_ids, a_bytes, b_bytes = tokens(libraries, of[row.id])
        assert (row.a_ids, row.b_ids) == (a_ids, b_ids)
        a_end, b_end = ends(a_bytes), ends(b_bytes)
        overlaps, low = [], 0
        for i, e in enumerate(a_end):
            a_low = e - len(a_bytes[i])
            while low < len(b_end) and b_end[low] <= a_low:
                low += 1
            j = low
            while j < len(b_end) and b_end[j] - len(b_bytes[j]) < e:
                overlaps.append((i, j, min(e, b_end[j]) - max(a_low, b_end[j] - len(b_bytes[j]))))
                j += 1
        assert [tuple(x) for x in row.overlaps] == overlaps
        both = sorted(set(a_end) & set(b_end))
        assert [tuple(x) for x in row.together] == [(a_end.index(e), b_end.index(e)) for e in both]
        assert [tuple(x) for x in row.groups] == [(a_end.index(e) + 1, b_end.index(e) + 1) for e in both]
        a, b, grouped = 0, 0, set()
        for x, y in row.groups:
            grouped |= {(i, j) for i in range(a, x) for j in range(b, y)}
            a, b = x, y
        assert {tuple(x) for x in row.grouped} == grouped and len(row.grouped) == len(grouped)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_counts(docs, A, PATTERN, B).collect() == []
    assert alignment.align(docs, A, PATTERN, B).collect() == []


def csr(dense):
    rows, columns = np.nonzero(dense)
    return np.concatenate([[0], np.cumsum((dense != 0).sum(1))]), columns, dense[rows, columns]


def dense(matrix, columns):
    out = np.zeros((len(matrix[0]) - 1, columns), np.int64)
    out[alignment.rows_of(matrix), matrix[1]] = matrix[2]
    return out


@pytest.mark.parametrize("expanded", [1, 7, 1 << 20])
def test_row_products_are_matrix_products(monkeypatch, expanded):
    monkeypatch.setattr(alignment, "EXPANDED", expanded)
    random = np.random.default_rng(5)
    for rows, inner, columns in [(1, 1, 1), (6, 9, 4), (30, 20, 25), (5, 0, 3), (0, 4, 4)]:
        left = random.integers(0, 4, (rows, inner)) * (random.random((rows, inner)) < 0.3)
        right = random.integers(0, 4, (inner, columns)) * (random.random((inner, columns)) < 0.3)
        got = alignment.product(csr(left), csr(right), columns)
        assert np.array_equal(dense(got, columns), left @ right)
        assert np.array_equal(dense(alignment.transposed(csr(left), inner), rows), left.T)


def test_units_are_tokenised_as_in_their_text(libraries):
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        own = alignment.Aligner(a.read(), PATTERN, b.read())
    for _ in range(2):  # learnt, and then remembered
        for low in range(0, len(texts()), 16):
            part = texts()[low : low + 16]
            for text, known in zip(part, own.units(part)):
                a_ids, b_ids, *_ = tokens(libraries, text)
                count = divmod(sum(u[2] for u in known), 1 << 32) if known else (0, 0)
                assert count == (len(a_ids), len(b_ids))
