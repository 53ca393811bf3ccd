import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models

from pulsegrid.llm import bpe, toxicity, unigram

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def scraps(seed, size):
    rng = random.Random(seed)
    kinds = ["word ", "It's ", "they'll ", "  ", "\n\n", "\t", "1234", "漢字", "é", "😀", "...", " don't", "\x1c", " ", "ſ", "٣"]
    return "".join(rng.choice(kinds) for _ in range(size))


TEXTS = [
    (1, "Hello, world"),
    (2, None),
    (3, ""),
    (4, scraps(4, 900)),
    (5, scraps(5, 5000)),
    (6, "a" * 3000),  # one pre-token longer than chunk and overlap
    (7, "word " * 50 + " " * 900 + "it's" + "\n" * 500 + scraps(7, 300)),
    (5, scraps(5, 5000)),  # a repeated row
    (None, scraps(9, 1500)),
    (10, "<|endoftext|> is text"),
]


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK, bpe.OVERLAP), (400, 120), (64, 48)])
def test_chunks_encode_as_the_library(spark, library, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], "doc_id long, text string, ids string, key string")
    got = bpe.encode(docs.repartition(3), RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in TEXTS]
    assert sorted([(r.id, bytes(r.ids)) for r in got], key=repr) == sorted(want, key=repr)


def test_round_trip_and_digests(spark, library):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = bpe.encoded_digests(docs, RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.where("doc_id is not null").collect():
        text = dict(TEXTS)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoded_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.pieces_of(PIECES)


def test_counts_as_the_library(vocabulary):
    pieces = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + vocabulary
    reference = Tokenizer(models.Unigram(pieces, 0, True))
    counter = unigram.Counter(vocabulary)
    assert counter.divisible
    rng = random.Random(3)
    alphabet = "ab théñ▁  \n\t漢😀xyzzz"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["the quick brown fox " * 40, "x" * 5000, " " * 300, "日本語のテキスト"]
    for text in texts:
        marked = "▁" + text.replace(" ", "▁")
        assert counter.count(text) == len(reference.encode(marked, add_special_tokens=False).ids), text
        assert counter.search(marked) == counter.count(text)
    assert counter.count("") == 0


def test_counts_with_fractions_and_without_byte_fallback():
    pieces = [("▁", -1.5), ("a", -1.1), ("b", -1.2), ("ab", -2.3), ("ba", -2.3), ("▁a", -2.6), ("aba", -3.4)]
    reference = Tokenizer(models.Unigram([("<unk>", -9.0), *pieces], 0, False))
    counter = unigram.Counter([("<unk>", -9.0), *pieces], byte_fallback=False)
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choice("ab cx") for _ in range(rng.randint(1, 15)))
        marked = "▁" + text.replace(" ", "▁")
        assert counter.count(text) == len(reference.encode(marked, add_special_tokens=False).ids), text


def test_token_counts_of_rows(spark, vocabulary):
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "n", 7) for r in rows], "doc_id long, text string, n_tokens string, text_of long")
    counter = unigram.Counter(vocabulary)
    want = sorted([(i, counter.count(t or "")) for i, t in rows], key=repr)
    got = unigram.token_counts(docs, PIECES)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert unigram.token_counts(docs.limit(0), PIECES).count() == 0


def labelled(n):
    rng = random.Random(11)
    benign = ["garden", "river", "window", "paper", "green", "walks", "under", "light", "seven", "stone"]
    rows = []
    for i in range(n):
        words = [rng.choice(benign) + rng.choice(["", "s", "ed", "er"]) for _ in range(rng.randint(5, 400))]
        toxic = int(rng.random() < 0.25)
        for _ in range(toxic * max(1, len(words) // 100)):
            words[rng.randrange(len(words))] = "zorpgh" + rng.choice(["ly", "ish", "er", "ous", "ing"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t, _ in rows], "doc_id long, text string, id long, score long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert toxicity.keep_clean(docs, labels).count() == sum(1 - r.predicted for r in got)


def test_unseen_forms_share_vectors():
    rows = labelled(400)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    assert model.score("a garden by the zorpghling river") > 0.5  # a form that is not in the sample
    assert model.score("A ZORPGHER") > 0.5
    assert model.score("a garden by the sparkling river") < 0.5
    assert model.score("") < 0.5
    insult, calm = "you zorpghish ", "green garden walks under seven windows "
    assert model.score(calm * 20_000 + insult + calm * 20_000) > 0.5  # one passage decides, in a very long text
    assert model.score(calm * 20_000) < 0.5


def test_held_out_labels_are_never_learnt(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")

    def scores(flip):
        labels = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        return sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, table).collect())

    assert scores(False) == scores(True)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "words"), (2, ""), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and not any(r.predicted for r in got)
    odd = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, odd).count() == 4
    assert toxicity.toxicity(docs.limit(0), odd).count() == 0


def test_the_fit_reads_whole_texts_of_every_drawn_document(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i} " + "clean " * 5000 + "insult") for i in ids]
    rows += [rows[0]] * 200  # repeated rows leave no other document out
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, given: seen.append((texts, given)))
    toxicity.train(docs, labels)
    assert seen[0] == ([t for _, t in rows[: len(ids)]], [i % 2 for i in ids])
    toxicity.train(docs, labels, sample_docs=len(ids), sample_chars=100_000)
    assert len(seen[1][0]) == 4 and set(seen[1][0]) <= set(seen[0][0])
