"""Queries on terms: counts, vocabulary, tf-idf and rankings over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, terms
from ..settings import use_all_cores
from . import binding as b
from .registry import query

# Parameter of these queries: English function words left out as stop words.
STOP_WORDS = (
    "an and are as at be by for from had has have he her his in is it its not of on or she that the "
    "their them they this to was we were which will with you"
).split()
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

_COUNTS_SQL = rf"""tokens AS (SELECT doc_id AS doc, lang,
  unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
counts AS (SELECT doc, any_value(lang) AS lang, term, count(*) AS n FROM tokens
  WHERE term NOT IN ({_STOP_SQL}) GROUP BY doc, term)"""
_VOCABULARY_SQL = f"""{_COUNTS_SQL},
total AS (SELECT count(*) AS documents FROM documents),
kept AS (SELECT term, sum(n)::BIGINT AS n, count(*) AS df FROM counts GROUP BY term
  HAVING df >= 2 AND df <= 0.95 * (SELECT documents FROM total) ORDER BY n DESC, term LIMIT 1000),
vocabulary AS (SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, term, n, df FROM kept)"""
_TFIDF_SQL = f"""{_VOCABULARY_SQL},
raw AS (SELECT doc, lang, idx, term, counts.n * (ln((1 + documents) / (1 + df)) + 1) AS w
  FROM counts JOIN vocabulary USING (term), total),
tfidf AS (SELECT doc, lang, idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM raw)"""


def _docs(spark, sf_dir, *more):
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", *more)
    return use_all_cores(docs)  # a single small file is one task otherwise


@query("term_counts", f"WITH {_COUNTS_SQL} SELECT doc, term, n FROM counts")
def _(spark, sf_dir):
    return terms.term_counts(_docs(spark, sf_dir), STOP_WORDS)


@query("vocabulary", f"WITH {_VOCABULARY_SQL} SELECT idx, term, n, df FROM vocabulary")
def _(spark, sf_dir):
    return terms.vocabulary(_docs(spark, sf_dir), STOP_WORDS)


@query(
    "count_vectors",
    f"WITH {_VOCABULARY_SQL} SELECT doc, idx, term, counts.n::DOUBLE AS n FROM counts JOIN vocabulary USING (term)",
)
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    vocab = terms.fit_vocabulary(docs, STOP_WORDS)
    return terms.vector_terms(terms.count_vectors(docs, vocab, STOP_WORDS), vocab, "n")


@query("tfidf", f"WITH {_TFIDF_SQL} SELECT doc, idx, term, round(weight, 6) AS weight FROM tfidf")
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    vocab = terms.fit_vocabulary(docs, STOP_WORDS)
    weights = terms.vector_terms(terms.tfidf_vectors(docs, vocab, STOP_WORDS), vocab)
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "top_terms",
    f"""WITH {_VOCABULARY_SQL}, weights AS (SELECT lang AS topic, term, idx, sum(counts.n)::BIGINT AS weight
      FROM counts JOIN vocabulary USING (term) GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT topic, term, idx, weight, row_number() OVER (PARTITION BY topic
      ORDER BY weight DESC, idx DESC)::INTEGER AS rank FROM weights) WHERE rank <= 10""",
)
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir, "lang")
    counts = terms.term_counts(docs.withColumn("doc", F.struct("doc", "lang")), STOP_WORDS)
    vocab = terms.vocabulary(docs, STOP_WORDS).select("term", "idx")
    weights = (
        counts.join(vocab, "term")
        .groupBy(F.col("doc.lang").alias("topic"), "term", "idx")
        .agg(F.sum("n").alias("weight"))
    )
    return ranking.top_terms(weights, 10)


@query(
    "corpus",
    "SELECT p_partkey AS item, p_name || ' ' || p_type AS text FROM part",
)
def _(spark, sf_dir):
    return terms.corpus(b.items(spark, sf_dir))
