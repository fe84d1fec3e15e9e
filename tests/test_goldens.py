"""A corpus of ten passages with results worked out beforehand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylight.functions.scoring import FALLBACK
from quarrylight.operators import index, rank, snippets
from quarrylight.plans.build import build_index
from tests.conftest import rows

# The passages, by id from 0.
PASSAGES = [
    "The quick brown fox jumps over the lazy dog. This is a test document about animals.",
    "Computer science is the study of computational systems and programming languages.",
    "Machine learning and artificial intelligence are transforming technology.",
    "The university offers programs in engineering, medicine, and business administration.",
    "Cats and dogs are popular pets around the world. Many families have both.",
    "Research shows that exercise and healthy eating improve quality of life.",
    "The internet has revolutionized communication and information sharing.",
    "Climate change is one of the most pressing challenges of our time.",
    "Education plays a crucial role in personal development and career success.",
    "Technology continues to evolve rapidly, changing how we work and live.",
]
# Query, mode, profile, and (document, score) from the best down.
RANKED = [
    ("the of", rank.OR, "fallback", [(7, 47.4386), (1, 39.8506), (0, 26.9717), (5, 20.2348), (3, 19.6158), (4, 19.6158), (6, 19.6158)]),
    ("the of", rank.OR, "truelen", [(7, 2.0487), (1, 1.6774), (5, 1.1494), (0, 0.6435), (6, 0.594), (3, 0.5483), (4, 0.4917)]),
    ("the of", rank.AND, "fallback", [(7, 47.4386), (1, 39.8506)]),
    ("the of", rank.AND, "truelen", [(7, 2.0487), (1, 1.6774)]),
    ("and", rank.OR, "fallback", [(d, 19.3475) for d in (1, 2, 3, 4, 5, 6, 8, 9)]),
    ("the the", rank.OR, "fallback", [(0, 53.9433), *((d, 39.2315) for d in (1, 3, 4, 6, 7))]),
    ("the zzz", rank.AND, "truelen", []),
    ("the zzz", rank.OR, "fallback", [(0, 26.9717), *((d, 19.6158) for d in (1, 3, 4, 6, 7))]),
    ("The", rank.OR, "truelen", []),
]
# Document, query, window, snippets per document, and what they are.
SNIPPETS = [
    (0, "dog test", 50, 1, ["The quick brown fox jumps over the lazy <b>dog</b>. This is a <b>test</b> document about animals."]),
    (0, "test the", 4, 2, ["<b>The</b> quick brown fox jumps …", "… brown fox jumps over <b>the</b> lazy dog. This is  …"]),
    (4, "dogs pets", 4, 2, ["Cats and <b>dogs</b> are popular <b>pets</b> arou …"]),
    (5, "zzz", 50, 2, [PASSAGES[5]]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(PASSAGES)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    return build_index(spark, docs, str(tmp_path_factory.mktemp("ten")))


def test_counts(docs, stored):
    lengths = dict(rows(index.document_lengths(docs)))
    assert [lengths[d] for d in range(10)] == [16, 11, 8, 10, 13, 11, 8, 12, 11, 11]
    assert stored.postings.count() == 109 and stored.lexicon.count() == 89
    offsets = index.passage_offsets(docs).orderBy("doc_id").collect()
    assert [r["byte_start"] for r in offsets] + [offsets[-1]["byte_end"]] == [0, 83, 164, 237, 322, 395, 467, 537, 603, 677, 747]
    first = [tuple(r) for r in stored.lexicon.orderBy("term").limit(4).collect()]
    assert first == [("a", 0, 2, 0, 1, 2), ("about", 2, 3, 1, 1, 1), ("administration", 3, 4, 2, 1, 1), ("and", 4, 12, 3, 1, 8)]
    assert dict(rows(index.top_terms(stored.postings, 4))) == {"and": 8, "the": 6, "is": 3, "of": 3}


@pytest.mark.parametrize(("query", "mode", "profile", "want"), RANKED)
def test_ranked(stored, query, mode, profile, want):
    stats = FALLBACK if profile == "fallback" else stored.stats
    found = rank.rank(stored.postings, stored.lexicon, query.split(), stats, mode).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == want


@pytest.mark.parametrize(("doc", "query", "windowsz", "per", "want"), SNIPPETS)
def test_snippets(docs, doc, query, windowsz, per, want):
    words = snippets.query_words(query)
    found = snippets.snippets(docs.where(F.col("doc_id") == doc), words, windowsz, per).orderBy("pos").collect()
    assert [r["snippet"] for r in found] == want
