"""Retrieval operators on a small corpus against plain Python."""

from __future__ import annotations

import json
import math
import re
import shutil
import struct
import threading
import urllib.error
import urllib.request
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight import api
from quarrylight.functions import varbyte
from quarrylight.functions.analysis import clean_term, terms, vb_len
from quarrylight.functions.scoring import FALLBACK, K1, Statistics
from quarrylight.operators import index, rank, snippets
from quarrylight.operators.prefix import running_total
from quarrylight.plans.build import build_index, open_index
from quarrylight.plans.search import SearchRequest, hits, search
from quarrylight.sources import collection
from tests.conftest import rows

TEXTS = {
    0: "The harbour of the north sees the first boats.",
    1: "A boat, the boat's sail and state-of-the-art rope.",
    2: "Naïve café owners don't sell rope; the owners of boats do.",
    5: "",
    7: "of of of the the end",
    9: None,
    11: "Harbour " * 400 + "boats\tand\nsails",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    return build_index(spark, docs, str(tmp_path_factory.mktemp("index")))


def tokens_of(text):
    words = (re.sub("[^A-Za-z0-9]", "", w).lower() for w in re.split("[ \t\n\x0b\f\r]+", text or ""))
    return [w for w in words if w]


def bm25(query, every=False, stats=None, k1=K1, b=0.75):
    counts = {d: Counter(tokens_of(t)) for d, t in TEXTS.items()}
    lengths = {d: sum(c.values()) for d, c in counts.items()}
    n, mean = stats or (len(TEXTS), sum(lengths.values()) / len(TEXTS))
    out = {}
    for d, c in counts.items():
        if not any(c[t] for t in query) or every and not all(c[t] for t in query):
            continue
        score = 0.0
        for t in query:
            ft = sum(1 for x in counts.values() if x[t])
            dl = 1 if stats else lengths[d]
            if c[t]:
                score += math.log((n - ft + 0.5) / (ft + 0.5) + 1) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * dl / mean))
        out[d] = score
    return [(i + 1, d, round(s, 4)) for i, (d, s) in enumerate(sorted(out.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10])]


def got(df):
    return [tuple(r) for r in df.orderBy("rank").collect()]


def test_terms(spark):
    df = spark.createDataFrame([("Don't  state-of-the-art\x0bcafé -- Kelvin",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(terms(F.col("t"))).collect()] == [["dont", "stateoftheart", "caf", "elvin"], [], []]
    assert df.limit(1).select(clean_term(F.lit("A-Z9é"))).first()[0] == "az9"


def test_postings_and_lengths(docs):
    want = [(t, d, n) for d, x in TEXTS.items() for t, n in Counter(tokens_of(x)).items()]
    assert rows(index.postings(docs)) == sorted(want, key=repr)
    assert dict(rows(index.document_lengths(docs))) == {d: len(tokens_of(t)) for d, t in TEXTS.items()}
    assert tuple(index.corpus_stats(docs.limit(0)).first()) == (0, 0, 0.0)


@pytest.mark.parametrize("query", [["the"], ["the", "of"], ["the", "the", "boats"], ["harbour", "boats", "rope"], ["zzz"], ["the", "zzz"], []])
@pytest.mark.parametrize("mode", [rank.OR, rank.AND])
def test_bm25(stored, query, mode):
    assert got(rank.rank(stored.postings, stored.lexicon, query, stored.stats, mode)) == (bm25(query, mode == rank.AND) if query else [])
    assert got(rank.rank(stored.postings, stored.lexicon, query, FALLBACK, mode)) == (bm25(query, mode == rank.AND, (2**31, 1.0)) if query else [])


def test_bm25_parameters_and_ties(stored):
    assert got(rank.rank(stored.postings, stored.lexicon, ["the", "of"], stored.stats, k1=0.5, b=0.1)) == bm25(["the", "of"], k1=0.5, b=0.1)
    assert got(rank.rank(stored.postings, stored.lexicon, ["the"], stored.stats, k=0)) == []
    assert [r[1] for r in got(rank.rank(stored.postings, stored.lexicon, ["rope"], FALLBACK))] == [1, 2]
    assert got(rank.rank(stored.postings, stored.lexicon, ["The"], stored.stats)) == []
    assert struct.unpack("f", struct.pack("f", 1.2))[0] == K1


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_batch_equals_single(spark, stored, monkeypatch, most):
    monkeypatch.setattr(rank, "MOST_ASKED", most)
    asked = [(1, ["the", "of"], 10, False), (2, ["the", "of"], 2, True), (3, ["the", "the"], 10, None), (4, ["zzz"], 5, False), (5, [], 5, False), (6, None, 5, True), (7, ["the"], 0, False), (8, ["the", "zzz"], 5, True), (9, ["the"], None, False)]
    queries = spark.createDataFrame(asked, "query_id bigint, terms array<string>, k int, conjunctive boolean")
    found = rank.rank_batch(stored.postings, stored.lexicon, queries, stored.stats).collect()
    for q, words, k, every in asked:
        want = bm25(words, bool(every))[:k] if words and k else []
        assert sorted((r["rank"], r["doc_id"], r["score"]) for r in found if r["query_id"] == q) == want


def test_matching_and_term_stats(stored):
    assert rows(rank.matching(stored.postings, ["the", "of"], rank.AND)) == [(0,), (2,), (7,)]
    assert rows(rank.matching(stored.postings, ["rope", "end"])) == [(1,), (2,), (7,)]
    assert rows(rank.query_term_stats(stored.lexicon, ["the", "zzz", "the"])) == [("the", 4), ("zzz", 0)]


def in_parts(post, n):
    return post.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id")


def test_selfcheck_finds_damage(spark, docs, tmp_path):
    index_ = build_index(spark, docs, str(tmp_path / "i"), 2)
    found = lambda blocks, lex=index_.lexicon: {k for k, n in rows(index.selfcheck(blocks, lex)) if n}
    held = index_.blocks
    assert found(held) == set() and index.selfcheck(held, index_.lexicon).count() == 7
    assert rows(index.decoded_blocks(held).select("term", "doc_id", "tf")) == rows(index.postings(docs))
    assert found(held.withColumn("last_doc", F.col("last_doc") + 1)) == {"f_last_ids_match", "e_ids_rise_across_blocks"}
    assert found(held.where("term <> 'the'")) == {"a_every_term_has_blocks", "c_block_numbers_in_range", "g_counts_match_ft"}
    assert found(held.withColumn("docids", F.when(F.col("n") == 2, F.expr("substring(docids, 1, 1)")).otherwise(F.col("docids")))) >= {"b_slots_and_bytes_add_up", "f_last_ids_match", "g_counts_match_ft"}
    assert "d_ids_rise_within_blocks" in found(held.withColumn("docids", F.when(F.col("n") == 2, F.unhex(F.lit("0500"))).otherwise(F.col("docids"))))
    assert found(held, index_.lexicon.withColumn("end_slot", F.col("end_slot") + 1)) == {"b_slots_and_bytes_add_up"}
    held.where("block_id > 0").write.parquet(str(tmp_path / "less"))
    shutil.rmtree(tmp_path / "i" / "blocks")
    (tmp_path / "less").rename(tmp_path / "i" / "blocks")
    with pytest.raises(ValueError, match="blocks"):
        open_index(spark, str(tmp_path / "i"))


@pytest.mark.parametrize(("parts", "block", "stretch"), [(1, 128, 1 << 16), (7, 2, 1 << 16), (9, 3, 2), (40, 128, 1)])
def test_blocks_of_terms_over_many_parts(spark, monkeypatch, parts, block, stretch):
    """A hot term is cut by many parts, some hold nothing else; blocks, offsets and the lexicon are those of one stream."""
    monkeypatch.setattr(index, "STRETCH", stretch)
    data = [("hot", 3 * i, 1 + i % 200) for i in range(700)] + [("a", 7, 1), ("Z", 9, 2), ("z", 1, 300), ("z", 2**40, 1)] + [(f"t{i % 50}", i, 1) for i in range(200)]
    post = spark.createDataFrame(data, "term string, doc_id bigint, tf bigint")
    found = index.ordered_blocks(in_parts(post, parts), block).collect()
    by_term = {}
    for t, d, f in sorted(data):
        by_term.setdefault(t, []).append((d, f))
    want, at, slot, number = [], 0, 0, 0
    for t in sorted(by_term):
        for k in range(0, len(by_term[t]), block):
            some = by_term[t][k : k + block]
            gaps = np.diff([d for d, _ in some], prepend=0)
            ids, freqs = (varbyte.encode(np.array(x))[0].tobytes() for x in (gaps, [f for _, f in some]))
            want.append((t, k // block, len(some), some[0][0], some[-1][0], ids, freqs, number, at, slot))
            at, slot, number = at + len(ids) + len(freqs), slot + len(some), number + 1
    names = ["term", "block_no", "n", "first_doc", "last_doc", "docids", "freqs", "block_id", "byte_offset", "start_slot"]
    assert sorted(tuple(bytes(r[c]) if c in ("docids", "freqs") else r[c] for c in names) for r in found) == sorted(want)
    held = spark.createDataFrame(found)
    assert rows(index.lexicon_of(held)) == rows(index.lexicon(post, block))
    assert rows(index.decoded_blocks(held).select("term", "doc_id", "tf")) == rows(post)


def test_blocks_of_nothing(spark):
    empty = spark.createDataFrame([], "term string, doc_id bigint, tf bigint")
    assert index.ordered_blocks(empty).count() == 0


def test_repeated_documents(spark, tmp_path):
    """Frequencies and lengths of a document given twice add up, and it counts once."""
    twice = spark.createDataFrame([(1, "the boat the"), (1, "the sail of it"), (2, "boat"), (3, None)], "doc_id bigint, text string")
    once = spark.createDataFrame([(1, "the boat the the sail of it"), (2, "boat"), (3, None)], "doc_id bigint, text string")
    a, b = build_index(spark, twice, str(tmp_path / "a")), build_index(spark, once, str(tmp_path / "b"))
    assert rows(a.postings) == rows(b.postings) and a.stats == b.stats and a.stats.n_docs == 3
    assert rows(a.passages) == [(1, "the sail of it"), (2, "boat"), (3, None)]
    assert got(rank.rank(a.postings, a.lexicon, ["the", "boat"], a.stats)) == got(rank.rank(b.postings, b.lexicon, ["the", "boat"], b.stats))


def test_and_skips(stored, monkeypatch):
    """AND with a rare term gives the same hits by ranges of its documents, which reach the scan."""
    assert rank.skip_ranges([5, 1, 9, 100, 101], 2) == [(1, 9), (100, 101)] and rank.skip_ranges([4], 3) == [(4, 4)]
    want = got(rank.rank(stored.postings, stored.lexicon, ["the", "café".encode("ascii", "ignore").decode()], stored.stats, rank.AND))
    monkeypatch.setattr(rank, "SKIP_TIMES", 2)
    df = rank.rank(stored.postings, stored.lexicon, ["the", "caf"], stored.stats, rank.AND)
    assert got(df) == want == bm25(["the", "caf"], True)
    assert "EqualTo(doc_id,2)" in df._jdf.queryExecution().executedPlan().toString()


def test_lexicon_slots(docs):
    found = [tuple(r) for r in index.lexicon(index.postings(docs), 2).orderBy("term").collect()]
    slot = block = 0
    counts = Counter(t for x in TEXTS.values() for t in set(tokens_of(x)))
    assert [r[0] for r in found] == sorted(counts)
    for term, start, end, first, blocks, ft in found:
        assert (start, end, first, blocks, ft) == (slot, slot + counts[term], block, -(-counts[term] // 2), counts[term])
        slot, block = end, block + blocks


def test_running_total(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("v", F.col("id") % 5)
    found = running_total(df, ["id"], before=F.col("v"))
    total = 0
    for r in found.orderBy("id").collect():
        assert r["before"] == total
        total += r["v"]
    assert running_total(df.limit(0), ["id"], before=F.col("v")).count() == 0


@given(st.lists(st.integers(0, 2**62)))
def test_varbyte_round_trip(values):
    data, size = varbyte.encode(np.array(values, dtype=np.int64))
    assert varbyte.decode(data).tolist() == values
    assert size.sum() == len(data)


def test_varbyte_examples(spark):
    data, _ = varbyte.encode(np.array([128, 300, 0, 127]))
    assert data.tolist() == [1, 128, 2, 172, 0, 127]
    values = [0, 127, 128, 2**14 - 1, 2**14, 2**35, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [r[0] for r in df.select(vb_len(F.col("v"))).collect()] == varbyte.lengths(np.array(values)).tolist()


def test_snippets(spark):
    texts = [(0, "Two dogs ran. A dog is a friend of the man who feeds it well in Köln."), (1, "nothing here " * 40), (2, ""), (3, None), (4, "ä " * 30 + "DOG's dog")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    words = snippets.query_words("Dog  MAN dog")
    assert words == ["dog", "man"]
    found = rows(snippets.snippets(docs, words, 4, 2))
    assert (1, 0, ("nothing here " * 40)[:300] + " …") in found
    assert {r[0] for r in found} == {0, 1, 4}
    assert any("<b>dog</b>" in r[2] for r in found if r[0] == 0) and any("<b>man</b>" in r[2] for r in found if r[0] == 0)
    last = [r[2] for r in found if r[0] == 4]
    assert last == ["… ä ä ä ä ä DOG's <b>dog</b>"]
    assert rows(snippets.snippets(docs, [], 4, 2))[0][2] == texts[0][1]
    assert len([r for r in rows(snippets.snippets(docs, words, 4, 0)) if r[0] == 0]) == 1


def test_highlight_joins_places(spark):
    df = spark.createDataFrame([("x a-b-c, A-B don't a.b", "?"), (None, "?"), ("-- a-b", "?")], "t string, u string")
    assert [r[0] for r in df.select(snippets.highlight(F.col("t"), ["a-b", "b-c"])).collect()] == ["x <b>a-b-c</b>, <b>A-B</b> don't a.b", None, "-- <b>a-b</b>"]
    assert snippets.marked("--", ["-"]) == "<b>--</b>" and snippets.marked("a-b x", ["a", "-", "b"]) == "<b>a</b>-<b>b</b> x"
    for text in ("The cat's the_cat THE x", "éthe the"):
        words = ["the", "cat's"]
        assert spark.createDataFrame([(text,)], "t string").select(snippets.highlight(F.col("t"), words)).first()[0] == snippets.marked(text, words)


def test_json_lines(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, 'a "b"\n'), (1, 1, "c"), (2, 0, "ü")], "doc_id bigint, pos int, snippet string")
    collection.write_json_lines(snippets.snippet_json(table), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["docID"]) == [{"docID": 1, "snippets": ['a "b"\n', "c"]}, {"docID": 2, "snippets": ["ü"]}]


def test_command_line(spark, docs, tmp_path, capsys):
    build_index(spark, docs, str(tmp_path / "i"))
    api.main(["search", str(tmp_path / "i"), "the", "-k", "2", "-and", "-v", "of"])
    out = capsys.readouterr().out
    assert "df[the]=4" in out and "df[of]=3" in out and out.count("doc=") == 2 and f"score={bm25(['the', 'of'], True)[0][2]:.4f}" in out
    api.main(["search", str(tmp_path / "i"), "The", "--raw", "-v"])
    assert "The is not in the lexicon" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        api.main(["search", str(tmp_path / "i")])


def test_batch_plan(spark, stored):
    """The terms reach the scan, and each task keeps the best of a query before the shuffle by query."""
    queries = spark.createDataFrame([(1, ["the", "boats"], 3, False)], "query_id bigint, terms array<string>, k int, conjunctive boolean")
    plan = rank.rank_batch(stored.postings, stored.lexicon, queries, stored.stats)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ("In(term, [boats,the])" in plan or "In(term, [the,boats])" in plan)


def test_snippet_tokens_have_offsets(spark):
    text = "Größe: don't\tx_1 — Z"
    found = snippets.tokens(spark.createDataFrame([(1, text), (2, "")], "doc_id bigint, text string")).orderBy("tok_idx").collect()
    assert [r["norm"] for r in found] == ["gr", "e", "don't", "x_1", "z"]
    for i, r in enumerate(found):
        assert r["tok_idx"] == i
        assert text[r["char_start"] : r["char_end"]].lower() == r["norm"]
        assert text.encode()[r["byte_start"] : r["byte_end"]].decode().lower() == r["norm"]


def test_windows_do_not_overlap(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = snippets.pick(snippets.windows(docs, ["the"], 10), 3)
    for rows_ in found.groupBy("doc_id").agg(F.collect_list(F.struct("char_l", "char_r")).alias("w")).collect():
        spans = sorted((w["char_l"], w["char_r"]) for w in rows_["w"])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(spans) <= 3


def test_collection_lines(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text("12abc\tone\n\nno tab\n +7\ttwo\tmore\n-1\tneg\n\tempty id\n99999999999999999999\tbig\n")
    docs = collection.read_tsv(spark, str(path))
    assert rows(docs.select("doc_id", "text")) == sorted([(12, "one"), (3, "no tab"), (7, "two\tmore"), (5, "neg"), (6, "empty id"), (7, "big")], key=repr)
    assert collection.read_tsv(spark, str(path), max_docs=3).count() == 2
    assert rows(collection.docmap(docs))[0] == (12, "12abc")


def test_sidecar_and_ids(spark, tmp_path):
    docs = spark.createDataFrame([(4, "7 words 12 end"), (2, "none"), (3, ""), (9, "5 99999999999999999999")], "doc_id bigint, text string")
    assert rows(collection.sidecar(docs)) == [(0, 0), (1, 12), (2, 0)]
    assert collection.doc_ids("1, 2\t3\nx 04") == [1, 2, 3, 4]
    (tmp_path / "ids").write_text("5\n6,7")
    assert collection.doc_ids_file(str(tmp_path / "ids")) == [5, 6, 7]


def test_lexicon_file(spark, tmp_path, docs):
    lex = index.lexicon(index.postings(docs))
    collection.write_tsv(lex, str(tmp_path / "lex"))
    assert rows(collection.lexicon_from_tsv(spark, str(tmp_path / "lex"))) == rows(lex)
    collection.write_tsv(lex.drop("ft"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="ft"):
        collection.lexicon_from_tsv(spark, str(tmp_path / "short"))


def test_passages(docs):
    assert rows(index.passage_lookup(docs, [7, 99, 0])) == [(0, 7, TEXTS[7]), (1, 99, ""), (2, 0, TEXTS[0])]
    offsets = index.passage_offsets(docs).orderBy("doc_id").collect()
    data = "".join(TEXTS[d] or "" for d in sorted(TEXTS)).encode()
    assert all(data[r["byte_start"] : r["byte_end"]].decode() == (TEXTS[r["doc_id"]] or "") for r in offsets)


def test_search(spark, stored, tmp_path):
    found = search(stored, SearchRequest("Boats, the", topk=2))
    assert found["count"] == 2 and found["results"][0]["docID"] == bm25(["boats", "the"])[0][1]
    assert "<b>" in found["results"][0]["snippets"][0]
    assert search(stored, SearchRequest("zzz")) == {"query": "zzz", "results": [], "count": 0}
    assert got(hits(stored, SearchRequest("The", normalize=False))) == []
    with pytest.raises(Exception):  # noqa: B017
        open_index(spark, str(tmp_path / "none"))


def test_http(stored):
    server = api.serve(stored, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(path, body):
        return json.load(urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode(), method="POST")))

    try:
        assert post("/search", {"query": "the of", "conjunctive": True})["count"] == 3
        assert b"<form" in urllib.request.urlopen(base + "/").read()
        for path, body, status in (("/search", {"query": " "}, 400), ("/other", {}, 404), ("/search", {"query": "a", "topk": "x"}, 500)):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(path, body)
            assert e.value.code == status
    finally:
        server.shutdown()


def test_statistics_defaults():
    assert Statistics(0, 0.0).defaulted() == Statistics(1 << 31, 1.0)


def test_query_reads_only_its_terms(stored):
    """The terms reach the scan, which reads no texts; one shuffle adds up by document."""
    df = rank.rank(stored.postings, stored.lexicon, ["the", "boats"], stored.stats)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [boats,the])" in plan or "In(term, [the,boats])" in plan
    assert "ReadSchema: struct<term:string,doc_id:bigint,tf:bigint,dl:bigint>" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "TakeOrderedAndProject" in plan
