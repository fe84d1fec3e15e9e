"""Uneven keys and rows that don't parse, against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.operators import postings, rejects, skew
from tests.conftest import rows

POSTINGS = "shard_no int, run_no int, rec_no bigint, term string, doc_id bigint, freq int, written_at timestamp, records string"


def brute_counts(data):
    records = defaultdict(set)
    for shard, run, rec, term, doc, freq, *_ in data:
        t = re.sub("[^A-Za-z0-9]", "", term or "").lower()
        if t and freq is not None and freq >= 1 and None not in (shard, run, rec, doc):
            records[shard, t].add((run, rec, doc))
    return {k: (len(v), len({d for *_, d in v})) for k, v in records.items()}


def skewed(n=4000):
    r = random.Random(5)
    data = []
    for i in range(n):
        term = "hot" if i % 3 == 0 else r.choice(["Hot!", "a", "b b", "ü", "", None, f"t{i % 50}"])
        data.append((r.randrange(3), r.randrange(2), i, term, r.randrange(200) if i % 3 else 7, r.choice([1, 2, 0, -1, None]) if i % 5 == 0 else 1, None, "x"))
    data += r.sample(data, 300)
    data += [(None, 1, 1, "a", 1, 1, None, "x"), (1, None, 1, "a", 1, 1, None, "x"), (1, 1, None, "a", 1, 1, None, "x"), (1, 1, 1, "a", None, 1, None, "x")]
    return data


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_key_counts(spark, partitions):
    data = skewed()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = skew.balanced_key_counts(spark.createDataFrame(data, POSTINGS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["shard_no"], r["term"]): (r["postings"], r["ft"]) for r in found} == brute_counts(data)


def test_one_document_over_many_partitions(spark):
    """One key and one document with many records: the states at the boundaries are stitched."""
    data = [(0, 0, i, "x", 1, 1, None, "") for i in range(3000)] + [(0, 0, 5000, "x", 2, 1, None, "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(skew.balanced_key_counts(spark.createDataFrame(data, POSTINGS).repartition(5)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == [(0, "x", 3001, 2)]


def test_heavy_keys_and_lexicon(spark):
    data = skewed()
    df = spark.createDataFrame(data, POSTINGS)
    want = brute_counts(data)
    totals = defaultdict(int)
    for (s, _), (n, _) in want.items():
        totals[s] += n
    assert set(rows(skew.heavy_keys(df))) == {k for k, (n, _) in want.items() if n * 50 >= totals[k[0]]}
    lexicon = spark.createDataFrame([(0, "hot", 5, 1), (0, "hot", None, 2), (1, "hot", 9, None), (None, "hot", 1, 1), (0, None, 1, 1)], "shard_no int, term string, postings bigint, built_at bigint")
    found = {(r["shard_no"], r["term"]): r["lexicon_postings"] for r in skew.lexicon_counts(df, lexicon).collect()}
    assert found[0, "hot"] is None and found[1, "hot"] == 9 and len(found) == len(want)


def test_empty_postings(spark):
    empty = spark.createDataFrame([], POSTINGS)
    assert rows(skew.balanced_key_counts(empty)) == rows(skew.heavy_keys(empty)) == rows(postings.document_terms(empty, "doc_id")) == []


LINES = [
    '1\tplain', '2\tmid 5" quote', '"3"\t"q ""x"" y"', '4\t"open', '5\t"abc"def', "6\ta\tb", "7", "", '8\t"tab\tin"', "9\t ", " 10 \tsp", '11\t"  "', '12\t""', "+13\tx", "4e2\tx", "9223372036854775807\tmax",
    "9223372036854775808\tx", "\t x", ' "14"\tx', '15\t "lead', "16\tnul\0x", "17\tcr\rmid", "18\ttrail\r", '19\t"trail"\r', "20\ttwo\r\r", '21\t"a" ', '22\t"a""', '23\t\\"esc', "24\t#x", "#25\tx", "26\tx\t", "27\t﻿t", "﻿28\tt",
    '29\t"""', "1_0\tx", '"31\tx"\ty', "32\tä \x85", "NULL\tx", "33\tNULL", '34\t"', "35\tline\nin", "\xa036\tx", "٣\tx", "000000000000000000000000037\tzeros", "38\t\x1b0\x1b\x1b", "39\t" + "long " * 300_000, None,
]


FIELD = r'("[^"]*(?:""[^"]*)*"|(?!")[^\t]*)'


def plain(field):
    return field[1:-1].replace('""', '"') if field.startswith('"') else field


def brute_line(line):
    """(id, text, reason) by the line grammar: two tab-separated fields, quoted if they start with a quote."""
    m = re.fullmatch(rf"{FIELD}\t{FIELD}", line, re.DOTALL)
    if m is None:
        if not re.fullmatch(rf"{FIELD}(?:\t{FIELD})*", line, re.DOTALL):
            return None, None, "broken quoting"
        return None, None, "too few fields" if re.fullmatch(FIELD, line, re.DOTALL) else "too many fields"
    number, text = plain(m[1]).strip(" "), plain(m[2])
    if not re.fullmatch("[0-9]+", number) or int(number) >= 2**63:
        return None, None, "invalid id" if number else "missing id"
    return (int(number), text, None) if text.strip(" ") else (None, None, "empty text")


def test_lines(spark):
    df = spark.createDataFrame([(i, "f", x, None, "?") for i, x in enumerate(LINES)] + [(0, "f", LINES[0], None, "?")], "line_no bigint, file_name string, line string, received_at timestamp, reason string")
    found = rejects.read_lines(df).collect()
    assert len(found) == len(LINES) + 1
    for r in found:
        line = LINES[r["line_no"]]
        want = (None, None, "null line") if line is None else brute_line(line.removesuffix("\r"))
        assert (r["id"], r["text"], r["reason"]) == want, line and line[:50]


def test_small_blocks_give_the_same(monkeypatch):
    monkeypatch.setattr(rejects, "BLOCK_CHARS", 7)
    with duckdb.connect(config={"threads": 1}) as con:
        found = rejects._split_lines(con, pa.array(LINES)).to_pylist()
    assert [(r["number"], r["text"], r["reason"]) for r in found] == [(None, None, "null line") if x is None else brute_line(x.removesuffix("\r")) for x in LINES]


def test_the_reader_decides(monkeypatch):
    """With a reader that accepts nothing, no row loads; what it accepts is what loads."""
    with duckdb.connect(config={"threads": 1}) as con:
        assert [r["reason"] for r in rejects.parsed(con, ["1\tone", "2\ttwo"]).to_pylist()] == [None, None]
        read = rejects._read
        monkeypatch.setattr(rejects, "_read", lambda con, lines: read(con, [x + "\t" for x in lines]))
        assert {r["reason"] for r in rejects.parsed(con, ["1\tone", "2\ttwo"]).to_pylist()} == {"too many fields"}
        assert {r["reason"] for r in rejects._split_ids(con, pa.array(["1", "2"]), pa.array(["a", "b"])).to_pylist()} == {"too many fields"}


def test_ids(spark):
    ids = ["1", " 2 ", "0003", "x", "", "  ", None, "+4", '"5"', "6\t", "9223372036854775808", "\r7", '8"9', "1.0"]
    df = spark.createDataFrame([(i, x, "t") for i, x in enumerate(ids)], "line_no bigint, external_id string, text string")
    found = {r["line_no"]: (r["id"], r["reason"]) for r in rejects.check_ids(df).collect()}
    assert [found[i][0] for i in range(len(ids))] == [1, 2, 3] + [None] * 11
    assert found[4][1] == found[5][1] == found[6][1] == "missing id" and found[3][1] == "invalid id"
    empty = df.limit(0)
    assert rejects.check_ids(empty).count() == rejects.read_lines(empty.selectExpr("line_no", "text as line")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='"\t 12a\r\n\0\\é\x1b#,.', max_size=9), min_size=1, max_size=20))
def test_reader_follows_the_grammar(lines):
    with duckdb.connect(config={"threads": 1}) as con:
        for r, line in zip(rejects.parsed(con, lines).to_pylist(), lines, strict=True):
            assert (r["number"], r["text"], r["reason"]) == brute_line(line)
