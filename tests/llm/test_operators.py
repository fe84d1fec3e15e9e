"""The training-data operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.llm import mixing, nearcopies, packing, termcounts, tokens, weighting
from quarrylight.llm.ranks import ranked
from tests.conftest import rows

POSTINGS = "shard_no int, run_no int, rec_no bigint, term string, doc_id bigint, freq int, tf string, len string"


# ---------------------------------------------------------------- near copies


def run_set(text, run):
    words = [w for w in (re.sub("[^A-Za-z0-9]", "", x).lower() for x in re.split("[ \t\n\x0b\f\r]+", text or "")) if w]
    return frozenset(tuple(words[i : i + run]) for i in range(len(words) - run + 1))


def brute_pairs(data, run, t):
    sets = [(i, run_set(x, run)) for i, x, *_ in data if i is not None and run_set(x, run)]
    out = set()
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if i != j and len(a & b) / len(a | b) >= t:
                out.add((min(i, j), max(i, j)))
    return out


def edited(seed, n, words=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.7:
            w = r.choice(texts).split()
            for _ in range(r.randrange(3)):
                at = r.randrange(len(w) + 1)
                w[at : at + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
            texts.append(" ".join(w) or "w0")
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, words * 2))))
    return texts


@pytest.mark.parametrize(
    ("run", "t", "small"),
    [
        (3, 0.5, {}),
        (5, 0.8, {}),
        (2, 0.6, {"TILE": 4, "SUBTILE": 2, "SMALL": 1}),  # every bucket is cut into tiles once its size is seen
        (2, 0.6, {"TILE": 4, "SUBTILE": 2, "SMALL": 1, "BLOCK": 200, "REPORTED": 2}),  # and the frequent ones from the start
        (3, 0.5, {"MOST_IDS": 0, "SLOTS": 64, "BLOCK": 100, "REPORTED": 1, "PART_ROWS": 50}),
        (3, 0.5, {"HOT": 0, "SALTS": 3, "FREQUENT": 5}),  # joins on hot keys
    ],
)
def test_pairs_are_exact(spark, monkeypatch, run, t, small):
    for name, value in small.items():
        monkeypatch.setattr(nearcopies, name, value)
    texts = edited(run, 150)
    data = [(i, x, "f") for i, x in enumerate(texts)] + [(1000 + i, texts[0], None) for i in range(20)] + [(2000, None, ""), (2001, "", ""), (2002, "one two", ""), (None, texts[1], "")]
    df = spark.createDataFrame(data, "line_no bigint, text string, id string")
    members, links = nearcopies.alike(df, run=run, similarity=t)
    assert set(rows(nearcopies.alike_pairs(members, links))) == brute_pairs(data, run, t)
    found = {r["line_no"]: r for r in nearcopies.groups(members, links).collect()}
    parent = {i: i for i in found}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in brute_pairs(data, run, t):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert {i: r["group_id"] for i, r in found.items()} == {i: root(i) for i in found}


def test_tiled_pairs_skip_nothing():
    r = np.random.default_rng(1)
    words = r.integers(0, 2**63, (300, 4)).astype(np.uint64) & r.integers(0, 2**63, (300, 4)).astype(np.uint64)
    words[1::2] = words[::2] ^ (np.uint64(1) << r.integers(0, 63, (150, 4)).astype(np.uint64))
    n = np.full(300, 60)
    i, j = nearcopies.tiled_pairs(words, n, np.zeros(300, dtype=np.int32), 0.8)
    want = {(a, b) for a in range(300) for b in range(a) if np.bitwise_count(words[a] ^ words[b]).sum() <= 0.2 / 1.8 * 120}
    assert {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want


def test_sketch_bounds_difference():
    texts = edited(7, 40)
    at, hashes = nearcopies.run_sets(texts, 2)
    for a in range(0, 40, 3):
        for b in range(40):
            x, y = hashes[at == a], hashes[at == b]
            bits = [np.bincount((h & np.uint64(255)).astype(int), minlength=256) & 1 for h in (x, y)]
            assert (bits[0] ^ bits[1]).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("slots", [1 << 24, 1 << 10, 2])
def test_rows_of_a_text_do_not_grow(slots):
    """However full the table of frequent runs is, a text has as many bucket rows as its prefix has runs."""
    texts = edited(4, 400, words=40)
    rows, hashes = nearcopies.run_sets(texts, 3)
    table = np.zeros(slots, dtype=np.uint8)
    table[nearcopies._slot(hashes, slots)] = 3
    got, _, _, held = nearcopies.prefix_rows(texts, np.arange(400), 3, 0.5, table)
    n = np.bincount(rows, minlength=400)
    assert (held["n"] == n).all() and (np.bincount(got, minlength=400) == np.where(n, n // 2 + 1, 0)).all()


def test_packing_of_bucket_rows():
    texts = np.zeros(50, dtype=nearcopies._TEXT)
    texts["id"], texts["n"], texts["bits"] = np.arange(50) * 7, np.arange(50), np.arange(200).reshape(50, 4)
    assert (nearcopies._from_columns(nearcopies._columns(texts), nearcopies._TEXT) == texts).all()
    key, text = np.arange(500, dtype=np.uint64) * np.uint64(977), np.arange(500) % 50
    found = []
    for batch in nearcopies._packed(key, text, np.zeros(500, dtype=np.uint8), texts, 7):
        for part, r, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            r, x = nearcopies._from_columns(r, nearcopies._ROW), nearcopies._from_columns(x, nearcopies._TEXT)
            assert 0 <= part < 7
            found += zip(r["key"].tolist(), x["id"][r["text"]].tolist(), strict=True)
    assert sorted(found) == sorted(zip(key.tolist(), (text * 7).tolist(), strict=True))


def test_uneven_join(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", 10)
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)], "k bigint, v bigint")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (5, "d"), (None, "e")], "k bigint, w string")
    assert rows(nearcopies.uneven_join(left, right, "k", F.col("v")).select("k", "v", "w")) == rows(left.join(right, "k").select("k", "v", "w"))


def test_no_texts(spark):
    empty = spark.createDataFrame([], "line_no bigint, text string")
    members, links = nearcopies.alike(empty)
    assert rows(nearcopies.alike_pairs(members, links)) == rows(nearcopies.groups(members, links)) == []


# ---------------------------------------------------------------- terms


def postings_data(seed=3, n=3000):
    r = random.Random(seed)
    data = []
    for i in range(n):
        term = "hot" if i % 3 == 0 else r.choice(["Hot!", "a-b", "ü", "", None, f"t{r.randrange(60)}", f"t{r.randrange(60)}"])
        data.append((i % 2, 0, i, term, r.randrange(80), r.choice([1, 1, 2, 3, 0, -4, None]), "x", "y"))
    return data + r.sample(data, 200) + [(None, 0, 1, "a", 1, 1, "", ""), (0, 0, 1, "a", None, 1, "", "")]


def counted(data):
    out = {}
    for shard, run, rec, term, doc, freq, *_ in data:
        t = re.sub("[^A-Za-z0-9]", "", term or "").lower()
        if t and freq is not None and freq >= 1 and None not in (shard, run, rec, doc):
            out[shard, run, rec] = (t, doc, freq)
    tf = Counter()
    for t, d, f in out.values():
        tf[d, t] += f
    return tf


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(termcounts, "RANGE", 8)  # many ranges
    data = postings_data()
    df = spark.createDataFrame(data, POSTINGS)
    tf = counted(data)
    occurrences, docs = Counter(), Counter()
    for (_, t), f in tf.items():
        occurrences[t] += f
        docs[t] += 1
    n = len({d for d, _ in tf})
    want = [(t, occurrences[t], docs[t], "rare" if docs[t] < 30 else "common" if docs[t] > 0.25 * n else None) for t in docs]
    assert rows(termcounts.marked_terms(df, least=30)) == sorted(want, key=repr)
    ids = rows(termcounts.term_dictionary(df.where("term is not null")).select("id"))
    assert [i for (i,) in sorted(ids)] == list(range(len({t for *_, t, _, _, _, _ in data if t is not None})))
    assert termcounts.marked_terms(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_term_weights(spark, monkeypatch, broadcast):
    monkeypatch.setattr(weighting, "BROADCAST_BYTES", broadcast)
    data = postings_data()
    lens = [(d, 5 + d % 7, 1, "x") for d in range(70)] + [(0, 9, 2, "x"), (1, None, 3, "x"), (2, 0, 3, "x"), (3, 4, None, "x"), (5, 10, 1, "x"), (None, 4, 1, "x"), (200, 3, 1, "x")]
    stats = spark.createDataFrame(lens, "doc_id bigint, len int, counted_at bigint, term string")
    force = defaultdict(list)
    for d, n, at, _ in lens:
        if d is not None:
            force[d].append((at if at is not None else -1, n if n is not None else -1))
    live = {d: max(v)[1] for d, v in force.items() if max(v)[1] > 0}
    tf = {k: f for k, f in counted(data).items() if k[0] in live}
    ft, cf = Counter(t for _, t in tf), Counter()
    for (_, t), f in tf.items():
        cf[t] += f
    n, mean = len(live), sum(live.values()) / len(live)
    found = weighting.term_weights(spark.createDataFrame(data, POSTINGS), stats)
    got = {(r["doc_id"], r["term"]): r for r in found.collect()}
    assert set(got) == set(tf)
    for (d, t), f in tf.items():
        weight = math.log((n - ft[t] + 0.5) / (ft[t] + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * live[d] / mean))
        residual = f * (math.log2(n / ft[t]) + math.log2(1 - math.exp(-cf[t] / n)))
        assert (got[d, t]["weight"], got[d, t]["residual"]) == pytest.approx((weight, residual))
    best = {d: min((-got[d, t]["weight"], t) for e, t in tf if e == d and ft[t] >= 2)[1] for d in {d for d, t in tf if ft[t] >= 2}}
    assert dict(rows(weighting.top_terms(found).select("doc_id", "term"))) == best
    assert weighting.top_terms(weighting.term_weights(spark.createDataFrame(data, POSTINGS).limit(0), stats.limit(0))).count() == 0


def test_ties_go_to_the_smaller_term(spark):
    data = [(0, 0, i, t, d, 1, "", "") for i, (t, d) in enumerate([("b", 1), ("a", 1), ("b", 2), ("a", 2)])]
    stats = spark.createDataFrame([(1, 2, 1), (2, 2, 1)], "doc_id bigint, len int, counted_at bigint")
    found = weighting.top_terms(weighting.term_weights(spark.createDataFrame(data, POSTINGS), stats))
    assert rows(found.select("doc_id", "term")) == [(1, "a"), (2, "a")]


# ---------------------------------------------------------------- packing and mixing


def one_by_one(items, capacity):
    bins = []
    for s in sorted(items, reverse=True):
        fitting = [(r, i) for i, r in enumerate(bins) if r >= s]
        if fitting:
            bins[min(fitting)[1]] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.data())
def test_best_fit_equals_one_by_one(capacity, data):
    items = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    steps = packing.best_fit_decreasing(dict(Counter(items)), capacity)
    room, seen = {}, defaultdict(set)
    for size, first, n, start, each in steps.tolist():
        for k in range(n):
            b = start + k // each
            room[b] = room.get(b, capacity) - size
            seen[size].add(first + k)
    assert {s: set(range(n)) for s, n in Counter(items).items()} == seen
    assert sorted(room.values()) == one_by_one(items, capacity)


def test_pack(spark):
    sizes = [(i, n) for i, n in enumerate([5, 5, 5, 0, 10, 23, 1, 7, 3, 3, 64])] + [(1, 5), (None, 4)]
    df = spark.createDataFrame([(d, n, "p") for d, n in sizes], "doc_id bigint, tokens bigint, profile string")
    capacities = spark.createDataFrame([("ten", 10, 1), ("big", 100, 1), (None, 5, 1), ("none", None, 1), ("zero", 0, 1)], "profile string, capacity int, n_tokens int")
    found = packing.pack(df, capacities)
    for profile, capacity in (("ten", 10), ("big", 100)):
        mine = found.where(F.col("profile") == profile).collect()
        assert Counter(r["doc_id"] for r in mine if r["piece_no"] == 0) == Counter(d for d, _ in sizes)
        fill = Counter()
        for r in mine:
            fill[r["container"]] += r["n_tokens"]
        assert fill.pop(None) == 0 and max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        pieces = [n for _, t in sizes if t for n in [capacity] * (t // capacity) + ([t % capacity] if t % capacity else [])]
        assert sorted(capacity - v for v in fill.values()) == one_by_one(pieces, capacity)
        whole = Counter()
        for r in mine:
            whole[r["doc_id"]] += r["n_tokens"]
        assert whole == Counter({d: sum(t for e, t in sizes if e == d) for d, _ in sizes})
    assert packing.pack(df.limit(0), capacities).count() == packing.pack(df, capacities.limit(0)).count() == 0
    report = {r["profile"]: r for r in packing.fill_report(found).collect()}
    assert report["ten"]["tokens"] == sum(t for _, t in sizes)


def test_token_counts(spark):
    texts = ["", None, "The quick brown fox.", "ü" * 1000, "word " * 20_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = dict(rows(packing.token_sizes(df)))
    encoder = tokens._encoding(open(tokens.TOKENIZER, "rb").read(), tokens.PATTERN)
    assert found == {i: len(encoder.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert found[0] == found[1] == 0 and encoder.decode(encoder.encode_ordinary(texts[3])) == texts[3]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(0, 200))
def test_exact_fit(items, budget):
    used = mixing.fit_exactly(dict(Counter(items)), budget)
    sums = {0}
    for s in items:
        sums |= {x + s for x in sums if x + s <= budget}
    assert sum(s * n for s, n in used.items()) == max(sums)
    assert all(n <= Counter(items)[s] for s, n in used.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.integers(0, 3000), st.integers(1, 4), st.integers(1, 300))
def test_quotas(items, budget, repeats, dp):
    counts = dict(Counter(items))
    own = sum(items)
    passes, last = mixing.quotas(counts, budget, repeats, dp)
    reached = passes * own + sum(s * n for s, n in last.items())
    assert reached <= max(budget, 0) and passes <= repeats and (not last or passes < repeats)
    assert all(0 < n <= counts[s] for s, n in last.items())
    if budget >= repeats * own:
        assert reached == repeats * own


def test_mix(spark):
    r = random.Random(2)
    spellings = {"web_pages": ["web_pages", " Web Pages", "WEB-PAGES "], "notes": ["notes", "Notes"], "tiny": ["tiny"]}
    docs = [(i, r.choice(spellings[s]), r.randrange(1, 300)) for i, s in enumerate(["web_pages"] * 400 + ["notes"] * 100 + ["tiny"] * 5)] + [(900, None, 50), (901, "other", 50), (None, "notes", 10)]
    sized = spark.createDataFrame([(*d, "k") for d in docs], "doc_id bigint, source string, tokens bigint, key string")
    targets = spark.createDataFrame([("web_pages", 0.4, 1), ("notes", 0.3, 3), ("tiny", 0.2, 2), ("gone", 0.1, 5), (None, 0.1, 1), ("none", None, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(sized, targets)
    found = {x["source"]: x for x in report.collect()}
    size = {s: sum(t for _, x, t in docs if x and x.strip().lower().replace(" ", "_").replace("-", "_") == s) for s in spellings}
    total = sum(size.values())
    assert set(found) == {"web_pages", "notes", "tiny", "gone"}
    for source, share, most in (("web_pages", 0.4, 1), ("notes", 0.3, 3), ("tiny", 0.2, 2), ("gone", 0.1, 5)):
        x, own = found[source], size.get(source, 0)
        assert x["own_tokens"] == own and x["short"] == (most * own < share * total)
        assert x["mixed_tokens"] == (most * own if x["short"] else x["budget"]) and x["most_uses"] <= most
    mixed = drawn.collect()
    assert sum(x["tokens"] * x["uses"] for x in mixed) == sum(x["mixed_tokens"] for x in found.values())
    assert rows(drawn) == rows(mixing.mix(sized.repartition(7), targets)[0])  # seeded
    empty, report = mixing.mix(sized.limit(0), targets)
    assert empty.count() == 0 and {x["mixed_tokens"] for x in report.collect()} == {0}
    assert mixing.mix(sized, targets.limit(0))[0].count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 5}") for i in range(900)], "i bigint, k string")
    found = defaultdict(list)
    for x in ranked(df, ["k"], F.xxhash64("i"), salts=8).collect():
        found[x["k"]].append(x["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in found.values())
