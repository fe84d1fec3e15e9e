"""Prose and what is none: labels that the fit left out, and languages that no table has (seen while the rules were set)."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from quarrylight.llm import prose
from tests.conftest import rows
from tests.llm.test_encoding import OTHERS

NO_SENTENCES = {"check marks", "ipa", "mathematics"}


@pytest.fixture(scope="module")
def common(spark, small):
    out = defaultdict(set)
    for r in spark.read.parquet(f"{small}/common_words.parquet").where("lang is not null and word is not null").collect():
        out[r["lang"]].add(r["word"].lower())
    return dict(out)


def judged(text, common):
    kinds = prose.Tokens(common)
    return prose.statistics([text], kinds, prose.Profiles(kinds.languages)).iloc[0]


@pytest.fixture(scope="module")
def labelled(spark, small):
    """(text, label) of even and of odd documents on which the raters agree."""
    sf = small.replace("sf0.001", "sf0.1")
    texts = dict(rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")))
    labels = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/doc_labels.parquet").where("label is not null").collect():
        labels[r["doc_id"]].add(r["label"])
    sure = [(d, texts[d], v.pop()) for d, v in sorted(labels.items()) if len(v) == 1 and texts.get(d)]
    return [[(t, x) for d, t, x in sure if d % 2 == odd] for odd in (0, 1)]


def test_held_out_labels(common, labelled):
    """Agreement on documents that were not used in the fit."""
    kinds = prose.Tokens(common)
    found = prose.statistics([t for t, _ in labelled[1]], kinds, prose.Profiles(kinds.languages))["is_prose"]
    right = [a == (label == "prose") for a, (_, label) in zip(found, labelled[1], strict=True)]
    assert len(right) > 150 and sum(right) >= 0.99 * len(right)


def test_fit_gives_the_profiles(common, labelled):
    """The constants are what a fit to even documents gives, here to a tenth of the documents that they were fitted to."""
    by_language, characters, form, other = prose.fit_profiles(*zip(*labelled[0], strict=True), prose.Tokens(common))
    assert np.abs(np.array(by_language["en"]) - prose.PROSE["en"]).max() <= 0.03
    assert np.abs(np.array(characters) - prose.PROSE_CHARACTERS).max() <= 0.02
    assert np.abs(np.array(form) - prose.FORM["any"]).max() <= 0.04
    assert [x[:2] for x in other] == [x[:2] for x in prose.OTHER]


@pytest.mark.parametrize("name", sorted(set(OTHERS) - NO_SENTENCES))
def test_prose_of_any_language(name, common):
    assert judged(OTHERS[name], common)["is_prose"]


@pytest.mark.parametrize("name", ["italian", "dutch", "finnish", "turkish", "swedish", "czech", "hungarian", "romanian"])
def test_words_of_any_language_are_no_prose(name, common):
    r = random.Random(1)
    words = [w for w in (x.strip(".,;:!?«»").lower() for x in OTHERS[name].split()) if len(w) > 4]
    loose = " ".join(r.choice(words) for _ in range(60))
    listed = "\n".join("- " + r.choice(words) for _ in range(20))
    plain = "\n".join(r.choice(words).capitalize() for _ in range(20))
    assert not any(judged(t, common)["is_prose"] for t in (loose, listed, plain))


def test_scripts_without_spaces(common):
    assert not judged("\n".join(["苹果", "香蕉", "图书馆", "历史", "城市", "汽车", "电脑", "老师"] * 3), common)["is_prose"]
    assert not judged("ホーム | ログイン | 検索 | 設定 | ホーム | ヘルプ | 連絡\n" * 5, common)["is_prose"]
    assert not judged("点击这里 " * 40, common)["is_prose"]
    assert prose.tokens_of("我们 ok。") == ["我", "们", "ok。"]


def test_prose_edges(spark):
    line = "It was not until the end of the year that the nurse of the town found a way to be kept in the ward. "
    texts = {1: None, 2: "", 3: " \n\t", 4: line * 3, 5: (line * 3).upper(), 6: "- loom\n- kiln\n- oven (3 kg)\n" * 8, 7: "@@@ ### $$$\n" * 30, 8: "click here " * 50, 9: line * 3000, 10: line + "| a | 1 |\n" * 80, 11: (line * 3).replace(" ", "\n")}
    words = spark.createDataFrame([(w, "en") for w in "it was not until the of that a to be in way end".split()] + [(None, "en"), ("x", None)], "word string, lang string")
    df = spark.createDataFrame([(i, t, "p") for i, t in texts.items()] + [(4, texts[4], "p")], "doc_id bigint, text string, profile string")
    found = {r["doc_id"]: r for r in prose.text_statistics(df, words).collect()}
    assert {i: r["is_prose"] for i, r in found.items()} == {1: None, 2: None, 3: None, 4: True, 5: True, 6: False, 7: False, 8: False, 9: True, 10: False, 11: True}
    assert found[4]["words"] == len(texts[4].split()) and found[6]["lines"] == 24 and found[6]["line_end_share"] == pytest.approx(1 / 3)
    assert found[7]["symbol_ratio"] == 1.0 and found[4]["mean_word_length"] == pytest.approx(np.mean([len(w) for w in texts[4].split()]), abs=1e-6)
    assert prose.text_statistics(df.limit(0), words).count() == 0
    assert prose.text_statistics(df, words.limit(0)).count() == len(texts) + 1
