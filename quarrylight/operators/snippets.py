"""Query-dependent snippets: tokens with offsets, windows around matches, a greedy pick, and highlighting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORD = "[A-Za-z0-9_']"
_IS_WORD = re.compile(_WORD)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_SEGMENT = f"{_WORD}+|[^A-Za-z0-9_']+"


def query_words(query: str) -> list[str]:
    """Distinct words of a query, lower case, in order; punctuation stays."""
    return sorted({w.lower() for w in re.split(r"[ \t\n\x0b\f\r]+", query) if w})


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, norm, byte_start, byte_end, char_start, char_end) of maximal runs of letters, digits, _ and '.

    The texts are placed by document once; the offsets are running sums of segment lengths within it.
    """
    segments = docs.repartition("doc_id").select("doc_id", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(_SEGMENT), F.lit(0))).alias("pos", "segment"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_word = F.col("segment").rlike(f"^{_WORD}")
    placed = segments.select(
        "doc_id",
        "segment",
        is_word.alias("word"),
        F.sum(F.octet_length("segment").cast("bigint")).over(upto).alias("byte_end"),
        F.sum(F.length("segment").cast("bigint")).over(upto).alias("char_end"),
        (F.sum(is_word.cast("bigint")).over(upto) - 1).alias("tok_idx"),
    ).where("word")
    return placed.select(
        "doc_id",
        "tok_idx",
        F.lower("segment").alias("norm"),
        (F.col("byte_end") - F.octet_length("segment")).alias("byte_start"),
        "byte_end",
        (F.col("char_end") - F.length("segment")).alias("char_start"),
        "char_end",
    )


def with_any_word(docs: DataFrame, words: list[str]) -> DataFrame:
    """Documents in whose text a word may match: found without tokenising, so others are not exploded."""
    if not words:
        return docs.limit(0)
    any_of = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return docs.where(F.col("text").rlike(f"(?i)(?<!{_WORD})(?:{any_of})(?!{_WORD})"))


def windows(docs: DataFrame, words: list[str], windowsz: int = 50) -> DataFrame:
    """(doc_id, match_tok, tok_l, tok_r, char_l, char_r, uniq, total, span, score): a window around each matching token.

    It reaches half of ``windowsz`` tokens to either side. The score adds twice the distinct matches, all matches, half the
    ratio of ``windowsz`` to the window's width, and 0.2 if it begins in the first 200 bytes.
    """
    half = windowsz // 2
    all_tokens = tokens(with_any_word(docs, words))
    ordered, whole = Window.partitionBy("doc_id").orderBy("tok_idx"), Window.partitionBy("doc_id")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    # running counts, so that a window's count is a difference of two rows and no frame is added up again for each token
    runs = [F.sum((F.col("norm") == w).cast("bigint")).over(upto).alias(f"c{i}") for i, w in enumerate(words)]
    counted = all_tokens.select("*", *runs)

    def before(column: str) -> Column:
        return F.lag(column, half).over(ordered)

    def after(column: str) -> Column:
        return F.coalesce(F.lead(column, half).over(ordered), F.max(column).over(whole))

    edges = [F.greatest(F.col("tok_idx") - half, F.lit(0)).alias("tok_l"), after("tok_idx").alias("tok_r"), F.coalesce(before("byte_start"), F.min("byte_start").over(whole)).alias("byte_l"), F.coalesce(before("char_start"), F.min("char_start").over(whole)).alias("char_l"), after("char_end").alias("char_r")]
    outside = [F.coalesce(F.lag(f"c{i}", half + 1).over(ordered), F.lit(0)) for i in range(len(words))]
    counts = [(after(f"c{i}") - outside[i]).alias(f"n{i}") for i in range(len(words))]
    framed = counted.select("doc_id", F.col("tok_idx").alias("match_tok"), "norm", *edges, *counts).where(F.col("norm").isin(words))
    zero = F.lit(0).cast("bigint")
    uniq, total = zero, zero
    for i in range(len(words)):
        uniq, total = uniq + (F.col(f"n{i}") > 0).cast("bigint"), total + F.col(f"n{i}")
    span = F.col("tok_r") - F.col("tok_l") + 1
    score = 2.0 * F.col("uniq") + F.col("total") + 0.5 * (F.lit(float(windowsz)) / F.greatest(F.lit(1), F.col("span"))) + F.when(F.col("byte_l") < 200, 0.2).otherwise(0.0)
    out = framed.select("doc_id", "match_tok", "tok_l", "tok_r", "byte_l", "char_l", "char_r", uniq.alias("uniq"), total.alias("total"), span.alias("span"))
    return out.withColumn("score", F.round(score, 6)).drop("byte_l")


def pick(window_table: DataFrame, per: int = 2) -> DataFrame:
    """(doc_id, pos, match_tok, char_l, char_r, score): the best windows that don't overlap, ``per`` of a document at most, at least one.

    Best is score, then the earlier start, then the earlier match.
    """
    item = F.struct((-F.col("score")).alias("s"), "char_l", "match_tok", "char_r")
    kept_type = "array<struct<s:double,char_l:bigint,match_tok:bigint,char_r:bigint>>"

    def add(kept: Column, w: Column) -> Column:
        apart = ~F.exists(kept, lambda o: F.greatest(o["char_l"], w["char_l"]) < F.least(o["char_r"], w["char_r"]))
        return F.when((F.size(kept) < max(per, 1)) & apart, F.concat(kept, F.array(w))).otherwise(kept)

    per_doc = window_table.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))  # matches of one document
    chosen = per_doc.select("doc_id", F.posexplode(F.aggregate("all", F.array().cast(kept_type), add)).alias("pos", "w"))
    return chosen.select("doc_id", "pos", F.col("w.match_tok").alias("match_tok"), F.col("w.char_l").alias("char_l"), F.col("w.char_r").alias("char_r"), (-F.col("w.s")).alias("score"))


def marked(text: str, words: list[str]) -> str:
    """``highlight`` of one text: the places of all words, joined where they overlap or touch."""
    low = text.translate(_LOWER)
    places = []
    for w in {x.translate(_LOWER) for x in words if x}:
        at = low.find(w)
        while at >= 0:
            end = at + len(w)
            if not (at and _IS_WORD.match(text[at - 1]) or end < len(text) and _IS_WORD.match(text[end])):
                places.append((at, end))
            at = low.find(w, end)
    out, done, places = [], 0, sorted(places)
    while places:
        at, end = places.pop(0)
        while places and places[0][0] <= end:
            end = max(end, places.pop(0)[1])
        out += [text[done:at], "<b>", text[at:end], "</b>"]
        done = end
    return "".join(out) + text[done:]


def highlight(text: Column, words: list[str]) -> Column:
    """Every occurrence of a word between word boundaries, in any case, in bold marks; occurrences that overlap or touch share them.

    Words of letters, digits, ``_`` and ``'`` only can't overlap, so one expression finds them.
    """
    words = [w for w in words if w]
    if not words:
        return text
    if not all(re.fullmatch(f"{_WORD}+", w) for w in words):

        @F.pandas_udf("string")
        def mark(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: marked(t, words), na_action="ignore")

        return mark(text)
    any_of = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)(?<!{_WORD})({any_of})(?!{_WORD})", "<b>$1</b>")


def sliced(text: Column, char_l: Column, char_r: Column) -> Column:
    """The window with ten characters to either side, and marks where text is left out."""
    left, right = F.greatest(char_l - 10, F.lit(0)), F.least(F.length(text).cast("bigint"), char_r + 10)
    body = F.substr(text, left + 1, right - left)
    return F.concat(F.when(left > 0, "… ").otherwise(""), body, F.when(right < F.length(text), " …").otherwise(""))


def head(text: Column) -> Column:
    """The first 300 characters, where nothing matches."""
    return F.concat(F.substring(text, 1, 300), F.when(F.length(text) > 300, " …").otherwise(""))


def snippets(docs: DataFrame, words: list[str], windowsz: int = 50, per: int = 2) -> DataFrame:
    """(doc_id, pos, snippet) of each document; one without a match has its head. Null and empty texts have none."""
    some = docs.where("text is not null and text <> ''").select("doc_id", "text")
    chosen = pick(windows(some, words, windowsz), per).select("doc_id", "pos", "char_l", "char_r")
    both = some.join(chosen, "doc_id", "left")
    shown = F.when(F.col("pos").isNull(), head(F.col("text"))).otherwise(highlight(sliced(F.col("text"), F.col("char_l"), F.col("char_r")), words))
    return both.select("doc_id", F.coalesce("pos", F.lit(0)).cast("int").alias("pos"), shown.alias("snippet"))


def snippet_json(snippet_table: DataFrame) -> DataFrame:
    """(doc_id, json): {"docID": n, "snippets": [..]} per document, in order."""
    listed = snippet_table.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "snippet"))).alias("all"))
    return listed.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("docID"), F.transform("all", lambda x: x["snippet"]).alias("snippets"))).alias("json"))
