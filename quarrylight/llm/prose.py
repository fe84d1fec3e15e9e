"""Statistics of a document's text, and whether it is natural prose."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a window, and the share of characters in windows unlike prose from which a document is not prose.
WINDOW, MOST = 24, 0.5
#: Classes of a window's tokens: function words met first and again in it, other words likewise, numbers, others; and of
#: its characters: letters of any case, digits, sentence marks, other symbols.
CLASSES = ("function", "function_again", "word", "word_again", "number", "other")
CHARACTERS = ("letter", "digit", "mark", "symbol")
#: Shares of the token classes in the prose of a language, and of the character classes in any: what ``fit_profiles`` gives for
#: labelled documents with even ids, of raters who agree. Those with odd ids were left for testing.
PROSE = {
    "en": (0.32, 0.13, 0.50, 0.02, 0.03, 0.00),
    "de": (0.27, 0.10, 0.52, 0.02, 0.09, 0.00),
    "fr": (0.27, 0.09, 0.53, 0.02, 0.07, 0.02),
    "es": (0.30, 0.14, 0.45, 0.02, 0.09, 0.01),
    "pt": (0.31, 0.11, 0.48, 0.01, 0.08, 0.00),
    "pl": (0.29, 0.06, 0.54, 0.03, 0.09, 0.00),
    "ru": (0.25, 0.04, 0.64, 0.07, 0.00, 0.00),
    "el": (0.37, 0.12, 0.47, 0.05, 0.00, 0.00),
}
#: The same by form, for documents with next to no common word of a known language: words of up to SHORT letters stand for
#: function words in scripts with spaces (fitted to the labelled documents of all languages, without their common words);
#: scripts without spaces are taken character by character, with the characters of FUNCTION as function words.
#: The second form is that of languages with few short words; it asks for sentence marks, after one word in 50 to 3 in 10.
FORM = {"any": (0.27, 0.11, 0.54, 0.03, 0.04, 0.00), "long": (0.12, 0.02, 0.81, 0.03, 0.02, 0.00)}
MARKED = (0.02, 0.3)
UNSPACED = {"han": (0.17, 0.03, 0.66, 0.08, 0.03, 0.03), "kana": (0.36, 0.14, 0.41, 0.05, 0.02, 0.02), "unspaced": (0.00, 0.00, 0.68, 0.32, 0.00, 0.00)}
FUNCTION = {"han": "的了是在不我有他这們们也就和说要到会之与與這为為上中个個", "kana": "".join(chr(c) for c in range(0x3041, 0x3097)), "unspaced": ""}
SHORT, KNOWN = 3, 0.2
PROSE_CHARACTERS = (0.94, 0.03, 0.03, 0.00)
#: The same for other structures, set by hand near the means of their windows: name, kind, token classes, character classes.
OTHER = (
    ("plain list", "list", (0.00, 0.00, 0.66, 0.13, 0.21, 0.00), (0.81, 0.09, 0.10, 0.00)),
    ("marked list", "list", (0.01, 0.00, 0.49, 0.10, 0.14, 0.26), (0.76, 0.09, 0.12, 0.03)),
    ("numbered list", "list", (0.04, 0.22, 0.38, 0.04, 0.32, 0.00), (0.72, 0.13, 0.15, 0.00)),
    ("columns", "table", (0.00, 0.00, 0.21, 0.00, 0.79, 0.00), (0.28, 0.68, 0.04, 0.00)),
    ("ruled table", "table", (0.00, 0.00, 0.10, 0.05, 0.28, 0.57), (0.40, 0.43, 0.09, 0.08)),
    ("log", "table", (0.00, 0.00, 0.11, 0.00, 0.39, 0.50), (0.26, 0.57, 0.05, 0.12)),
    ("code", "junk", (0.03, 0.02, 0.30, 0.13, 0.00, 0.52), (0.81, 0.02, 0.02, 0.15)),
    ("menu", "junk", (0.01, 0.00, 0.29, 0.24, 0.00, 0.46), (0.86, 0.00, 0.00, 0.14)),
    ("symbols", "junk", (0.00, 0.00, 0.05, 0.00, 0.00, 0.95), (0.44, 0.08, 0.13, 0.35)),
    ("loose words", "junk", (0.00, 0.00, 0.96, 0.04, 0.00, 0.00), (1.00, 0.00, 0.00, 0.00)),
    ("function words", "junk", (0.79, 0.21, 0.00, 0.00, 0.00, 0.00), (0.97, 0.00, 0.03, 0.00)),
    ("repeated words", "junk", (0.00, 0.00, 0.09, 0.91, 0.00, 0.00), (1.00, 0.00, 0.00, 0.00)),
    ("repeated phrase", "junk", (0.06, 0.44, 0.06, 0.44, 0.00, 0.00), (1.00, 0.00, 0.00, 0.00)),
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_NUMBER = re.compile(r"[\d.,:/%-]*\d[\d.,:/%-]*")
_ELIDED = re.compile(r"^[^\W\d_]{1,2}['’]")
_MARKS = set(".,;:?!'\"’‘“”„«»¿¡()-–—…。、，！？；：「」『』（）《》・।،؛؟։።")
_STOPS = set(".,;:!?…。、，！？；：।،؛؟։")
_ENDS = set(".!?;:…\"'”»)。！？；」』）।؟։።")
#: Characters of scripts without spaces, with the marks that belong to them; and sentence marks that stand between them.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff][\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ece\u102b-\u103e\u17b6-\u17d3]*")
_KEPT, _ROWS = 1 << 17, 500


def _joins(c: str) -> bool:
    """Whether a character is part of a word though it is no letter: a vowel sign, an accent, a joiner."""
    return not c.isascii() and unicodedata.category(c) in ("Mn", "Mc", "Cf")


def tokens_of(text: str) -> list[str]:
    """Words between white space; scripts without spaces give a token per character."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.split()


class Tokens(dict):
    """Class, languages and number of each token, its characters by class, and its form: a row of a table for tokens met before."""

    def __init__(self, common: dict[str, set[str]]) -> None:
        self.languages = [*sorted(common), *UNSPACED]
        self.masks: dict[str, int] = {}
        for bit, lang in enumerate(self.languages):
            for word in common[lang] if lang in common else FUNCTION[lang]:
                self.masks[word] = self.masks.get(word, 0) | 1 << bit
        self.cores: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((0, 10), dtype=np.int64)

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self.table) + len(self.rows)
        self.rows.append(self._row(token))
        return at

    def _row(self, token: str) -> tuple[int, ...]:
        core = _EDGE.sub("", token).lower()
        short = script = mask = 0
        if _UNSPACED.match(token):
            mask = self.masks.get(token, 0)
            kind, script = 0 if mask else 1, 2 if "\u3040" <= token <= "\u30ff" else 1 if token >= "\u3400" else 3
        else:
            plain = core if core.isascii() else "".join(c for c in token.lower() if not _joins(c))
            plain = core if plain == token.lower() else _EDGE.sub("", plain)
            if _WORD.fullmatch(plain):
                mask = self.masks.get(core, 0) or self.masks.get(_ELIDED.sub("", core), 0)
                kind, short = 0 if mask else 1, int(len(plain) <= SHORT)
            elif token and token > "\u2fff" and all(c in _MARKS for c in token):
                kind = 2  # a sentence mark between characters
            else:
                kind = 2 if _NUMBER.fullmatch(core) else 3
        letters = sum(c.isalpha() or _joins(c) for c in token)
        digits = sum(c.isdecimal() for c in token)
        marks = sum(c in _MARKS for c in token)
        ends = int(token[-1] in _STOPS)
        return kind, mask, self.cores.setdefault(core or token, len(self.cores)), letters, digits, marks, len(token) - letters - digits - marks, short, script, ends

    def classify(self, tokens: list[str]) -> np.ndarray:
        """The rows of the tokens."""
        if len(self) > _KEPT:
            self.clear()
            self.cores.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.rows:
            self.table = np.concatenate((self.table, np.array(self.rows, dtype=np.int64)))
            self.rows = []
        return self.table[at]


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, in bits, of each row of ``p`` from each row of ``q``."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return each.sum(axis=2) / 2


class Profiles:
    """Distances of windows from the prose of their language, from prose by its form, and from other structures."""

    def __init__(self, languages: list[str]) -> None:
        prose = PROSE | UNSPACED
        mean = tuple(np.mean(list(PROSE.values()), axis=0))
        tokens = [prose.get(lang, mean) for lang in languages] + list(FORM.values()) + [x[2] for x in OTHER]
        characters = [PROSE_CHARACTERS] + [x[3] for x in OTHER]
        self.tokens, self.characters = (np.array(x) / np.sum(x, axis=1, keepdims=True) for x in (tokens, characters))
        self.n = len(languages)

    def distances(self, shares: np.ndarray, forms: np.ndarray, characters: np.ndarray, language: np.ndarray, by_form: np.ndarray) -> np.ndarray:
        """Column 0: prose; then ``OTHER`` in order. ``by_form`` is 1 for windows that may be prose of an unknown language, 2 for
        those that also have sentence marks."""
        by_token = _divergence(shares, self.tokens)
        by_character = _divergence(characters, self.characters)
        own = by_token[np.arange(len(language)), language]
        for least in range(len(FORM)):
            at = by_form > least
            if at.any():
                own[at] = np.minimum(own[at], _divergence(forms[at], self.tokens[self.n + least : self.n + least + 1])[:, 0])
        other = by_token[:, self.n + len(FORM) :]
        # without known words all prose looks like loose words or a list; short words tell them apart
        at = by_form > 0
        if at.any():
            other[at] = np.maximum(other[at], _divergence(forms[at], self.tokens[self.n + len(FORM) :]))
        return np.concatenate([own[:, None], other], axis=1) + by_character


def _shares(at: np.ndarray, kind: np.ndarray, function: np.ndarray, again: np.ndarray, windows: int) -> np.ndarray:
    classes = np.where(kind <= 1, np.where(function, 0, 2) + again, kind + 2)
    shares = np.bincount(at * 6 + classes, minlength=windows * 6).reshape(windows, 6)
    return shares / shares.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Windows:
    """The windows of several texts: owner, characters by class, shares of token classes, the same by form, language and ``by_form``
    (see ``Profiles.distances``); and per token its text, and whether it is a function word."""

    owner: np.ndarray
    characters: np.ndarray
    shares: np.ndarray
    forms: np.ndarray
    language: np.ndarray
    by_form: np.ndarray
    tokens: np.ndarray
    of: np.ndarray
    function: np.ndarray

    @property
    def character_shares(self) -> np.ndarray:
        return self.characters / np.maximum(self.characters.sum(axis=1), 1)[:, None]


def windows_of(flat: list[str], sizes: np.ndarray, lines: np.ndarray, kinds: Tokens) -> Windows:
    """Windows of about ``WINDOW`` tokens of texts that have ``sizes`` tokens and ``lines`` lines."""
    n = len(sizes)
    c = kinds.classify(flat)
    doc = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    count = np.maximum(1, np.rint(sizes / WINDOW).astype(np.int64)) * (sizes > 0)
    at = (np.cumsum(count) - count)[doc] + place * count[doc] // sizes[doc]
    windows = int(count.sum())
    owner = np.repeat(np.arange(n), count)
    starts = np.searchsorted(at, np.arange(windows))
    known = len(kinds.languages) - len(UNSPACED)
    bits = (c[:, 1, None] >> np.arange(len(kinds.languages))) & 1
    language = np.add.reduceat(bits[:, :known], starts, axis=0).argmax(axis=1)
    scripts = np.add.reduceat(c[:, 8, None] == [1, 2, 3], starts, axis=0, dtype=np.int64)
    held = np.bincount(at, minlength=windows)
    spaced = scripts.sum(axis=1) * 2 < held
    # han, kana or another script without spaces; a tenth of kana is enough to tell
    script = np.where(scripts[:, 1] * 10 >= scripts.sum(axis=1), 1, np.where(scripts[:, 0] >= scripts[:, 2], 0, 2))
    language = np.where(spaced, language, known + script)
    function = bits[np.arange(len(flat)), language[at]] == 1
    again = np.ones(len(flat), dtype=np.int64)
    again[np.unique(at << 32 | c[:, 2], return_index=True)[1]] = 0
    # by form: short words that stand by no number; documents whose words are known don't need it
    number = (c[:, 0] == 2).astype(np.int64)
    beside = np.concatenate(([0], number[:-1])) + np.concatenate((number[1:], [0])) > 0
    unknown = np.bincount(doc, function, n) < KNOWN * np.bincount(doc, c[:, 0] <= 1, n)
    marked = np.bincount(doc, c[:, 9], n) / np.maximum(sizes, 1)
    # short lines without sentence marks are a list in a language that is not known
    by_form = np.where(unknown & (marked <= MARKED[1]), np.where(marked >= MARKED[0], 2, np.where(sizes >= 4 * lines, 1, 0)), 0)
    return Windows(
        owner,
        np.add.reduceat(c[:, 3:7], starts, axis=0),
        _shares(at, c[:, 0], function, again, windows),
        _shares(at, c[:, 0], (c[:, 7] == 1) & ~beside, again, windows),
        language,
        np.where(spaced, by_form[owner], 0),
        held,
        doc,
        function,
    )


def _taken_apart(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts, tokens, lines, and lines that end in punctuation of each)."""
    split = [tokens_of(t) if t else [] for t in texts]
    lines, ends = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            kept = [x for x in (line.rstrip() for line in t.split("\n")) if x]
            lines[i], ends[i] = len(kept), sum(x[-1] in _ENDS for x in kept)
    return [t for tokens in split for t in tokens], np.array([len(t) for t in split], dtype=np.int64), lines, ends


def statistics(texts: list[str | None], kinds: Tokens, profiles: Profiles) -> pd.DataFrame:
    """One row per text; see ``text_statistics``."""
    flat, sizes, lines, ends = _taken_apart(texts)
    n = len(texts)
    out = pd.DataFrame({"words": sizes, "lines": lines, "line_end_share": np.round(ends / np.maximum(lines, 1), 6)})
    names = ["mean_word_length", "symbol_ratio", "common_word_share", "divergence", "prose_share"]
    if not flat:
        return out.assign(**dict.fromkeys(names, 0.0), profile=None, is_prose=None)
    w = windows_of(flat, sizes, lines, kinds)
    far = profiles.distances(w.shares, w.forms, w.character_shares, w.language, w.by_form)
    nearest = far.argmin(axis=1)
    weight = w.characters.sum(axis=1) + w.tokens  # with the space after each token
    total = np.maximum(np.bincount(w.owner, weight, n), 1)
    by_profile = np.zeros((n, len(OTHER) + 1))
    np.add.at(by_profile, (w.owner, nearest), weight)
    prose = by_profile[:, 0] / total
    marks = np.zeros((n, len(CHARACTERS)), dtype=np.int64)
    np.add.at(marks, w.owner, w.characters)
    all_letters = np.maximum(marks.sum(axis=1), 1)
    out["mean_word_length"] = np.round(marks.sum(axis=1) / np.maximum(sizes, 1), 6)
    out["symbol_ratio"] = np.round(marks[:, -1] / all_letters, 6)
    out["common_word_share"] = np.round(np.bincount(w.of, w.function, n) / np.maximum(sizes, 1), 6)
    out["divergence"] = np.round(np.bincount(w.owner, far[:, 0] * weight, n) / total, 6)
    out["prose_share"] = np.round(prose, 6)
    is_prose = prose >= 1 - MOST
    name = ["prose", *(x[0] for x in OTHER)]
    rest = by_profile[:, 1:].argmax(axis=1) + 1
    out["profile"] = [None if not s else name[0] if p else name[r] for s, p, r in zip(sizes, is_prose, rest, strict=True)]
    out["is_prose"] = [None if not s else bool(p) for s, p in zip(sizes, is_prose, strict=True)]
    return out


def fit_profiles(texts: list[str], labels: list[str], kinds: Tokens) -> tuple[dict, tuple, tuple, tuple]:
    """(PROSE, PROSE_CHARACTERS, the first of FORM, OTHER) as the mean shares of the windows of labelled texts.

    A window of prose counts for its language. Of the other labels' windows, each counts for the structure of its label that
    it is nearest to now, so the names of ``OTHER`` stay.
    """
    flat, sizes, lines, _ = _taken_apart(texts)
    w = windows_of(flat, sizes, lines, kinds)
    label = np.array(labels)[w.owner]
    far = Profiles(kinds.languages).distances(w.shares, w.forms, w.character_shares, w.language, np.zeros(len(label), dtype=np.int64))
    mean = lambda rows: tuple(float(x) for x in np.round(rows.mean(axis=0), 2))
    prose = label == "prose"
    by_language = {lang: mean(w.shares[prose & (w.language == i)]) for i, lang in enumerate(kinds.languages) if (prose & (w.language == i)).sum() >= 5}
    other = []
    for i, (name, kind, *old) in enumerate(OTHER):
        same = [j for j, x in enumerate(OTHER) if x[1] == kind]
        mine = (label == kind) & (np.array(same)[far[:, 1:][:, same].argmin(axis=1)] == i)
        other.append((name, kind, *((mean(w.shares[mine]), mean(w.character_shares[mine])) if mine.sum() >= 5 else old)))
    return by_language, mean(w.character_shares[prose]), mean(w.forms[prose]), tuple(other)


def text_statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", most_words: int = 100_000) -> DataFrame:
    """One row per document: words, lines, line_end_share (lines ending in punctuation), mean_word_length, symbol_ratio,
    common_word_share, divergence, prose_share, profile and is_prose.

    The text is cut into windows of about ``WINDOW`` tokens. Each has shares of token and character classes; the profile
    nearest by Jensen-Shannon divergence, of prose in the window's language or of another structure, is the window's.
    ``divergence`` is that from prose, ``prose_share`` the share of characters in prose windows; a document is prose if this
    is at least half, else its profile is the other one with most characters.

    Languages without common words are told by form: short words stand for function words, and sentence marks for languages
    that have few of them. In scripts without spaces each character is a word. Prose of such a language that has neither
    short words nor sentence marks, or is set in lines of under four words without marks, is taken for loose words or a list.

    Null, empty and blank texts: no words, zeros, profile and is_prose null. Whole texts are used, of any length. Repeated
    rows give the same result; an empty table gives none; other columns are dropped. Null words or languages are left out.
    """
    words = common_words.where("lang is not null and word is not null").select("lang", "word").distinct().limit(most_words + 1).collect()
    if len(words) > most_words:
        raise ValueError(f"more than {most_words} common words")
    common: dict[str, set[str]] = {}
    for r in words:
        common.setdefault(r["lang"], set()).add(r["word"].lower())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = Tokens(common or {"": set()})
        profiles = Profiles(kinds.languages)
        for batch in batches:
            for lo in range(0, len(batch), _ROWS):
                part = batch.iloc[lo : lo + _ROWS]
                yield pd.concat([part[[key]].reset_index(drop=True), statistics(part["text_"].tolist(), kinds, profiles)], axis=1)

    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, words bigint, lines bigint, line_end_share double, mean_word_length double, symbol_ratio double, common_word_share double, divergence double, prose_share double, profile string, is_prose boolean"
    return documents.select(key, F.col(text).alias("text_")).mapInPandas(run, schema)
