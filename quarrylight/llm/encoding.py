"""Text decoded with a wrong encoding: finding it, and restoring what can be restored.

Nothing here knows what a language looks like. Two things tell garbled text from text in a language that was not foreseen.
The first is form: signs inside words, scripts or capitals mixed in a word, and byte sequences of UTF-8, all of which a wrong
decoding makes, and only in tokens whose characters one legacy encoding has. The second is a public multilingual tokenizer:
written text of any language it covers needs fewer tokens than its wrong decoding. A repair needs both to improve.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tokens import PATTERN

#: Encodings that text may have been read with, and those it may have been written in.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "iso8859-2")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "cp1253")
#: Layers of wrong decoding that are taken off.
LAYERS = 4
#: Least cost for a try, least share of a repair's tokens and of its cost that must go, and cost left over from which text is
#: garbled though nothing restores it.
TRY, FEWER, DROP, LEFT = 0.25, 0.1, 0.5, 0.9
#: The ranks of a public multilingual byte-pair tokenizer, by which readings are judged.
MODEL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Tokens whose cost, size or reading is kept.
_KEPT = 1 << 17
_SPACE = re.compile(r"([ \t\n\r]+)")
_OPEN, _CLOSE, _QUIET = set("“‘«¿¡„‹"), set("”»›"), set("…•·™©®º°ª")
_NATURAL = set("–—-\xa0\xad’‘'ʼ€£±×½¼¾§√≈≤≥≠÷²³¹µ∞∂∑∏∫∆◊†‡")
#: Signs that a repair may turn a letter into.
_TEXT_MARKS = set("“”‘’„–—…€¿¡«»")
#: Marks that cost as many tokens as their ASCII forms when readings are compared.
_PLAIN = str.maketrans("’‘“”–—", "''\"\"--")
#: What stands for an apostrophe, a quotation mark or a dash of English where its bytes were read as mac_roman or cp437, or
#: where the control characters of its reading as latin-1 were lost; and English, as only there such words are known.
_STUMP = re.compile(r"[a-z]([âíÆ])(?:s|t|re|ve|ll|d|m)\b|(?<!\w)([âìô])[a-z]{2,}|(?<!\w)[a-z]{2,}([âîö])(?!\w)")
_DASH_STUMP = re.compile(r"[a-z,] [âóùÄ] [a-z]")
_PAIR_STUMP = re.compile(r"(?<!\w)â\w[^â]{0,60}\wâ(?!\w)|(?<!\w)ì\w[^ìî]{0,60}\wî(?!\w)")
_MAY_STUMP = re.compile("[âíÆìôîöóùÄ]")
_ENGLISH = re.compile(r"\b(?:the|of|and|to|is|that|it)\b")


def _script(c: str) -> str:
    return "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "latin"


def _table(name: str) -> list[str]:
    """The 256 characters of an encoding; bytes it leaves out are read as control characters, as lenient readers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_TABLES = {name: _table(name) for name in READ_AS}
_BYTES = {name: {c: b for b, c in reversed(list(enumerate(t)))} for name, t in _TABLES.items()}
# a reader as latin-1 keeps these bytes as control characters
_BYTES["cp1252"] |= {chr(b): b for b in range(0x80, 0xA0)}
_HELD = [frozenset(c for c in t if not c.isascii()) for t in _BYTES.values()]
_CYRILLIC = ("cp1251", "koi8-r")


def _sequences(name: str) -> re.Pattern[str]:
    """What two to four bytes of UTF-8 look like in the encoding."""
    table = _TABLES[name]
    both = lambda lo, hi: {table[b] for b in range(lo, hi)} | ({chr(b) for b in range(lo, min(hi, 0xA0))} if name == "cp1252" else set())
    some = lambda lo, hi: "[" + "".join(map(re.escape, sorted(both(lo, hi)))) + "]"
    rest = some(0x80, 0xC0)
    return re.compile(f"{some(0xC2, 0xE0)}{rest}|{some(0xE0, 0xF0)}{rest}{{2}}|{some(0xF0, 0xF5)}{rest}{{3}}")


_SEQUENCES = {name: _sequences(name) for name in READ_AS}


def _mark(c: str, before: str, after: str) -> float:
    """Cost of a sign from its neighbours; these are empty at the token's ends."""
    left, right = _letter(before), _letter(after)
    if c in _NATURAL:
        return 1.0 if c in "€£" and left and right else 0.5 if c in "²³¹µ±½¼¾√≈≤≥≠÷∂∑∏∫∆◊†‡" and right else 0.0
    if c in _OPEN:
        return 1.0 if left else 0.0
    if c in _CLOSE:
        return 1.0 if right and before else 0.0
    if c in _QUIET:
        return 0.0 if not (left and right) or before == after else 0.2 if c == "…" else 0.5
    if "─" <= c <= "▟":
        return 1.5 if left or right else 0.0
    return 1.0 if left and right else 0.4 if left or right else 0.0


def _letter(c: str) -> bool:
    return bool(c) and (c.isalpha() or unicodedata.category(c)[0] == "M")


def _lost(c: str) -> bool:
    return c == "�" or "\x80" <= c <= "\x9f"


@lru_cache(maxsize=_KEPT)
def _cost(token: str) -> float:
    """``_form`` of a token that some encoding can have made, that is, whose characters beyond ASCII are all in its table; of
    any other token only the characters that were lost or are control characters."""
    odd = {c for c in token if not c.isascii() and not _lost(c)}
    return _form(token) if any(odd <= held for held in _HELD) else 3.0 * sum(map(_lost, token))


@lru_cache(maxsize=_KEPT)
def _form(token: str) -> float:
    """How much of a token's form written text doesn't have: lost characters, signs in words, scripts and capitals mixed in a word."""
    lost = sum(map(_lost, token))
    cost, before, at, foreign = 3.0 * lost, "", 0, 0
    for i, c in enumerate(token):
        after = token[i + 1] if i + 1 < len(token) else ""
        if not _letter(c):
            cost += 0.0 if c.isascii() or _lost(c) else _mark(c, before, after)
            before, at, foreign = c, 0, 0
            continue
        foreign += not c.isascii()
        if at and not (c.isascii() and before.isascii()):
            if _script(before) != _script(c) and unicodedata.category(c)[0] != "M":
                # one Greek letter before a word is a symbol
                cost += 0.4 if at == 1 and _script(before) == "greek" else 1.5
            elif c.isupper() and before.islower():
                cost += 0.7 if at > 2 or after.isupper() else 0.3  # as in a prefix of Irish
        at += 1
        if at >= 4 and foreign == at and _script(c) == "latin" and not _letter(after):
            cost += 0.3
        before = c
    return cost


def _tokens(text: str) -> list[str]:
    return _SPACE.split(text)


def _reread(token: str, read_as: str, written_in: str) -> str:
    """The token re-encoded and strictly decoded; unchanged where that fails. In UTF-8, single sequences may be taken."""
    table = _BYTES[read_as]
    try:
        return bytes([table[c] for c in token]).decode(written_in)
    except (KeyError, UnicodeDecodeError):
        if written_in != "utf-8":
            return token

    def one(m: re.Match[str]) -> str:
        try:
            return bytes([table[c] for c in m[0]]).decode()
        except UnicodeDecodeError:
            return m[0]

    return _SEQUENCES[read_as].sub(one, token)


def _stays_text(old: str, new: str) -> bool:
    """Whether no letter became a sign that is no quotation mark, dash or sign set beside words."""
    return len(old) == len(new) and all(not a.isalpha() or b.isalpha() or b in _TEXT_MARKS for a, b in zip(old, new, strict=True))


def _is_dash(text: str, token: str) -> bool:
    return len(token) == 1 and any(token in m[0] for m in _DASH_STUMP.finditer(text))


def _keeps_case(token: str) -> bool:
    """Whether no capital of the rarer Latin letters follows a small letter, as in chance readings."""
    return not any(a.islower() and b.isupper() and b >= "\u0180" for a, b in zip(token, token[1:], strict=False))


class Repairer:
    """Finds and takes off layers of wrong decoding; ``size`` gives the tokens of a text under a public tokenizer."""

    def __init__(self, size: Callable[[str], int]) -> None:
        self.size = lru_cache(maxsize=_KEPT)(size)
        self.costs: dict[str, float] = {}
        self.others: dict[tuple[str, str, str], tuple[int, float, str, bool] | None] = {}

    def _gain(self, old: str, new: str) -> int:
        return self.size(" " + old.translate(_PLAIN)) - self.size(" " + new.translate(_PLAIN))

    def _sure(self, old: str, new: str, read_as: str) -> bool:
        """Whether a token is UTF-8 read as ``read_as`` beyond doubt: it needs fewer tokens, and by more than one unless its
        sequences are of the kind that begins no written word, as a word in capitals may look like one sequence. Sequences
        of three bytes don't come by chance; the tokenizer knows some of them from the texts it was made from."""
        if not _keeps_case(new):
            return False
        gain = self._gain(old, new)
        if gain >= 2:
            return True
        found = [m[0] for m in _SEQUENCES[read_as].finditer(old)]
        if gain >= 0 and any(len(x) > 2 for x in found) and (gain or read_as != "mac_roman"):
            return True
        return gain == 1 and read_as not in _CYRILLIC and any(_BYTES[read_as][x[0]] in (0xC2, 0xC3) for x in found)

    def cost(self, text: str) -> float:
        """The garbling cost of a text: that of its tokens' form, or 1 for each token that is misread UTF-8 if that is more."""
        out = 0.0
        for t in _tokens(text):
            if not t.isascii():
                known = self.costs.get(t)
                if known is None:
                    if len(self.costs) > _KEPT:
                        self.costs.clear()
                    known = self.costs[t] = max(_cost(t), self._misread(t))
                out += known
        return out + self._stumps(text)

    def _misread(self, token: str) -> float:
        for read_as in READ_AS:
            if _SEQUENCES[read_as].search(token):
                new = _reread(token, read_as, "utf-8")
                if new != token and self._sure(token, new, read_as):
                    return 1.0
        return 0.0

    def _stump(self, token: str) -> bool:
        """Whether the token has a letter in place of an English mark, and needs fewer tokens with the mark."""
        m = _STUMP.search(token)
        if not m:
            return False
        at = m.start(m.lastindex)
        gain = self._gain(token, f"{token[:at]}{'\'""'[m.lastindex - 1]}{token[at + 1 :]}")
        # a common word with its ending, as in don't or the keeper's, may need no token less
        return gain > 0 or gain == 0 and m.lastindex == 1 and token[:1].islower()

    def _stumps(self, text: str) -> float:
        if not _MAY_STUMP.search(text) or len(_ENGLISH.findall(text)) < 2:
            return 0.0
        odd = [t for t in _tokens(text) if not t.isascii()]
        dashes = len(_DASH_STUMP.findall(text)) if len({t for t in odd if len(t) == 1 and t.isalpha()}) == 1 else 0  # not letters that are spoken of
        return float(dashes + len(_PAIR_STUMP.findall(text)) + sum(self._stump(t) for t in odd))

    def _other(self, old: str, read_as: str, written_in: str) -> tuple[int, float, str, bool] | None:
        """(tokens saved, drop of the form's cost, other reading, whether it is beyond doubt) of a token; None if it can't be read so."""
        key = old, read_as, written_in
        if key not in self.others:
            if len(self.others) > _KEPT:
                self.others.clear()
            new, found = _reread(old, read_as, written_in), None
            if new != old and (_keeps_case(new) if written_in == "utf-8" else _stays_text(old, new) and _form(new) <= _form(old)):
                gain, drop = self._gain(old, new), _form(old) - _form(new)
                found = gain, drop, new, self._sure(old, new, read_as) if written_in == "utf-8" else gain >= 1 and drop > 0 or gain >= 0 and drop >= 1
            self.others[key] = found
        return self.others[key]

    def layer(self, text: str, cost: float) -> tuple[str, float] | None:
        """The text with one layer taken off and its cost, by the pair of encodings that leaves fewest tokens; None if none helps.

        Tokens that a pair makes shorter are taken, and those it makes no longer if it shortens most of what it changes, as
        short words need one token either way.
        """
        tokens = _tokens(text)
        odd = [i for i, t in enumerate(tokens) if not t.isascii()]
        best: tuple[float, str, bool] | None = None
        plain = 0  # tokens that are UTF-8 beyond doubt
        for written_in in WRITTEN_IN:
            if 2 * plain > len(odd):
                break
            for read_as in READ_AS:
                if read_as == written_in:
                    continue
                gains: dict[int, tuple[int, float, str]] = {}
                sure = 0
                for i in odd:
                    if (found := self._other(tokens[i], read_as, written_in)) is None:
                        continue
                    gain, drop, new, safe = found
                    if written_in != "utf-8" and drop < 1 and any(b in _TEXT_MARKS and b != a for a, b in zip(tokens[i], new, strict=True)) and (self._stump(tokens[i]) or _is_dash(text, tokens[i])):
                        drop += 1
                        safe = gain >= 0
                    gains[i] = gain, drop, new
                    sure += safe
                if written_in == "utf-8":
                    plain = max(plain, sure)
                if not sure:
                    continue
                more, less = sum(g > 0 for g, _, _ in gains.values()), sum(g < 0 for g, _, _ in gains.values())
                least = 0 if more > 2 * less or written_in == "utf-8" else 1
                used = {i: new for i, (g, d, new) in gains.items() if g >= least or g >= 0 and d >= 1}
                gain, held = sum(gains[i][0] for i in used), sum(self.size(" " + tokens[i].translate(_PLAIN)) for i in used)
                drop = sum(gains[i][1] for i in used)
                if gain < FEWER * held and (gain < 0 or drop < 1) or gain + drop <= 0:
                    continue
                if best is None or gain + drop > best[0]:
                    best = gain + drop, "".join(used.get(i, t) for i, t in enumerate(tokens)), written_in == "utf-8" and gain >= 2 * FEWER * held
        if best is None:
            return None
        now = self.cost(best[1])
        # the layer under one of UTF-8 may be as garbled still
        return (best[1], now) if now <= cost - TRY or best[2] else None

    def repair(self, text: str | None) -> tuple[bool, str | None, int]:
        """(garbled, text restored as far as can be, layers taken off)."""
        if not text or text.isascii():
            return False, text, 0
        cost = self.cost(text)
        now, left, layers = text, cost, 0
        while layers < LAYERS and left >= TRY and (step := self.layer(now, left)):
            now, left, layers = *step, layers + 1
        if layers and left > (1 - DROP) * cost:
            now, layers = text, 0
        return layers > 0 or cost >= LEFT, now, layers


_loaded: dict[int, Repairer] = {}


def repairer(data: bytes, pattern: str = PATTERN) -> Repairer:
    """A ``Repairer`` by the tokenizer with these ranks, kept for the next call."""
    key = hash((data, pattern))
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encoding = tiktoken.Encoding("judge", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[key] = Repairer(lambda text: len(encoding.encode_ordinary(text)))
    return _loaded[key]


def beyond_ascii(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has characters beyond ASCII; no other can be garbled."""
    return rows.where(F.octet_length(text) > F.length(text))


def repair_encoding(rows: DataFrame, key: str = "line_no", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, garbled, restored, layers): each row's text with wrong decoding undone.

    A text's tokens are re-encoded in an encoding it may have been read with and strictly decoded in one it may have been
    written in; of the pairs, that which leaves fewest tokens under a public multilingual tokenizer is kept if the garbling
    cost drops, and the result is tried again. ``garbled`` also holds for text whose cost stays high with nothing to undo,
    such as lost characters.

    Null and empty texts are not garbled and stay as they are; very long texts are taken whole; repeated rows give the same
    result; an empty table gives no rows; other columns are dropped. One pass without a shuffle. The driver reads the
    tokenizer's ranks, under 1 MB whatever the data, and broadcasts them.
    """
    with open(model, "rb") as f:
        ranks = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = repairer(ranks.value).repair
        for batch in batches:
            out = [repair(t) for t in batch["text_"]]
            yield pd.DataFrame({key: batch[key], "garbled": [r[0] for r in out], "restored": [r[1] for r in out], "layers": [r[2] for r in out]})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, garbled boolean, restored string, layers int"
    return rows.select(key, F.col(text).alias("text_")).mapInPandas(run, schema)
