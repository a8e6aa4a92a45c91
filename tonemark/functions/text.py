"""Text columns: the three normalisers, tone and spelling folds, tags, buckets, counts.

Everything except Unicode composition is a built-in expression. Spark has no NFC function, so
``nfc`` ships only the strings that could change to an Arrow UDF and leaves the others in the JVM.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Combining grave, acute, hook above, tilde, dot below (the five Vietnamese tones).
TONE_MARKS = "̣̀́̉̃"
# Typographic punctuation that counts next to ASCII punctuation.
EXTRA_PUNCTUATION = "…“”‘’–—"
PUNCTUATION = string.punctuation + EXTRA_PUNCTUATION
PUNCT_CLASS = "[!-/:-@\\[-`{-~" + EXTRA_PUNCTUATION + "]"
# What counts as white space, and the white space a transcript must not hold.
SPACE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
ODD_SPACE_CLASS = "[\\t\\r\\n\\x{a0}\\x{200b}\\x{200c}]"
# The lower-case alphabet of a transcript, loan letters and space included.
ALPHABET = (
    "aăâbcdđeêghiklmnoôơpqrstuưvxyfjwz"
    "àáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ "
)
# Duration buckets in seconds, lower bound inclusive, upper exclusive.
BUCKETS = {"short": (0.0, 3.0), "medium": (3.0, 10.0), "long": (10.0, 30.0)}

# Java tests the parts of a character class one after another, so on long texts the form of a class
# decides the run time. These put the common case first: a look-ahead that turns ordinary
# characters away at once, or a positive class that starts with the printable ASCII range.
_PLAIN_AHEAD = "(?![!-~])"
SPACES = f"{_PLAIN_AHEAD}[{SPACE}]+"
NON_SPACE = (
    "[!-~\\x{0}-\\x{8}\\x{e}-\\x{1b}\\x{7f}-\\x{84}\\x{86}-\\x{9f}\\x{a1}-\\x{167f}"
    "\\x{1681}-\\x{1fff}\\x{200b}-\\x{2027}\\x{202a}-\\x{202e}\\x{2030}-\\x{205e}"
    "\\x{2060}-\\x{2fff}\\x{3001}-\\x{10ffff}]"
)
# Only these can be in a string that is not composed: everything but Latin up to the spacing
# modifiers, precomposed Vietnamese, and general punctuation. Such strings go to the UDF, but for
# those of which only Cyrillic letters, which stand alone in composition, are among these.
_MAYBE_UNCOMPOSED = "[\\x{300}-\\x{1e9f}\\x{1efa}-\\x{200f}\\x{2028}-\\x{10ffff}]"
_SUSPECT = _MAYBE_UNCOMPOSED + "(?<![\\x{400}-\\x{482}\\x{48a}-\\x{52f}])"
# These too can hold a mark in lower case: a capital I with a dot becomes two characters.
_MAYBE_MARKED = _SUSPECT.replace("[", "[\\x{130}", 1)
# What separates words, but for a single space before a word, which is already what it becomes.
_BETWEEN_WORDS = "(?![a-z])(?! [\\p{L}\\p{N}_])[^\\p{L}\\p{N}_]+"
# Lower-case letters that stand alone in composition, digits and _; a text of these in words parted by
# single spaces is in scoring form.
_SETTLED = "[a-z0-9_[\\p{Ll}&&[\\x{df}-\\x{2af}\\x{430}-\\x{45f}\\x{1ea0}-\\x{1ef9}]]]"
_UNSETTLED = f"(?s)(?! ?[a-z])(?! ?{_SETTLED})."
_NOT_WORD_BEFORE = "(?<![\\p{L}\\p{N}_])"
_NOT_WORD_AFTER = "(?![\\p{L}\\p{N}_])"


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition."""
    suspect = text.rlike(_SUSPECT)
    return F.when(suspect, _compose(F.when(suspect, text))).otherwise(text)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def is_blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return ~F.coalesce(text.rlike(NON_SPACE), F.lit(False))


def has_words(text: Column) -> Column:
    """Whether the scoring form holds any word: composition, case and lost marks make and unmake none."""
    return F.coalesce(text.rlike("[\\p{L}\\p{N}_]"), F.lit(False))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def word_count(text: Column) -> Column:
    """TXT8: words separated by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_SPACE}+")), F.lit(0)).cast("bigint")


@lru_cache
def tone_table() -> tuple[str, str]:
    """Every precomposed character that carries a tone mark, and the same character without it."""
    carriers, plain = [], []
    for point in range(0x80, 0x10000):
        char = chr(point)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) < 2 or not any(mark in parts for mark in TONE_MARKS):
            continue
        rest = unicodedata.normalize("NFC", "".join(c for c in parts if c not in TONE_MARKS))
        if len(rest) == 1 and unicodedata.normalize("NFC", char) == char:
            carriers.append(char)
            plain.append(rest)
    return "".join(carriers), "".join(plain)


def _drop_tones(composed: Column) -> Column:
    carriers, plain = tone_table()
    # characters of the first string without a partner in the second are deleted
    return F.translate(composed, carriers + TONE_MARKS, plain)


def strip_tone(text: Column) -> Column:
    """TXT2: drop the five tone marks, keep circumflex, breve, horn and đ."""
    return nfc(_drop_tones(nfc(text)))


def normalize(text: Column, keep_tone: bool = True, fold: bool = False) -> Column:
    """TXT1: scoring form. Null gives the empty string."""
    given = F.coalesce(text, F.lit(""))
    bare = F.when(given.rlike(_MAYBE_MARKED), F.regexp_replace(F.lower(nfc(given)), "\\p{Mn}+", ""))
    words = F.trim(F.regexp_replace(bare.otherwise(F.lower(given)), _BETWEEN_WORDS, " "))
    # transcripts often come in scoring form, and one look costs less than making it
    words = F.when(given.rlike(_UNSETTLED) | given.startswith(" "), words).otherwise(given)
    return refine(words, keep_tone, fold)


def refine(words: Column, keep_tone: bool = True, fold: bool = False) -> Column:
    """Text in scoring form without its tones, or in one spelling."""
    if not keep_tone:
        words = _drop_tones(words)
    # as the element of an array, so that it is made once however often the fold looks at it
    return F.transform(F.array(words), fold_spelling)[0] if fold else words


def _with_tone(letter: str, mark: str) -> str:
    return unicodedata.normalize("NFC", letter + mark)


def _moves() -> dict[str, str]:
    """Vowel pairs with the tone on the first letter, and the same with it on the second."""
    pairs = (("o", "a"), ("o", "e"), ("u", "y"), ("o", "ê"), ("o", "â"), ("o", "ă"))
    return {_with_tone(a, mark) + b: a + _with_tone(b, mark) for a, b in pairs for mark in TONE_MARKS}


def _lookup(entries: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for entry in entries.items() for x in entry]), key)


def fold_spelling(text: Column) -> Column:
    """TXT3: one form for accepted spelling variants. Takes text already in scoring form."""
    moves = _moves()
    # one look finds the pairs that occur; only these are replaced, and no move makes a new pair
    pairs = F.array_distinct(F.regexp_extract_all(text, F.lit("[òóỏõọ][aeêâă]|[ùúủũụ]y"), F.lit(0)))
    moved = F.aggregate(pairs, text, lambda done, pair: F.replace(done, pair, _lookup(moves, pair)))

    # likewise for a y that ends a short word; one that gets its tone by a move is rare
    letters = {_with_tone("y", mark): _with_tone("i", mark) for mark in ("", *TONE_MARKS)}
    every = "[" + "".join(letters) + "]"

    def short_end(letter: Column) -> Column:
        return F.concat(letter, F.lit(f"(?<={_NOT_WORD_BEFORE}(?:qu|[hklmst])"), letter, F.lit(f"){_NOT_WORD_AFTER}"))

    ends = F.array_distinct(F.regexp_extract_all(text, short_end(F.lit(every)), F.lit(0)))
    ends = F.when(text.rlike("q[ùúủũụ]y"), F.array(*map(F.lit, letters))).otherwise(ends)
    return F.aggregate(ends, moved, lambda done, y: F.regexp_replace(done, short_end(y), _lookup(letters, y)))


def match_key(text: Column) -> Column:
    """TXT4: form for finding equal texts; punctuation is deleted, not turned into a space."""
    lowered = F.lower(nfc(F.coalesce(text, F.lit(""))))
    return collapse_space(F.regexp_replace(lowered, f"(?![a-z ]){PUNCT_CLASS}", ""))


def ingest_form(text: Column) -> Column:
    """TXT5: trimmed and composed, case and punctuation kept."""
    return nfc(strip(text))


# A capitalised word that starts no sentence, and letters of loan words.
NAME_PATTERN = f"(?<![.!?][{SPACE}])(?<!^){_NOT_WORD_BEFORE}[A-ZĐÂĂÊÔƠƯ][a-zà-ỹđ]+"
LOAN_LETTERS = "[fjwzFJWZ]"


def content_tags(text: Column) -> Column:
    """TXT6: digits, proper_name, loanword, in this order."""
    tags = F.array(
        F.when(text.rlike("\\p{Nd}"), F.lit("digits")),
        F.when(text.rlike(NAME_PATTERN), F.lit("proper_name")),
        F.when(text.rlike(LOAN_LETTERS), F.lit("loanword")),
    )
    return F.array_compact(tags)


def duration_bucket(seconds: Column, bounds: dict[str, tuple[float, float]] = BUCKETS) -> Column:
    """TXT7: bucket name, null outside all buckets."""
    return F.coalesce(
        *[F.when((seconds >= lo) & (seconds < hi), F.lit(name)) for name, (lo, hi) in bounds.items()]
    )


def clip_id(prefix: str, offset: Column) -> Column:
    """TXT9: deterministic id from a source offset."""
    return F.format_string(prefix + "-r%04d", offset)


def clip_offset(path: Column) -> Column:
    """TXT9: the offset back from a clip file name, null when the name has another shape."""
    digits = F.regexp_extract(path, "r(\\d+)\\.wav$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def preview(text: Column, length: int = 60) -> Column:
    """TXT10."""
    return F.substring(text, 1, length)


def repair_for_training(text: Column) -> Column:
    """TXT11: the only repairs a training text may get: composition, case, white space."""
    spaced = F.regexp_replace(F.lower(nfc(text)), f"{_PLAIN_AHEAD}[{SPACE}\\x{{200b}}\\x{{200c}}]+", " ")
    return F.trim(spaced)


def shown(value: Column, places: int = 4) -> Column:
    """TXT12: rounding of reported numbers, half to even."""
    return F.bround(value, places)


@lru_cache
def digit_class() -> str:
    """Body of a character class with every character that has a digit value."""
    spans: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if chr(point).isdigit():
            if spans and spans[-1][1] == point - 1:
                spans[-1][1] = point
            else:
                spans.append([point, point])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in spans)


def outside_alphabet_class() -> str:
    """Characters a lower-case transcript must not hold."""
    return f"[^{ALPHABET}{PUNCT_CLASS[1:-1]}{digit_class()}]"


def outside_alphabet() -> str:
    """The same as a pattern, with the ASCII characters that may occur turned away first."""
    common = "".join(f"\\{c}" for c in string.punctuation) + string.ascii_lowercase + string.digits
    return f"(?![{common} ]){outside_alphabet_class()}"
