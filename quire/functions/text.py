"""Text normalisation and matching as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F

# Spacing accents and the combining marks they stand for, ligatures, and the spelling
# pairs unified in words of four letters or more.
SPACING_ACCENTS = {"´": "́", "`": "̀", "ˆ": "̂", "˜": "̃", "¨": "̈",
                   "¸": "̧", "ˇ": "̌"}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
SPELLING = [("cc", "c"), ("ct", "t"), ("pc", "c"), ("pt", "t")]

_RICH = "[^\\x00-\\x5F\\x61-\\x7F]"  # anything beyond ASCII, or a backtick


_LOOSE = "[" + "".join(SPACING_ACCENTS) + "".join(LIGATURES) + "]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility folding of the basic plane, from the Unicode database: one-to-one
    replacements, marks to drop, and characters that unfold to several."""
    source, target, marks, several = [], [], [], {}
    for point in range(0x80, 0x10000):
        if 0xAC00 <= point < 0xE000:  # Hangul syllables unfold by rule to letters; surrogates
            continue
        ch = chr(point)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch)
                       if not unicodedata.combining(c))
        if base == ch or not base:
            continue
        if len(base) == 1:
            source.append(ch)
            target.append(base)
        else:
            several[ch] = base
    return "".join(source), "".join(target), "".join(marks), several


def _char_class(chars: list[str]) -> str:
    points = sorted(ord(c) for c in chars)
    out, start, prev = [], points[0], points[0]
    for p in [*points[1:], None]:
        if p is not None and p == prev + 1:
            prev = p
            continue
        out.append(f"\\u{start:04x}" if start == prev else f"\\u{start:04x}-\\u{prev:04x}")
        if p is not None:
            start = prev = p
    # almost every character fails the first, cheap test
    return "[\\u00bc-\\u00be\\u0132-\\uffff&&[" + "".join(out) + "]]"


def _unfold(value: Column, raw: Column) -> Column:
    """Compatibility folding of `value`; `raw` only guards the rare many-letter characters."""
    source, target, marks, several = _fold_tables()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    letters = F.transform(F.split(value, ""), lambda ch: F.coalesce(table[ch], ch))
    wide = F.when(raw.rlike(_char_class(list(several))), F.array_join(letters, "")).otherwise(value)
    return F.translate(wide, source + marks, target)


def strip_accents(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.rlike("[^\\x00-\\x7F]"), _unfold(c, c)).otherwise(c)


def _join_spacing(value: Column) -> Column:
    """Loose accents become combining marks on the following letter; ligatures are undone."""
    for lig, letters in LIGATURES.items():
        value = F.replace(value, F.lit(lig), F.lit(letters))
    value = F.regexp_replace(value, "([´ˆ˜¨¸ˇ])\\s?ı", "$1i")
    for accent, mark in SPACING_ACCENTS.items():
        letter = "([aeiouAEIOU])" if accent == "`" else "\\s?([A-Za-z])"
        value = F.regexp_replace(value, accent + letter, "$1" + mark)
    return value


def fix_spacing_accents(c: Column | str) -> Column:
    """"Inform´atica" to "Informática": loose accents joined and composed, ligatures undone."""
    c = _col(c)
    value = _join_spacing(c)
    for mark in SPACING_ACCENTS.values():
        pairs = {}
        for point in [*range(0x41, 0x5B), *range(0x61, 0x7B)]:
            composed = unicodedata.normalize("NFC", chr(point) + mark)
            if len(composed) == 1:
                pairs[chr(point)] = composed
        pieces = F.split(value, f"(?=[{''.join(pairs)}]{mark})")
        value = F.array_join(F.transform(pieces, lambda p: F.when(
            F.substring(p, 2, 1) == mark,
            F.concat(F.translate(F.substring(p, 1, 1), "".join(pairs), "".join(pairs.values())),
                     F.substr(p, F.lit(3)))).otherwise(p)), "")
    return F.when(c.rlike(_LOOSE), value).otherwise(c)


def normalize(c: Column | str) -> Column:
    """The matching form of a text: lower-case words of a-z and digits, one space apart.

    The guards look at the raw text only, so that each text pays for the steps it needs.
    """
    c = _col(c)
    camel = "(?<=[a-z])(?=[A-Z](?![\\u0300-\\u036f]))"
    joined = F.when(c.rlike(_LOOSE), _join_spacing(c)).otherwise(c)
    rich = _unfold(F.regexp_replace(joined, camel, " "), c)
    plain = F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")
    value = F.regexp_replace(F.lower(F.when(c.rlike(_RICH), rich).otherwise(plain)),
                             "[^a-z0-9]+", " ")
    edges = F.regexp_replace(value, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    value = F.when(c.rlike("[0-9\\u00b2-\\u00be\\u2070-\\uffff]"), edges).otherwise(value)
    # words of up to three letters keep their spelling: a marker parts the pair for a moment
    value = F.regexp_replace(
        value, "([cp])(?<![a-z0-9][cp])([ct][a-z])(?![a-z0-9])", "$1\u0001$2")
    value = F.regexp_replace(
        value, "([cp])(?<=(?:^|[^a-z0-9])[a-z]?[cp])([ct])(?![a-z0-9])", "$1\u0001$2")
    for old, new in SPELLING:
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.trim(F.replace(value, F.lit("\u0001"), F.lit("")))


def words(norm: Column | str) -> Column:
    """Words of a normalised text (none for the empty text)."""
    return F.array_remove(F.split(_col(norm), " "), "")


def word_count(norm: Column | str) -> Column:
    return F.regexp_count(_col(norm), F.lit("[^ ]+"))


def search_tokens(c: Column | str) -> Column:
    """Letters-and-digits tokens of the original text, folded to lower case without accents."""
    folded = F.lower(strip_accents(_col(c)))
    return F.filter(F.split(folded, "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def slugify(c: Column | str, max_length: int = 60) -> Column:
    value = F.regexp_replace(F.lower(strip_accents(_col(c))), "[^a-z0-9]+", "-")
    value = F.regexp_replace(value, "^-+|-+$", "")
    value = F.regexp_replace(F.substring(value, 1, max_length), "-+$", "")
    return F.when(value == "", F.lit("sem-nome")).otherwise(value)


def contains_phrase(haystack: Column | str, needle: Column | str) -> Column:
    """`needle` occurs in `haystack` as whole words (both normalised)."""
    h, n = _col(haystack), _col(needle)
    return (n != "") & F.contains(F.concat(F.lit(" "), h, F.lit(" ")),
                                  F.concat(F.lit(" "), n, F.lit(" ")))


# Numbers of course series (roman, and one arabic digit) and the words that turn a
# number into an ordinal.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
ORDINAL_WORDS = ["o", "a", "ano", "anos", "semestre", "sem", "trimestre", "ciclo"]


def _series_value(word: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(r) for r in ROMAN]), word).cast("int")
    return F.when(position > 0, position).when(word.rlike("^[1-9]$"), word.try_cast("int"))


def series_number(norm: Column | str) -> Column:
    """"analise matematica ii" is 2; a single word has no number."""
    norm = _col(norm)
    return F.when(F.contains(norm, F.lit(" ")), _series_value(F.substring_index(norm, " ", -1)))


def roman(number: Column) -> Column:
    table = F.array(*[F.lit(r.upper()) for r in ROMAN])
    return F.when(number.between(1, 10), F.element_at(table, number.cast("int"))).otherwise(
        number.cast("string"))


def numbers_after(haystack: Column | str, needle: Column | str) -> Column:
    """For every occurrence of `needle` as whole words, the series number right after it (null if
    the next word is no number or the number is an ordinal)."""
    h, n = _col(haystack), _col(needle)
    # words stand two spaces apart here, so neighbouring occurrences do not share a space
    wide = F.replace(n, F.lit(" "), F.lit("  "))
    padded = F.concat(F.lit(" "), F.replace(h, F.lit(" "), F.lit("  ")), F.lit(" "))
    pieces = F.split(F.replace(padded, F.concat(F.lit(" "), wide, F.lit(" ")), F.lit(" \u0002 ")),
                     "\u0002")
    last = F.size(pieces) - 1

    def number(piece: Column, i: Column) -> Column:
        # the text after one occurrence goes on with the next occurrence
        rest = F.when(i < last, F.concat_ws("  ", F.nullif(F.trim(piece), F.lit("")), wide)
                      ).otherwise(F.trim(piece))
        parts = F.split(rest, "  ")
        ordinal = F.coalesce(F.get(parts, F.lit(1)).isin(ORDINAL_WORDS), F.lit(False))
        return F.when(~ordinal, _series_value(F.get(parts, F.lit(0))))

    numbers = F.transform(pieces, number)
    return F.slice(numbers, F.lit(2), F.greatest(last, F.lit(0)))


def sequel_after(haystack: Column | str, needle: Column | str) -> Column:
    found = F.filter(numbers_after(haystack, needle), lambda x: x >= 2)
    return F.get(found, F.lit(0))


def contains_unit_phrase(haystack: Column | str, needle: Column | str) -> Column:
    """Containment for course names: numbered courses are different courses."""
    h, n = _col(haystack), _col(needle)
    own = series_number(n)
    base = F.regexp_replace(n, " [^ ]*$", "")
    plain = F.exists(numbers_after(h, n), lambda x: x.isNull() | (x < 2))
    glued = (~F.contains(base, F.lit(" "))) & (F.length(base) <= 8) & (
        contains_phrase(h, F.concat(base, F.lower(roman(own))))
        | contains_phrase(h, F.concat(base, own.cast("string"))))
    numbered = F.exists(numbers_after(h, base), lambda x: x == own)
    return F.when(own.isNull(), plain).otherwise(
        F.coalesce(numbered, F.lit(False)) | F.coalesce(glued, F.lit(False)))


def clean_text(c: Column | str) -> Column:
    value = F.regexp_replace(_col(c), "\r\n|\r", "\n")
    value = F.replace(value, F.lit("\u0000"), F.lit(""))
    value = F.regexp_replace(value, "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(value, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


# Characters that speak of formulas.
MATH_CHARS = "=+−-×÷*/^_{}()[]|<>≤≥≠≈∫∑∏√∞∂∇αβγδεθλμπσφωΔΣΩ0123456789"


def looks_mathematical(c: Column | str) -> Column:
    compact = F.regexp_replace(_col(c), "\\s+", "")
    rest = F.translate(compact, MATH_CHARS, "")
    dense = (F.length(compact) - F.length(rest)) / F.length(compact) > 0.35
    return F.when(F.length(compact) < 40, F.lit(False)).otherwise(dense)


def snippet_around(text: Column, start: Column, end: Column, margin: int = 40) -> Column:
    """The passage between two 0-based positions with a margin, on one line."""
    first = F.greatest(start - margin, F.lit(0))
    cut = F.substr(text, first + 1, end + margin - first)
    return F.trim(F.regexp_replace(cut, "\\s+", " "))


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), "\\s+", " "))


def nfc(c: Column | str) -> Column:
    """Canonical composition: letters and their accents as one character where there is one."""
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(composed, "string")(_col(c))


# White space of all scripts.
ANY_SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+"


def text_digest(c: Column | str) -> Column:
    """Digest of a passage, blind to spaces and line breaks of any script and to how accents are written."""
    return F.sha2(F.trim(F.regexp_replace(nfc(c), ANY_SPACE, " ")), 256)


def markdown_table(rows: Column) -> Column:
    """`array<array<string>>` to a table, the first row as the head."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def line(r: Column) -> Column:
        cells = F.transform(r, lambda v: F.replace(F.replace(v, F.lit("|"), F.lit("\\|")),
                                                   F.lit("\n"), F.lit(" ")))
        cells = F.concat(cells, F.array_repeat(F.lit(""), width - F.size(r)))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    lines = F.transform(rows, line)
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""))
    body = F.concat(F.slice(lines, 1, 1), F.array(rule),
                    F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size(rows) > 0, F.array_join(body, "\n")).otherwise(F.lit(""))


def _respaced(text: str) -> str:
    """`_join_spacing` of a text that has left Spark."""
    for lig, letters in LIGATURES.items():
        text = text.replace(lig, letters)
    text = re.sub("([´ˆ˜¨¸ˇ])\\s?ı", "\\1i", text, flags=re.ASCII)
    for accent, mark in SPACING_ACCENTS.items():
        letter = "([aeiouAEIOU])" if accent == "`" else "\\s?([A-Za-z])"
        text = re.sub(accent + letter, "\\1" + mark, text, flags=re.ASCII)
    return text


@cache
def _word_tables() -> tuple[dict, bytes, frozenset[bytes]]:
    """The compatibility folding of characters, the one of bytes that leaves letters and digits, and the words that are
    too short for a change of spelling."""
    source, target, marks, several = _fold_tables()
    fold = str.maketrans(source, target, marks) | str.maketrans(several)
    flat = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
    letters = ["", *"abcdefghijklmnopqrstuvwxyz"]
    short = frozenset((a + pair + b).encode() for pair, _ in SPELLING for a in letters for b in letters if not (a and b))
    return fold, flat, short


def word_list(text: str) -> list[bytes]:
    """`words(normalize(text))` for functions over Arrow batches."""
    fold, flat, short = _word_tables()
    if re.search(_LOOSE, text):
        text = _respaced(text)
    text = re.sub("([a-z])(?=[A-Z](?![\u0300-\u036f]))", "\\1 ", text)
    if not text.isascii():
        text = re.sub("[^\x00-\x7f]+", lambda found: found[0].translate(fold), text)
    value = text.lower().encode("ascii", "replace").translate(flat)
    value = re.sub(b"[0-9]+", b" \\g<0> ", value)
    spelled = value
    for old, new in SPELLING:
        spelled = spelled.replace(old.encode(), new.encode())
    if len(spelled) == len(value):
        return value.split()
    before, after = value.split(), spelled.split()
    return after if short.isdisjoint(before) else [w if len(w) < 4 else v for w, v in zip(before, after)]
