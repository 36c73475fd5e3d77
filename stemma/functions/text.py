"""Text normalisation as Column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.numeric import let

# Whitespace removed at both ends of a text: all there is, by rule.
WHITESPACE = "".join(chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace())

# One sign of whitespace, and a run, in a regular expression; the four separators are not in the class itself.
SPACE = "[\\s\\x1c-\\x1f]"
SPACES = f"(?U){SPACE}+"

# Accented letters and their plain forms in place keys.
PLACE_KEY_ACCENTS = "àáâäãåèéêëìíîïòóôöùúûüçñ"
PLACE_KEY_PLAIN = "aaaaaaeeeeiiiioooouuuucn"

# Punctuation turned into a space in surnames.
SURNAME_PUNCTUATION = "[’'·.\\-]"

SLUG_LENGTH = 120

# Where the common Latin letters end.
_COMMON_END = 0x180
# Hangul syllables decompose by arithmetic: first and last syllable, first letters, and how many follow.
_HANGUL, _HANGUL_END = 0xAC00, 0xD7A3
_LEAD, _VOWEL, _TAIL = 0x1100, 0x1161, 0x11A7
_PER_LEAD, _PER_VOWEL = 588, 28


def _code_points() -> range | list[int]:
    """All code points beyond ASCII that can be in a text, without the Hangul syllables."""
    skip = (range(_HANGUL, _HANGUL_END + 1), range(0xD800, 0xE000))
    return [code for code in range(0x80, sys.maxunicode + 1) if not any(code in r for r in skip)]


Mapping = tuple[str, str, tuple[tuple[str, str], ...]]


def _mapping(rule, codes) -> Mapping:
    """The one-to-one part of a rule on single characters, as two texts, and the list of its longer results."""
    single, several = [], []
    for code in codes:
        char = chr(code)
        plain = rule(char)
        if plain != char and len(plain) == 1:
            single.append((char, plain))
        elif plain != char and plain:
            several.append((char, plain))
    return "".join(a for a, _ in single), "".join(b for _, b in single), tuple(several)


def _plain(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@functools.cache
def _fold_table() -> tuple[Mapping, Mapping]:
    """What compatibility decomposition without combining marks does to common letters, and to all others."""
    codes = _code_points()
    return _mapping(_plain, [c for c in codes if c < _COMMON_END]), _mapping(_plain, [c for c in codes if c >= _COMMON_END])


@functools.cache
def _casefold_table() -> Mapping:
    """What case folding does beyond lower case."""
    return _mapping(lambda char: char.casefold() if char.lower() == char else char, _code_points())


def _class(codes: list[int]) -> str:
    """Regular-expression class of code points."""
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


@functools.cache
def _combining_class() -> str:
    """Regular-expression class of what folding leaves nothing of: combining marks and compositions of them."""
    return _class([code for code in _code_points() if not _plain(chr(code))])


def _replaced(value: Column, several: tuple[tuple[str, str], ...]) -> Column:
    """Each character of the list replaced by its longer text, where there is one."""
    listed = "\u0002".join(f"{a}\u0001{b}" for a, b in several)
    pairs = F.map_entries(F.str_to_map(F.lit(listed), F.lit("\u0002"), F.lit("\u0001")))
    widened = F.aggregate(pairs, value, lambda acc, p: F.replace(acc, p["key"], p["value"]))
    return F.when(value.rlike(_class([ord(a) for a, _ in several])), widened).otherwise(value)


def _hangul_letters(text: Column) -> Column:
    """Hangul syllables as their letters."""

    def sign(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def letters(char: Column) -> Column:
        code = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("bigint") - _HANGUL
        tail = code % _PER_VOWEL
        return F.concat(
            sign(F.floor(code / _PER_LEAD) + _LEAD),
            sign(F.floor(code % _PER_LEAD / _PER_VOWEL) + _VOWEL),
            F.when(tail > 0, sign(tail + _TAIL)).otherwise(F.lit("")),
        )

    syllable = f"^[\\x{{{_HANGUL:x}}}-\\x{{{_HANGUL_END:x}}}]$"
    spread = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(syllable), letters(c)).otherwise(c))
    return F.when(text.rlike(syllable[1:-1]), F.array_join(spread, "")).otherwise(text)


def strip(text: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """NULL for the empty text."""
    return F.nullif(text, F.lit(""))


def has_text(text: Column) -> Column:
    """True for a non-empty, non-NULL text."""
    return F.coalesce(text != "", F.lit(False))


def remove_accents(text: Column) -> Column:
    """Compatibility-decompose and drop combining marks; case is kept."""
    common, other = _fold_table()
    # Most texts need no more than the one-to-one map of common letters; a range tells the others.
    uncommon = f"[{''.join(a for a, _ in common[2])}\\x{{{_COMMON_END:x}}}-\\x{{10ffff}}]"

    def fold_rest(value: Column) -> Column:
        whole = _replaced(_hangul_letters(F.translate(value, other[0], other[1])), common[2] + other[2])
        return F.when(value.rlike(uncommon), F.regexp_replace(whole, _combining_class(), "")).otherwise(value)

    mapped = F.translate(text, common[0], common[1])
    return F.when(text.rlike("^\\p{ASCII}*$"), text).otherwise(let(mapped, fold_rest))


def casefold(text: Column) -> Column:
    """Case-folded form: lower case, and letters such as ``ß`` and final sigma as those they are equal to."""
    single_from, single_to, several = _casefold_table()
    special = _class([ord(c) for c in single_from] + [ord(a) for a, _ in several])

    def rest(lower: Column) -> Column:
        whole = _replaced(F.translate(lower, single_from, single_to), several)
        return F.when(lower.rlike(special), whole).otherwise(lower)

    return F.when(text.rlike("^\\p{ASCII}*$"), F.lower(text)).otherwise(let(F.lower(text), rest))


def fold(text: Column) -> Column:
    """Accent-free, lower-case, trimmed form used for comparison and grouping."""
    return strip(F.lower(remove_accents(text)))


def collapse_spaces(text: Column) -> Column:
    """Runs of whitespace become one space; a trailing comma is dropped."""
    single = F.regexp_replace(text, SPACES, " ")
    return strip(F.regexp_replace(single, "\\s*,\\s*$", ""))


def place_key(name: Column) -> Column:
    """Key under which import places are merged; NULL when nothing is left."""
    return blank_to_null(casefold(F.translate(collapse_spaces(name), PLACE_KEY_ACCENTS, PLACE_KEY_PLAIN)))


def name_key(name: Column) -> Column:
    """Key of a surname or given name: spaces collapsed, case folded, accents kept."""
    return F.coalesce(casefold(collapse_spaces(name)), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def title_given(given: Column) -> Column:
    """Capitalise each word that starts with a letter; blank texts stay as they are."""
    titled = F.array_join(
        F.transform(
            _words(given),
            lambda w: F.when(w.rlike("^\\p{L}"), _capitalise(w)).otherwise(w),
        ),
        " ",
    )
    return F.when(strip(given) == "", given).otherwise(titled)


def title_surname(surname: Column) -> Column:
    """Punctuation becomes a space and every token is capitalised; NULL when empty."""
    spaced = F.regexp_replace(surname, SURNAME_PUNCTUATION, " ")
    return blank_to_null(F.array_join(F.transform(_words(spaced), _capitalise), " "))


def dashed(text: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one dash; no dash at the ends."""
    return F.btrim(F.regexp_replace(text, "[^a-z0-9]+", "-"), F.lit("-"))


def slug(text: Column, max_length: int | None = SLUG_LENGTH) -> Column:
    """URL-friendly form of a text; NULL when empty."""
    value = dashed(F.lower(remove_accents(text)))
    if max_length is not None:
        value = F.substring(value, 1, max_length)
    return blank_to_null(value)


def search_name(given: Column, surname: Column) -> Column:
    """Given name and surname joined by a space, for full-text search."""
    return strip(F.concat_ws(" ", blank_to_null(given), blank_to_null(surname)))


def letters_key(word: Column) -> Column:
    """Accent-free lower-case letters a-z only; NULL when none is left."""
    return blank_to_null(F.regexp_replace(F.lower(remove_accents(word)), "[^a-z]", ""))


# Consonant classes of the phonetic codes; any other letter is 0.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODES = "01230120022455012623010202"


def _phonetic_code(letters: Column) -> Column:
    """First letter in upper case and class digits of a lower-case letter text, four characters in all.

    Equal neighbouring digits count once, also across the first letter; a
    letter without a class separates them.
    """
    coded = F.regexp_replace(F.translate(letters, _LETTERS, _CODES), "[^0-9]", "0")
    runs = F.regexp_replace(coded, "(.)\\1+", "$1")
    digits = F.replace(F.substr(runs, F.lit(2)), F.lit("0"), F.lit(""))
    return F.substring(F.concat(F.upper(F.substring(letters, 1, 1)), digits, F.lit("000")), 1, 4)


def soundex(word: Column) -> Column:
    """Four-character phonetic code over the letters a-z; NULL when there is none."""
    return _phonetic_code(letters_key(word))


def phonetic_key(name: Column) -> Column:
    """Phonetic code that also keeps letters beyond a-z; empty when there is none."""
    letters = F.regexp_replace(fold(F.coalesce(name, F.lit(""))), "[^\\p{L}]", "")
    return F.when(letters == "", F.lit("")).otherwise(_phonetic_code(letters))
