"""Text cleaning (D1-D8) and text features (E1-E6) as native Column
expressions: no Python worker, everything inside whole-stage code.

Regex patterns are written so that Java (Spark) and RE2 (DuckDB) read them
the same way: whitespace is an explicit class equal to Python's ``str.split()``
set, because ``\\s`` is ASCII-only in Java and RE2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference) ---------------------------------
# Python's whitespace set (str.isspace), used by split() and by \s, written
# out for RE2 (the SQL oracle) ...
WHITESPACE_CLASS = ("[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
                    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
NON_WHITESPACE_CLASS = "[^" + WHITESPACE_CLASS[1:]
# ... and for Java: with the (?U) flag \s is Unicode White_Space, which is the
# same set without U+001C..U+001F. Java matches this form about 4-10x faster.
JAVA_WS = "[\\s\\x1c-\\x1f]"
JAVA_NON_WS = "[^\\s\\x1c-\\x1f]"
# The punctuation constant: 64 characters, 58 distinct. As written in the
# reference; the escape before "×" is not recognised and stays a backslash.
PUNCTUATION = "/-'?!.,#$%'()*+-/:;<=>@[\\]^_`{|}~`" + '""“”’' + "∞θ÷α•à−β∅³π‘₹´°£€\\×™√²—–&"
AGGRESSIVE_PUNCTUATION = "!*."
# Emoticon rules, applied in this order (``{ws}`` = one whitespace character).
EMOTICON_TEMPLATES = [
    ("(<3|:\\*)", " Love "),
    ("(;-?\\)|;-?D|\\(-?;)", " Wink "),
    ("(:{ws}?\\(|:-\\(|\\){ws}?:|\\)-:)", " Sad "),
]
NEGATION = ("n't", "not")
NUMBER_PATTERN = "[0-9]+"
# --- end of fixed values -----------------------------------------------------

EMOTICON_RULES = [(p.replace("{ws}", WHITESPACE_CLASS), w) for p, w in EMOTICON_TEMPLATES]   # RE2
URL_PATTERN = "http" + NON_WHITESPACE_CLASS + "+"                                          # RE2
_JAVA_EMOTICONS = [("(?U)" + p.replace("{ws}", JAVA_WS), w) for p, w in EMOTICON_TEMPLATES]
_JAVA_URL = "(?U)http" + JAVA_NON_WS + "+"


def _distinct(chars: str) -> str:
    seen: list[str] = []
    for ch in chars:
        if ch not in seen:
            seen.append(ch)
    return "".join(seen)


SPECIAL_CHARS = _distinct(PUNCTUATION)                        # 58 distinct
REPEATED_SPECIAL_CHARS = "".join(ch for ch in SPECIAL_CHARS if PUNCTUATION.count(ch) > 1)  # 6


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: Column | str) -> Column:
    """Missing text becomes the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def clean_emoticons(c: Column | str) -> Column:
    """D1."""
    t = _c(c)
    for pattern, word in _JAVA_EMOTICONS:
        t = F.regexp_replace(t, pattern, word)
    return t


def clean_urls(c: Column | str) -> Column:
    """Drop ``http`` up to the next whitespace."""
    return F.regexp_replace(_c(c), _JAVA_URL, "")


def collapse_whitespace(c: Column | str) -> Column:
    """D3: every whitespace run -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(c), "(?U)" + JAVA_WS + "+", " "))


def clean_negation(c: Column | str) -> Column:
    """``n't`` -> ``not`` (so ``don't`` -> ``donot``)."""
    return F.replace(_c(c), F.lit(NEGATION[0]), F.lit(NEGATION[1]))


def clean_special_chars(c: Column | str) -> Column:
    """Each of the 58 special characters -> one space."""
    return F.translate(_c(c), SPECIAL_CHARS, " " * len(SPECIAL_CHARS))


def clean_numbers(c: Column | str) -> Column:
    """Each digit run -> ``0``."""
    return F.regexp_replace(_c(c), NUMBER_PATTERN, "0")


def lower(c: Column | str) -> Column:
    """D8."""
    return F.lower(_c(c))


@dataclass(frozen=True)
class CleaningConfig:
    """D7 switches, in the order the steps run."""
    emoticons: bool = True
    urls: bool = True
    whitespace: bool = True
    negation: bool = True
    special_chars: bool = True
    numbers: bool = True


def clean(c: Column | str, config: CleaningConfig = CleaningConfig()) -> Column:
    """One column expression built from the switches (no UDF)."""
    t = _c(c)
    if config.emoticons:
        t = clean_emoticons(t)
    if config.urls:
        t = clean_urls(t)
    if config.whitespace:
        t = collapse_whitespace(t)
    if config.negation:
        t = clean_negation(t)
    if config.special_chars:
        t = clean_special_chars(t)
    if config.numbers:
        t = clean_numbers(t)
    return t


# ------------------------------------------------------------------- features
def count_chars(c: Column | str, chars: str) -> Column:
    """Occurrences of any character of ``chars`` (deleted-length difference)."""
    t = _c(c)
    return F.length(t) - F.length(F.translate(t, chars, ""))


def punctuation_count(c: Column | str) -> Column:
    """E1 (feature 0): sum over the 64-character constant of str.count, so the
    six repeated characters count twice."""
    return count_chars(c, SPECIAL_CHARS) + count_chars(c, REPEATED_SPECIAL_CHARS)


def longest_run(c: Column | str, ch: str) -> Column:
    """Length of the longest run of ``ch`` (0 when absent). The longest of
    the extracted runs is also their lexicographic maximum."""
    runs = F.regexp_extract_all(_c(c), F.lit("(" + _re_escape(ch) + "+)"), 1)
    return F.coalesce(F.length(F.array_max(runs)), F.lit(0))


def _re_escape(ch: str) -> str:
    return "\\" + ch if ch in ".*+?()[]{}|^$\\" else ch


def substring_count(c: Column | str, word: str, whole_word: bool = False) -> Column:
    """Non-overlapping, case-sensitive substring count (``male`` is
    found inside ``female``, as in the reference). ``whole_word=True`` counts
    only occurrences not inside a longer word (Unicode letters, digits, _)."""
    t = _c(c)
    if whole_word:
        return F.regexp_count(t, F.lit(f"(?U)(?<!\\w){_quote(word)}(?!\\w)"))
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def word_count(c: Column | str) -> Column:
    """E5 (feature 29): ``len(text.split())`` - the number of maximal
    non-whitespace runs. Each run with the whitespace around it becomes one
    character (possessive quantifiers: no backtracking), so the count is the
    length of a short string; no per-word strings are built."""
    t = F.coalesce(_c(c), F.lit(""))
    ws = JAVA_WS
    one_per_word = F.regexp_replace(t, f"(?U){ws}*+{JAVA_NON_WS}++{ws}*+", "w")
    return F.length(F.regexp_replace(one_per_word, f"(?U){ws}+", ""))


def space_split_count(c: Column | str) -> Column:
    """``len(text.split(' '))`` - empty pieces count."""
    t = _c(c)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1


def whitespace_tokens(c: Column | str) -> Column:
    """``text.split()`` as an array."""
    s = collapse_whitespace(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def _quote(w: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in w)


def contains_any_word(c: Column | str, words: list[str]) -> Column:
    """True when a lower-cased whitespace token is in a (small) word list:
    one regex search for a listed word between whitespace / text ends.
    For a large list use ``operators.features.flag_words`` (a join)."""
    alts = "|".join(_quote(w.lower()) for w in words)
    pattern = f"(?U)(?:^|{JAVA_WS})(?:{alts})(?={JAVA_WS}|$)"
    return F.coalesce(F.lower(_c(c)).rlike(pattern), F.lit(False))
