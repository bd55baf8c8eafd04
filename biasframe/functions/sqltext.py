"""The text functions written as DuckDB/ANSI SQL text, for oracle queries.
They mirror ``biasframe.functions.text`` one to one."""

from __future__ import annotations

from biasframe.functions import text as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def emoticons(t: str) -> str:
    for pattern, word in X.EMOTICON_RULES:
        t = f"regexp_replace({t}, {q(pattern)}, {q(word)}, 'g')"
    return t


def urls(t: str) -> str:
    return f"regexp_replace({t}, {q(X.URL_PATTERN)}, '', 'g')"


def whitespace(t: str) -> str:
    return f"trim(regexp_replace({t}, {q(X.WHITESPACE_CLASS + '+')}, ' ', 'g'))"


def negation(t: str) -> str:
    return f"replace({t}, {q(X.NEGATION[0])}, {q(X.NEGATION[1])})"


def special_chars(t: str) -> str:
    return f"translate({t}, {q(X.SPECIAL_CHARS)}, {q(' ' * len(X.SPECIAL_CHARS))})"


def numbers(t: str) -> str:
    return f"regexp_replace({t}, {q(X.NUMBER_PATTERN)}, '0', 'g')"


def clean(t: str) -> str:
    return numbers(special_chars(negation(whitespace(urls(emoticons(t))))))


def count_chars(t: str, chars: str) -> str:
    return f"(length({t}) - length(translate({t}, {q(chars)}, '')))"


def punctuation_count(t: str) -> str:
    return f"({count_chars(t, X.SPECIAL_CHARS)} + {count_chars(t, X.REPEATED_SPECIAL_CHARS)})"


def longest_run(t: str, ch: str) -> str:
    pat = "(" + ("\\" + ch if ch in ".*+?()[]{}|^$\\" else ch) + "+)"
    return f"coalesce(length(list_max(regexp_extract_all({t}, {q(pat)}, 1))), 0)"


def substring_count(t: str, w: str) -> str:
    return f"CAST(floor((length({t}) - length(replace({t}, {q(w)}, ''))) / {len(w)}) AS INTEGER)"


def word_count(t: str) -> str:
    s = whitespace(t)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE length({s}) - length(replace({s}, ' ', '')) + 1 END)"


def space_split_count(t: str) -> str:
    return f"(length({t}) - length(replace({t}, ' ', '')) + 1)"


def tokens(t: str) -> str:
    s = whitespace(t)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END)"
