"""Text to token arrays, as Column expressions.

An analyzer is a function ``Column -> Column`` that turns a text column into an
array of terms.  Everything stays in the row, so document lengths, token caps and
content keys need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from neartag.functions.stem import stem_array

# The usual English stop-word list of text search.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

# Patterns work on lower-cased text.
WORD_PATTERN = r"[\p{L}\p{N}]+"
URL_PATTERN = r"(?:https?|ftp)://[^\s<>\"]*[\p{L}\p{N}/]|www\.[^\s<>\"]*[\p{L}\p{N}/]"
EMAIL_PATTERN = r"[a-z0-9._%+\-]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+"
URL_EMAIL_WORD_PATTERN = f"{URL_PATTERN}|{EMAIL_PATTERN}|{WORD_PATTERN}"

Analyzer = Callable[[Column], Column]


def pattern_tokens(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in the lower-cased text; null text gives no tokens."""
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def drop_tokens(tokens: Column, stop_words: Iterable[str] = STOP_WORDS,
                max_length: int = 0) -> Column:
    """Leave out stop words and, on request, tokens longer than ``max_length``."""
    words = list(stop_words)

    def keep(token: Column) -> Column:
        ok = F.lit(True) if not words else ~token.isin(words)
        return ok & (F.length(token) <= max_length) if max_length > 0 else ok

    return F.filter(tokens, keep)


def standard(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without stop words."""
    return drop_tokens(pattern_tokens(text, WORD_PATTERN))


def url_email(text: Column) -> Column:
    """Like ``standard``, but a URL or an e-mail address is one token."""
    return drop_tokens(pattern_tokens(text, URL_EMAIL_WORD_PATTERN))


def url_email_porter(text: Column) -> Column:
    """``url_email`` tokens, stemmed."""
    return stem_array(url_email(text))


def make_url_email_porter(stop_words: Iterable[str] = STOP_WORDS,
                          max_length: int = 0) -> Analyzer:
    """The stemming analyzer with the caller's stop words and length limit."""
    words = tuple(stop_words)
    return lambda text: stem_array(
        drop_tokens(pattern_tokens(text, URL_EMAIL_WORD_PATTERN), words, max_length))


ANALYZERS: dict[str, Analyzer] = {
    "standard": standard,
    "url_email": url_email,
    "url_email_porter": url_email_porter,
}


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    """Make a user-defined analyzer available by name."""
    ANALYZERS[name] = analyzer


def get_analyzer(analyzer: str | Analyzer) -> Analyzer:
    """Look an analyzer up by name; a function passes through."""
    if callable(analyzer):
        return analyzer
    try:
        return ANALYZERS[analyzer]
    except KeyError:
        raise ValueError(f"unknown analyzer {analyzer!r}; known: {sorted(ANALYZERS)}") from None
