"""Text analysis: folding, tokens, identifiers and the query language.

Everything on the data side is a SQL expression; the query is parsed on the
driver, where it is a constant of the plan.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: words that carry no meaning in a descriptive query (fixed values)
STOP_WORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "and", "with", "photo", "image")
MOST_TERMS = 32
TOKEN = r"[\p{L}\p{N}]+"
#: combining marks belong to the letter before them, so a decomposed name is cut as the composed one (look-behind needs a limit)
_M = r"\p{M}{0,8}"
BOUNDARY = rf"(?<=[\p{{Ll}}\p{{N}}]{_M})(?=\p{{Lu}})|(?<=\p{{Lu}}{_M})(?=\p{{Lu}}{_M}\p{{Ll}})|(?<=\p{{L}}{_M})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})"


def _fold_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter and marks, and that letter."""
    source, target = [], []
    for c in map(chr, range(0xC0, 0x10000)):
        if 0xAC00 <= ord(c) <= 0xD7A3 or 0xD800 <= ord(c) <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", c)
        bare = [x for x in parts if not unicodedata.category(x).startswith("M")]
        if len(parts) > 1 and len(bare) == 1 and unicodedata.category(bare[0])[0] in "LN":
            source.append(c)
            target.append(bare[0])
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: Column | str) -> Column:
    """Lower case without diacritics, precomposed or combining; ASCII texts, known by their length, need no table."""
    low = F.lower(_c(text))
    return F.when(F.octet_length(_c(text)) == F.length(_c(text)), low).otherwise(F.regexp_replace(F.translate(low, FOLD_FROM, FOLD_TO), r"\p{M}+", ""))


def tokens(text: Column | str) -> Column:
    """The folded tokens of a text, in order (null: none)."""
    return F.regexp_extract_all(fold(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def composed(text: Column | str) -> Column:
    """The text in Unicode normalisation form C.  SQL has no word for it; names that are ASCII, as nearly all, are only looked at."""

    @F.arrow_udf("string")
    def nfc(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return nfc(_c(text))


def search_name(name: Column | str) -> Column:
    """The readable words of an identifier, or '' where nothing would change.  A save composes the name first."""
    spaced = F.regexp_replace(_c(name), BOUNDARY, " ")
    return F.when(spaced == _c(name), F.lit("")).otherwise(spaced)


def simplified(text: Column | str) -> Column:
    """White space inside collapsed to one space, and none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def suffix(name: Column | str) -> Column:
    """What follows the last dot ('' without a dot)."""
    return F.regexp_extract(_c(name), r"\.([^.]*)$", 1)


def stem(name: Column | str) -> Column:
    """What precedes the last dot (all of it without a dot)."""
    return F.regexp_replace(_c(name), r"\.[^.]*$", "")


@dataclass(frozen=True)
class Term:
    """One word, or a phrase of several; a prefix matches tokens that start with it."""

    words: tuple[str, ...]
    prefix: bool = False


def _fold_word(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.category(c).startswith("M"))


def _is_token(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def parse_query(text: str, keep_stop_words: bool = False) -> list[Term]:
    """Terms of a query: quoted phrases, words, and words with a star for prefixes.

    Operators, brackets and stray quotes are data between words.  Stop words go
    unless kept; they stay inside phrases.
    """
    text, out, i = text.lower(), [], 0
    while i < len(text) and len(out) < MOST_TERMS:
        if text[i] == '"':
            end = text.find('"', i + 1)
            if end > i + 1:
                words = re.split(r"\s+", "".join(c if _is_token(c) else " " for c in text[i + 1 : end]).strip())
                words = tuple(x for x in map(_fold_word, words) if x)
                if words:
                    out.append(Term(words))
                i = end + 1
                continue
        if _is_token(text[i]):
            end = i
            while end < len(text) and (_is_token(text[end])):
                end += 1
            word, star = text[i:end], end < len(text) and text[end] == "*"
            if keep_stop_words or word not in STOP_WORDS:
                out.append(Term((_fold_word(word),), star))
            i = end + star
            continue
        i += 1
    return out


def parsed(queries: Column | str, keep_stop_words: bool = False) -> Column:
    """The terms of a column of queries as texts: the words of a phrase with spaces, a star behind a prefix."""

    @F.arrow_udf("array<string>")
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [" ".join(x.words) + "*" * x.prefix for x in parse_query(t, keep_stop_words)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return parse(_c(queries))


def query_tokens(text: Column | str) -> Column:
    """The words of a column of queries, in lower case (phrases and stars aside)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda x: ~x.isin(*STOP_WORDS))


def hits(column_tokens: Column, term: Term) -> Column:
    """How often a term occurs in a token array."""
    first = term.words[0]
    if len(term.words) == 1:
        match = (lambda x: x.startswith(first)) if term.prefix else (lambda x: x == first)
        return F.size(F.filter(column_tokens, match))
    if not term.prefix:
        # the words that follow are looked up by place: a slice would copy the whole array each time
        def here(x: Column, i: Column) -> Column:
            found = x == first
            for k, word in enumerate(term.words[1:], 1):
                found = found & F.coalesce(F.get(column_tokens, i + k) == word, F.lit(False))
            return found

        return F.size(F.filter(column_tokens, here))
    raise ValueError("a phrase has no prefix form")
