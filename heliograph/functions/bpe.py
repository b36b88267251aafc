"""Byte-level BPE with word ends: text to a fixed number of token ids."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

START, END, LENGTH = 49_406, 49_407, 77
#: the split before the merges (fixed value)
PATTERN = r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """A printable letter for every byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else extra))
        extra += b not in printable
    return out


class Tokenizer:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        import regex

        self.vocabulary = vocabulary
        self.ranks = {tuple(m): k for k, m in enumerate(merges)}
        self.letters = byte_letters()
        self.split = regex.compile(PATTERN)
        self.pieces = lru_cache(8192)(self._pieces)

    def _pieces(self, word: str) -> tuple[str, ...]:
        """The word's parts after all merges, lowest rank first."""
        parts = [*word[:-1], word[-1] + "</w>"]
        while len(parts) > 1:
            pairs = list(zip(parts, parts[1:], strict=False))
            best = min(pairs, key=lambda p: self.ranks.get(p, len(self.ranks)))
            if best not in self.ranks:
                break
            joined, i = [], 0
            while i < len(parts):
                here = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                joined.append(parts[i] + parts[i + 1] if here else parts[i])
                i += 2 if here else 1
            parts = joined
        return tuple(parts)

    def encode(self, text: str) -> list[int]:
        text = " ".join(unicodedata.normalize("NFC", text).split()).lower()
        special = {"<|startoftext|>": START, "<|endoftext|>": END}
        ids = [START]
        for m in self.split.finditer(text):
            if len(ids) >= LENGTH - 1:
                break
            word = m[0]
            if word in special:
                ids.append(special[word])
            else:
                ids += [self.vocabulary.get(p, END) for p in self.pieces("".join(self.letters[b] for b in word.encode()))]
        ids = ids[: LENGTH - 1]
        return ids + [END] * (LENGTH - len(ids))


def attention_mask(ids: list[int]) -> list[int]:
    """1 up to and with the first end token."""
    end = ids.index(END)
    return [1] * (end + 1) + [0] * (len(ids) - end - 1)


def token_ids(spark: SparkSession, text: Column, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> Column:
    """array<bigint> of LENGTH ids; the vocabulary, of fixed size, is broadcast."""
    shared = spark.sparkContext.broadcast((vocabulary, merges))
    cache: dict = {}

    @F.pandas_udf("array<bigint>")
    def encode(values: pd.Series) -> pd.Series:
        if "t" not in cache:
            cache["t"] = Tokenizer(*shared.value)
        return values.map(lambda x: None if x is None else cache["t"].encode(x))

    return encode(text)
