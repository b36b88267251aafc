"""Token counts: an exact histogram of encoded lengths.

Texts are encoded whole by a byte-level BPE; documents are then aggregated by
length, and running sums over the histogram answer, for every context limit,
the documents and tokens within it, the total when longer documents are cut to
it, and the quantile that it is.  A limit between two lengths has the counts of
the shorter; ``answer`` gives any limit.

Defined cases: a null or empty text has length 0; runs of white space may have any length; equal lengths share a row;
repeated rows count each time; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: the split before the merges that the rank files go with (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: characters that the pattern's \\s takes (fixed values), and the shortest run of them that is taken out of a text before the pattern is tried
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 1000
_long_run = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")

_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    """A tiktoken encoding; kept for the life of a worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _encoders:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encoders[key]


def text_length(enc, text: str) -> int:
    """Tokens of a text.  The pattern's look-ahead costs a stack frame a character of white space, so long runs are cut out by its own rule:
    all but the last character of a run are one piece, and all of it at a text's end."""
    n, start = 0, 0
    for run in _long_run.finditer(text):
        stop = run.end() - (run.end() < len(text))
        n += len(enc.encode_ordinary(text[start : run.start()])) + len(enc._encode_single_piece(text[run.start() : stop]))
        start = stop
    return n + len(enc.encode_ordinary(text[start:]))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every document.  The rank file (about 1 MB) is read by the driver and broadcast."""
    with open(f"{tokenizers}/{ranks}", "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches:
            n = [text_length(enc, t) if t else 0 for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lengths, "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """A row per length that occurs.

    n_docs, n_tokens: of that length; docs_within, tokens_within: of that length
    or less; truncated_total: tokens when every document is cut to that length;
    quantile: share of documents of that length or less.  The window runs over
    distinct lengths, already aggregated, of which there are far fewer than documents.
    """
    by_length = counts.groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    upto = Window.orderBy("context_limit").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = by_length.select(
        "context_limit",
        "n_docs",
        "n_tokens",
        F.sum("n_docs").over(upto).alias("docs_within"),
        F.sum("n_tokens").over(upto).alias("tokens_within"),
        (F.sum("n_docs").over(everything) - F.sum("n_docs").over(upto)).alias("docs_longer"),
        (F.sum("n_tokens").over(everything) - F.sum("n_tokens").over(upto)).alias("tokens_longer"),
    )
    return summed.select(
        "*",
        (F.col("tokens_within") + F.col("docs_longer") * F.col("context_limit")).alias("truncated_total"),
        (F.col("docs_within") / (F.col("docs_within") + F.col("docs_longer"))).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Documents within each asked limit and the truncated total, from the histogram alone: one aggregation."""
    sums = []
    for x in sorted(set(limits)):
        within = F.sum(F.when(F.col("context_limit") <= x, F.col("n_docs")).otherwise(0)).alias("docs_within")
        total = F.sum(F.least(F.col("context_limit"), F.lit(x).cast("long")) * F.col("n_docs")).alias("truncated_total")
        sums.append(F.struct(F.lit(x).cast("long").alias("context_limit"), within, total))
    return histogram.agg(F.array(*sums).alias("answers")).select(F.inline("answers"))
