"""Fill-in-the-middle: texts cut into prefix, middle and suffix, put in another order between marks.

The tokenizers library's Split pre-tokenizer, which needs no training, isolates
every line; its code-point offsets give the number of lines and the places to cut at,
so a document is three slices of its text.  Two numbers of a digest of the
document's id choose the lines, two more whether and how the parts are moved:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text, where it is empty, holds a mark itself, or is left out by the rate

``restored`` takes the text back from the marks alone.

Defined cases: a null text is empty, an empty text has 0 lines and is plain; a
null id has the digest of no digits; rows with one id are cut by the same
numbers; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a line with its end, or the rest of a text without one
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = "7", 100, 50
#: an output batch is handed on once it holds so many characters
FLUSH = 4_000_000
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form, prefix_chars and middle_chars (null if plain), and output of every document.

    rate: hundredths of the documents that are cut; spm_rate: hundredths of those whose suffix comes first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        lines = pre_tokenizers.Split(Regex(LINE), behavior="isolated")

        def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
            ends = [0, *(end for _, (_, end) in lines.pre_tokenize_str(text))]
            n = len(ends) - 1
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
                return n, "plain", None, None, text
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            prefix, middle, suffix = text[: ends[low]], text[ends[low] : ends[high]], text[ends[high] :]
            spm = h4 % 100 < spm_rate
            head = (SUFFIX, suffix, PREFIX, prefix) if spm else (PREFIX, prefix, SUFFIX, suffix)
            return n, "spm" if spm else "psm", len(prefix), len(middle), "".join((*head, MIDDLE, middle))

        for b in batches:
            ids, texts, *numbers = b.columns
            numbers = [x.to_pylist() for x in numbers]
            first, held, out = 0, 0, []
            for k, text in enumerate(texts):
                out.append(one(text.as_py() or "", *(x[k] for x in numbers)))
                held += len(out[-1][-1])
                if held > FLUSH or k == b.num_rows - 1:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids[first : k + 1], *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    first, held, out = k + 1, 0, []

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *draws(F.col(id_col), seed))
    return rows.mapInArrow(cut, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form.  A cut text holds no mark of its own, so its marks part it into three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    join = lambda *order: F.concat(*(F.element_at(parts, k) for k in order))
    return F.when(form == "psm", join(2, 4, 3)).when(form == "spm", join(3, 4, 2)).otherwise(output)
