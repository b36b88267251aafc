import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from heliograph.llm import fill_middle as fm


def brute(doc_id, text, rate=fm.RATE, spm_rate=fm.SPM_RATE):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "\n", "\n\n\n", "a\nb", "a\nb\n", "é😀\nß x\r\nend\x85\x0c\n", "<P>", "a <M>\nb", "x<S", "<\n<\n<", "one\n" * 500, "P>\nS>\n<", "\r\n\r\n", "\x00\n\x00"]


def test_against_slices(spark):
    rows = [(k * 31 + j, t) for k, t in enumerate(TEXTS) for j in range(12)] + [(None, "no\nid\n"), (-5, "a\nb\nc"), (5, "tie\n"), (5, "tie\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    for rate, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        got = fm.transform(docs, rate, spm).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(brute(i, t, rate, spm) for i, t in rows)
        assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in fm.transform(docs).collect()} == {"plain", "psm", "spm"}


def test_documents(nasty, nasty_rows):
    got = fm.transform(nasty).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(r[0], r[1]) for r in nasty_rows)


def test_long_lines_and_many(spark):
    rows = [(1, "x" * 3_000_000), (2, "\n" * 300_000), (3, "ab\n" * 100_000 + "y" * 1_000_000)]
    got = fm.transform(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == {brute(*r) for r in rows}


def test_empty(nothing):
    assert fm.transform(nothing).collect() == []
