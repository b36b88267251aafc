import sqlite3

import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as tx
from heliograph.operators.lexical import TRUST, analysed, lexical, postings, updated_postings
from heliograph.schema import Mode

COLUMNS = "id long, name string, tags string, ocr string, notes string"


def items(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)
    return df.withColumn("search_name", tx.search_name("name"))


def found(spark, rows, query, mode=Mode.TEXT):
    out = lexical(items(spark, rows), query, mode)
    return None if out is None else {r.id: r for r in out.collect()}


NAMES = [(f"{n}.png", "", "", "") for n in ("red_sword_01", "red_shield", "blue_sword", "sword_red")]


@pytest.mark.parametrize(("query", "n"), [("red sword", 2), ('"red sword"', 1), ("swo*", 3), ("red helmet", 0), ("red OR sword", 0), ('red" sword', 2), ("red') sword", 2)])
def test_words_phrases_and_prefixes(spark, query, n):
    assert len(found(spark, NAMES, query)) == n


@pytest.mark.parametrize(("query", "hit"), [("fire sword", True), ("xml icon 02", True), ('"fire sword"', True), ("swor*", True), ("XMLFireSwordIcon02", True), ("fire potion", False)])
def test_identifiers(spark, query, hit):
    assert bool(found(spark, [("XMLFireSwordIcon02.png", "", "", "")], query)) == hit


def test_accents(spark):
    assert found(spark, [("ÉpéeBleue12.png", "", "", "")], "epee bleue 12")
    assert found(spark, [("a.png", "", "", "Café résumé")], "cafe")
    assert found(spark, [("a.png", "", "", "Café")], "café")
    assert not found(spark, [("a.png", "", "", "replaced")], "cafe")


@pytest.mark.parametrize(("name", "out"), [("XMLFireSwordIcon02.png", "XML Fire Sword Icon 02.png"), ("red_sword.png", ""), ("Sword02", "Sword 02"), ("", "")])
def test_search_name(spark, name, out):
    assert spark.createDataFrame([(name,)], "n string").select(tx.search_name("n")).head()[0] == out


def test_parse_query():
    t = tx.Term
    assert tx.parse_query('The "Red-Sword!" swo* of cat') == [t(("red", "sword")), t(("swo",), True), t(("cat",))]
    assert tx.parse_query("the of", keep_stop_words=True) == [t(("the",)), t(("of",))]
    assert tx.parse_query("the of") == tx.parse_query("") == tx.parse_query('"--" ""') == []
    assert len(tx.parse_query(" ".join(f"w{i}" for i in range(50)))) == 32
    assert tx.parse_query('"open phrase') == [t(("open",)), t(("phrase",))]


def test_trusted_evidence(spark):
    rows = [("RedSwordIcon.png", "", "", ""), ("1.png", "red sword", "", ""), ("2.png", "", "red sword", ""), ("3.png", "", "", "red sword"), ("4.png", "red", "", "sword")]
    out = found(spark, rows, "red sword")
    assert {i for i, r in out.items() if r.trusted} == {0, 3}
    assert all((r.lexical >= TRUST) == r.trusted for r in out.values())
    assert max(r.lexical - TRUST * r.trusted for r in out.values()) == pytest.approx(0.20)


def test_bm25_against_sqlite(spark):
    import random

    rng = random.Random(1)
    words = "red blue sword shield the of fire icon plate good".split()
    rows = [tuple(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(4)) for _ in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, search_name, tags, ocr, notes, tokenize='unicode61 remove_diacritics 2')")
    for i, r in enumerate(rows):
        con.execute("INSERT INTO t(rowid, name, search_name, tags, ocr, notes) VALUES (?, ?, '', ?, ?, ?)", (i, *r))
    for query, expression in [("red sword", '"red" AND "sword"'), ('"red blue"', '"red blue"'), ("sh*", '"sh"*'), ("the the fire", '"the" AND "the" AND "fire"')]:
        want = dict(con.execute("SELECT rowid, -bm25(t, 8.0, 8.0, 0.25, 2.0, 6.0) FROM t WHERE t MATCH ?", (expression,)))
        got = {i: r.relevance for i, r in found(spark, rows, query).items()}
        assert got == pytest.approx(want, abs=1e-9) and want


def test_no_terms(spark):
    assert found(spark, NAMES, "the", Mode.HYBRID) is None


def test_incremental_postings(spark):
    old = items(spark, NAMES)
    new = old.filter("id <> 1").withColumn("notes", F.when(F.col("id") == 2, F.lit("a new note")).otherwise(F.col("notes")))
    step = updated_postings(postings(old), new, old.filter("id in (1, 2)").select("id"))
    assert sorted(map(str, step.collect())) == sorted(map(str, postings(new).collect()))


def test_no_python_in_lexical_plans(spark):
    assert "Python" not in analysed(items(spark, NAMES))._jdf.queryExecution().toString()


def test_decomposed_names(spark):
    import unicodedata

    names = ["ÉpéeBleue12.png", "MüllerÄpfelÜ3b.PNG", "naïveCafé", "plain_name"]
    rows = [(n, unicodedata.normalize("NFD", n)) for n in names]
    out = spark.createDataFrame(rows, "c string, d string").select("c", tx.composed("d").alias("n"), tx.search_name("c").alias("x"), tx.search_name("d").alias("y"), tx.search_name(tx.composed("d")).alias("z")).collect()
    for r in out:
        assert r.n == r.c and r.z == r.x and unicodedata.normalize("NFC", r.y) == r.x
    assert out[0].x == "Épée Bleue 12.png"
