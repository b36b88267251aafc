import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heliograph.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if grams[words[i], words[i + 1], words[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(nasty, nasty_rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.clean_lines(nasty).collect())
    assert got == Counter((r[0], *counts(r[1])) for r in nasty_rows)


@pytest.mark.parametrize("text", ["a a a a", "a b c a b c a", "x y z x y z", "a b\x1cc\x0bd", "\n\n", "é é é é\né é é é", "a b c d a b c"])
def test_repeated_words(spark, text):
    row = qr.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == counts(text)


def test_sorted_windows_agree_with_packed_ones(spark):
    """A narrow packing makes positions collide, so the exact way is taken."""
    text = " ".join("abcab"[i % 5] + str(i % 7) for i in range(90))
    df = spark.createDataFrame([(text,)], "text string")
    bits, qr.POSITION_BITS = qr.POSITION_BITS, 6
    try:
        got = df.select(qr.repeated_words(qr.word_array(F.col("text")))).head()[0]
    finally:
        qr.POSITION_BITS = bits
    assert got == counts(text)[4]


LINES = [" ".join(f"w{(i * 97 + k * 31) % 89}x{i}" for k in range(12)) + "." for i in range(12)]


@pytest.mark.parametrize(
    ("bad", "gone"),
    [("Home | About | Contact", True), ("NEXT PAGE", True), ("All rights reserved 2020.", True), ("Read more", True), ("word*** other$$$ more%%% the&&& last###", True), ("WORDS!! AND!! MORE!! OF!! THEM!!", True), (LINES[0], True), ("He asked: why?", False), ("A longer line without a stop keeps its place in the text", False)],
)
def test_lines(spark, bad, gone):
    df = spark.createDataFrame([(1, "\n".join([*LINES, bad]))], "doc_id long, text string")
    row = qr.clean_lines(df).head()
    assert row.kept
    assert (row.cleaned_text.split("\n") == LINES) == gone


@pytest.mark.parametrize("line", ["See our Cookie Policy.", "This site USES COOKIES.", "Privacy Policy", "Terms and Conditions apply to all.", "© 2020 Somebody and others too.", "Copyright 2020 by all of them.", "Lorem ipsum dolor sit amet now.", "Please enable JavaScript to go on.", "Released under the MIT License.", "Subscribe to our newsletter today, friends.", "This page is powered by Magic"])
def test_boilerplate_holds_a_cue(spark, line):
    assert re.search(qr.BOILERPLATE, line) and any(c in line.lower() for c in qr.CUES)
    row = qr.clean_lines(spark.createDataFrame([(1, "\n".join([*LINES, line]))], "doc_id long, text string")).head()
    assert row.cleaned_text.split("\n") == LINES


@pytest.mark.parametrize("mark", ["", *qr.MARKS])
def test_closed_from_the_end(spark, mark):
    ends = ["", " ", "\t\x0b \f\r", "\"", "')”", "]」 ", "» x", " )", "a", mark + "a"]
    lines = [head + mark + end for head in ("", "é w", "no. stop") for end in ends]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", qr._closed(F.col("line")).alias("closed")).collect():
        assert r.closed == bool(re.search(qr.CLOSED, r.line)), repr(r.line)


OTHERS = [
    "Alle Rechte vorbehalten, 2021, Beispiel GmbH.", "Wir verwenden Cookies, um diese Seite besser zu machen.", "Bitte lesen Sie unsere Datenschutzerklärung und die Nutzungsbedingungen.", "Jetzt unseren Newsletter abonnieren und nichts verpassen.",
    "Tous droits réservés, 2021, la société.", "Ce site utilise des cookies pour mesurer son audience.", "Voir notre POLITIQUE DE CONFIDENTIALITÉ pour en savoir plus.", "Abonnez-vous à notre newsletter dès maintenant, merci.", "Consultez les conditions générales de vente ici, merci.",
    "Todos los derechos reservados, 2021, la empresa.", "Este sitio utiliza cookies para mejorar la experiencia.", "Lea nuestra Política de Privacidad antes de seguir, gracias.", "Aplican los TÉRMINOS Y CONDICIONES de este sitio.", "Suscríbete a nuestro boletín para no perderte nada.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0, as said.",
]
MENUS = ["Startseite | Über uns | Kontakt | Impressum | Datenschutz.", "Zurück – Weiter – Nach oben – Teilen – Drucken.", "Accueil · À propos · Contactez-nous · Plan du site · Mentions légales.", "Précédent Suivant Retour en haut Partager Imprimer.", "Inicio / Quiénes somos / Contacto / Aviso legal / Buscar.", "Iniciar sesión, Registrarse, Menú, Ayuda, Síguenos."]


@pytest.mark.parametrize("k", range(2))
def test_other_languages(spark, k):
    lines = (OTHERS, MENUS)[k]
    rows = [(i, "\n".join([*LINES, x])) for i, x in enumerate(lines)]
    for r in qr.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.cleaned_text.split("\n") == LINES, lines[r.doc_id]
    if not k:
        assert all(re.search(qr.BOILERPLATE, x) and any(c in x.lower() for c in qr.CUES) for x in lines)


@pytest.mark.parametrize("line", ["春天的河水慢慢流过古老的石桥孩子们在岸边放风筝", "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำ", "これは長い日本語の文で句点がない", "Menüs und Datenschutz in der alten Stadt", "El menú del día es bueno y barato", "La conférence commence demain à Paris, au calme."])
def test_lines_that_stay(spark, line):
    row = qr.clean_lines(spark.createDataFrame([(1, "\n".join([*LINES, line, "短い行", "目次"]))], "doc_id long, text string")).head()
    assert row.cleaned_text.split("\n") == [*LINES, line]


def test_a_text_without_spaces_keeps_its_lines(spark):
    lines = [f"第{i}行的文字没有空格也没有句号但是足够长" for i in range(40)]
    row = qr.clean_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).head()
    assert row.cleaned_text.split("\n") == lines and row.base_failed  # 40 words by the base count


def test_verdict(spark):
    junk = [" ".join(f"w{i}{k}***" for k in range(12)) + "." for i in range(9)]
    df = spark.createDataFrame([(1, "\n".join(LINES)), (2, "\n".join(LINES[:8] + junk)), (3, "few words")], "doc_id long, text string")
    assert {r.doc_id: (r.base_failed, r.kept) for r in qr.clean_lines(df).collect()} == {1: (False, True), 2: (False, False), 3: (True, False)}


def test_empty_and_native(nothing, nasty):
    assert qr.clean_lines(nothing).collect() == []
    assert "Python" not in qr.clean_lines(nasty)._jdf.queryExecution().toString()
    assert "tag" in qr.clean_lines(nasty, keep=("tag",)).columns


@pytest.mark.parametrize("unit", ["home ", "read more \u00b7 ", "contacto, Zurück-"])
def test_long_lines_of_menu_words(spark, unit):
    """A megabyte of links on one line is a line of navigation, with and without a word that is none."""
    many = unit * (1_000_000 // len(unit))
    rows = [(1, "\n".join([*LINES, many])), (2, "\n".join([*LINES, many + "unlike any of the words above it is."]))]
    got = {r.doc_id: r for r in qr.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].cleaned_text.split("\n") == LINES
    assert len(got[2].cleaned_text) > 900_000


def test_both_patterns_agree(spark):
    """The pattern for Java says what the one for RE2 says, over strings of links, halves of links, and separators."""
    import random

    import duckdb

    rng = random.Random(4)
    words = "home menu search searchs contact contacto contactez-nous contact us us about back back to top top log in login sign up weiter weiterlesen zurück nach oben über uns menü menüs accueil à propos volver arriba volver más leer más rss homepage x next".split(" ")
    rows = [("".join(rng.choice([" ", " | ", "-", "", "/", "é"]) + rng.choice(words) for _ in range(rng.randrange(1, 6))),) for _ in range(4000)]
    got = spark.createDataFrame(rows, "x string").select("x", F.col("x").rlike(qr.NAVIGATION_KEPT).alias("y")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", rows)
    want = dict(con.execute("SELECT x, regexp_matches(x, ?) FROM t", [qr.NAVIGATION]).fetchall())
    assert 100 < sum(r.y for r in got) and [(r.x, r.y) for r in got if r.y != want[r.x]] == []
