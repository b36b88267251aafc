"""Quality rules: line-first cleaning.

Each line of a text is held against rules on its own (punctuation, navigation,
boilerplate, repetition of an earlier line).  The words of navigation and boilerplate are those of the
corpus's languages; a line that many documents share is not held against them, as
copies of good documents share all their lines.  Lines that fail are removed; a
document that loses too large a share of its characters is rejected, as is one
that fails the base rules (too few words, or too many words in repeated
three-word windows).

Everything is a row-local expression of SQL functions: no shuffle, no Python.
``let`` binds a value to a lambda variable, so it is computed once.

Defined cases: a null or empty text has no words and fails the base rules; ties
and repeated rows are judged alike; no rows give no rows; other input columns
are dropped unless named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: characters whose large share marks a line as decoration, a table or shouting
NOISE = SYMBOLS + "!?=_~^{}[]\\@"
#: share of a line's visible characters that noise may have, beside a mark or so that any short line may end with
NOISE_SHARE, FREE_MARKS = 0.08, 1
#: a line without closing punctuation needs this many words, or letters of scripts that put no spaces between words
SHORT_LINE, SHORT_UNSPACED = 5, 10
#: Thai and Lao, Myanmar, Khmer, kana and Chinese characters (Java and RE2 read this alike)
UNSPACED = r"\x{0E01}-\x{0EDF}\x{1000}-\x{109F}\x{1780}-\x{17DD}\x{3041}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
LONG_UNSPACED = f"[{UNSPACED}](?:[^{UNSPACED}]*[{UNSPACED}]){{{SHORT_UNSPACED - 1}}}"
#: closing marks, what may follow them, and both as a pattern
MARKS, BEHIND = ".!?…:;。！？｡؟۔।॥။។", "\"'”’»)]」』"
CLOSED = r"[.!?…:;。！？｡؟۔।॥။។][\"'”’»)\]」』]*\s*$"
#: what a line of navigation is made of, in English, German, French and Spanish; letters beyond ASCII in both cases, as neither engine need fold them
_LINKS = (
    r"home|menu|search|log ?in|log ?out|sign ?(in|up|out)|register|contact( us)?|about( us)?|next|previous|back( to top)?|top|share|"
    r"subscribe|follow us|read more|show more|load more|click here|skip to content|sitemap|rss|faq|help|print|comments?|"
    r"startseite|men[üÜ]|suchen?|anmelden|abmelden|einloggen|registrieren|kontakt|[üÜ]ber uns|weiter(lesen)?|zur[üÜ]ck|nach oben|teilen|abonnieren|"
    r"folgen sie uns|mehr (lesen|anzeigen|laden)|hilfe|drucken|kommentare?|impressum|datenschutz|hier klicken|zum inhalt springen|"
    r"accueil|rechercher?|(se )?connecter|d?[éÉ]?connexion|s['’]inscrire|contactez-nous|[àÀ] propos|suivant|pr[éÉ]c[éÉ]dent|retour( en haut)?|haut de page|"
    r"partager|s['’]abonner|suivez-nous|lire la suite|en savoir plus|(voir|afficher) plus|plan du site|aide|imprimer|commentaires?|cliquez ici|aller au contenu|mentions l[éÉ]gales|"
    r"inicio|men[úÚ]|buscar|b[úÚ]squeda|(iniciar|cerrar) sesi[óÓ]n|registrarse|contacto|acerca de( nosotros)?|qui[éÉ]nes somos|siguiente|anterior|volver( arriba)?|arriba|"
    r"compartir|suscribirse|s[íÍ]guenos|(leer|ver|mostrar|cargar) m[áÁ]s|mapa del sitio|ayuda|imprimir|comentarios?|haga clic aqu[íÍ]|saltar al contenido|aviso legal"
)
NAVIGATION = rf"(?i)^\W*({_LINKS})(\W+({_LINKS}))*\W*$"
#: the same for Java, whose engine takes a stack frame for each turn of a group that may be given back; this one keeps what it has, as each link ends with its word
NAVIGATION_KEPT = rf"(?i)^\W*(?:{_LINKS})(?!\w)(?:\W+(?:{_LINKS})(?!\w))*+\W*$"
BOILERPLATE = (
    r"(?i)(\bcookie (policy|settings|notice)|\b(uses|accept( all)?) cookies\b|\bprivacy policy\b|\bterms (of|and) (use|service|conditions)\b|"
    r"\ball rights reserved\b|©|\bcopyright (\(c\)|\d{4})|\blorem ipsum\b|\benable javascript\b|\bjavascript is (disabled|required)\b|"
    r"\breleased under the .{1,40} licen[cs]e\b|\blicensed under (the )?(.{1,40}licen[cs]e\b|cc[ -])|\bsubscribe to our newsletter\b|\bpowered by \w+\s*$|"
    r"\balle rechte vorbehalten\b|\bverwende[nt] cookies\b|\bcookies? (akzeptieren|zulassen)\b|\bdatenschutz(erkl[äÄ]rung|bestimmungen)|\bnutzungsbedingungen\b|"
    r"\ballgemeine gesch[äÄ]ftsbedingungen\b|\b(unseren )?newsletter (abonnieren|bestellen)\b|\baktivieren sie javascript\b|"
    r"\btous droits r[éÉ]serv[éÉ]s|\butilis(e|ent|ons) des cookies\b|\baccepter (tous )?les cookies\b|\bpolitique de confidentialit[éÉ]|\bconditions (g[éÉ]n[éÉ]rales|d['’]utilisation)|"
    r"\babonnez-vous [àÀ] notre (newsletter|lettre)\b|\bactive[rz] javascript\b|"
    r"\btodos los derechos reservados\b|\b(utiliza|utilizamos|usa|usamos) cookies\b|\baceptar (todas )?las cookies\b|\bpol[íÍ]tica de (privacidad|cookies)\b|"
    r"\bt[éÉ]rminos (y condiciones|de uso|del servicio)\b|\bcondiciones (de uso|generales)\b|\bsuscr[íÍ]bete a nuestr[oa]\b|\bactiv[ae]r? javascript\b)"
)
#: in lower case; every match of BOILERPLATE holds one, so the pattern is tried on few lines
CUES = (
    "cookie", "privac", "terms ", "reserv", "vorbehalten", "©", "copyright", "lorem ipsum", "javascript", "released under", "licensed under", "newsletter", "powered by",
    "datenschutz", "bedingungen", "tous droits", "confidentialit", "conditions ", "abonnez", "rminos ", "condiciones ", "bete a nuestr",
)
#: share of its characters that a document may lose
LOSS = 0.4
LEAST_WORDS = 50
POSITION_BITS = 21


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _class(chars: str) -> str:
    return "[" + re.sub(r"([\\\]\[^&-])", r"\\\1", chars) + "]"


def _visible(text: Column) -> Column:
    """Characters in words."""
    return F.length(F.regexp_replace(text, SPACE + "+", ""))


def _count(text: Column, chars: str) -> Column:
    """How many characters of a text are among chars."""
    return F.length(text) - F.length(F.regexp_replace(text, _class(chars) + "+", ""))


def _covered(starts: Column) -> Column:
    """Words under the three-word windows that begin at the given places, in order."""
    steps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def repeated_words(words: Column) -> Column:
    """Number of words in three-word windows that occur twice or more.

    Windows are sorted by 43 bits of their hash beside their place; equal
    neighbours are held against their words.  Where hashes of unlike windows
    agree, or a text is too long for the packing, the windows themselves are sorted.
    """
    mask = (1 << POSITION_BITS) - 1
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    gram = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    high = lambda x: F.shiftright(x, POSITION_BITS)
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    packed = F.sort_array(F.transform(at, lambda i: gram(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))

    def same(a: Column, b: Column) -> Column:
        i, j = place(a), place(b)
        return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def equal_neighbours(s: Column) -> Column:
        near = lambda x, i: F.coalesce(high(x) == high(F.get(s, i - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(s, i + 1)), F.lit(False))
        return F.filter(s, near)

    def sorted_windows() -> Column:
        rows = F.array_sort(F.transform(at, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.cast("long").alias("i"))))
        alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
        return let(rows, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, i: alike(x, F.get(s, i - 1)) | alike(x, F.get(s, i + 1))), lambda x: x["i"])), _covered))

    def counted(found: Column) -> Column:
        clash = F.exists(F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: (high(a) == high(b)) & ~same(a, b)), lambda x: F.coalesce(x, F.lit(False)))
        starts = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(F.lit(mask))))
        return F.when(F.size(found) == 0, F.lit(0).cast("long")).when(clash, sorted_windows()).otherwise(let(starts, _covered))

    return F.when(n < 3, F.lit(0).cast("long")).when(n > mask, sorted_windows()).otherwise(let(packed, lambda s: let(equal_neighbours(s), counted)))


def _closed(line: Column) -> Column:
    """Whether CLOSED matches, looked for from the end alone."""
    end = F.rtrim(F.rtrim(line, F.lit(" \t\n\v\f\r")), F.lit(BEHIND))
    return F.substring(end, -1, 1).isin(*MARKS)


def line_fails(line: Column, visible: Column) -> Column:
    """Whether a line with words is to be removed; visible: its characters in words."""
    noisy = _count(line, NOISE) - FREE_MARKS > visible * F.lit(NOISE_SHARE)
    open_end = ~_closed(line) & ~line.rlike(f"^{SPACE}*({WORD}+{SPACE}+){{{SHORT_LINE - 1}}}{WORD}") & ~line.rlike(LONG_UNSPACED)
    cued = let(F.lower(line), lambda x: reduce(lambda a, b: a | b, [x.contains(c) for c in CUES]))
    return noisy | open_end | line.rlike(NAVIGATION_KEPT) | (cued & line.rlike(BOILERPLATE))


def _judged(line: Column) -> Column:
    return let(_visible(line), lambda n: F.struct(line.alias("line"), n.alias("n"), line_fails(line, n).alias("fails")))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the base counts, the cleaned text, what it lost, and the verdict ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep if c != id_col], text.alias("_text"))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def cleaned(all_lines: Column, own: Column, good: Column) -> Column:
        return F.struct(
            (F.size(all_lines) - F.size(own)).cast("long").alias("n_dup_lines"),
            F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("text"),
            F.aggregate(good, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("left_chars"),
        )

    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(WORD))
    by_line = let(lines, lambda every: let(F.array_distinct(every), lambda own: let(F.filter(F.transform(own, _judged), lambda x: ~x["fails"]), lambda good: cleaned(every, own, good))))
    base = base.select("*", let(word_array(F.col("_text")), counted).alias("_w"), by_line.alias("_l"))
    failed = (F.col("_w.n_words") < LEAST_WORDS) | (100 * F.col("_w.n_repeat_words") > 50 * F.col("_w.n_words"))
    out = base.select(
        "doc_id",
        *[c for c in keep if c != id_col],
        F.col("_w.n_words").alias("n_words"),
        F.col("_w.word_chars").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.col("_l.n_dup_lines").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("_l.left_chars").alias("left_chars"),
        F.col("_l.text").alias("cleaned_text"),
    )
    verdict = ~F.col("base_failed") & (F.col("left_chars") >= F.col("word_chars") * F.lit(1 - LOSS))
    return out.withColumn("kept", verdict)
