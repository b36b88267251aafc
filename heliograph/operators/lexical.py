"""Full-text search: boolean terms, BM25 over weighted columns, trusted evidence.

Two ways give the same evidence.  ``evidence`` scans: a row's tokens are an array
per column, made where a word of the query is somewhere in the row's text, so
matching and scoring are row-local.  ``Index`` holds the tokens as postings in the
order of terms, as ``segments`` keeps them; a query reads those of its terms alone.
Either way the corpus statistics and the best score, a row of numbers each, come to the driver
first, so that the plan of the answer reads its source once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, Term, fold, hits, parse_query, tokens
from ..schema import TEXT_COLUMNS, TRUSTED_COLUMNS, Mode
from .layout import dealt

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
BASE, SPREAD, TRUST = 0.04, 0.16, 0.25


def _sum(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def _all(xs) -> Column:
    return reduce(lambda a, b: a & b, xs)


def _any(xs) -> Column:
    return reduce(lambda a, b: a | b, xs)


def analysed(items: DataFrame) -> DataFrame:
    """The items with the token array of each text column (``_t_name`` and so on) and their number (``_length``); analysed items as they are."""
    if "_length" in items.columns:
        return items
    rows = dealt(items, "id").select("*", *[tokens(c).alias(f"_t_{c}") for c, _ in TEXT_COLUMNS])
    return rows.withColumn("_length", _sum([F.size(f"_t_{c}") for c, _ in TEXT_COLUMNS]))


def _holds(term: Term) -> Column:
    """Whether a row's folded texts have every word of a term somewhere, be it inside of other words: cheaper than tokens, and true wherever the term matches."""
    return _all([_any([F.col(f"_f_{c}").contains(word) for c, _ in TEXT_COLUMNS]) for word in term.words])


def near(items: DataFrame, terms: list[Term]) -> DataFrame:
    """Items as ``analysed``, but with tokens only in rows that may match a term, and ``_near``: whether all terms may match."""
    if "_length" in items.columns:
        return items.withColumn("_near", F.lit(True))
    # a generator of one row: folding would be copied into each of its uses, but for this
    folded = F.struct(*[fold(F.coalesce(F.col(c), F.lit(""))).alias(f"_f_{c}") for c, _ in TEXT_COLUMNS])
    rows = dealt(items, "id").select("*", F.inline(F.array(folded)))
    rows = rows.withColumns({f"_n{i}": _holds(t) for i, t in enumerate(terms)})
    some, none = _any([F.col(f"_n{i}") for i in range(len(terms))]), F.array().cast("array<string>")
    words = {f"_t_{c}": F.when(some, F.regexp_extract_all(F.col(f"_f_{c}"), F.lit(TOKEN), F.lit(0))).otherwise(none) for c, _ in TEXT_COLUMNS}
    length = _sum([F.regexp_count(F.col(f"_f_{c}"), F.lit(TOKEN)) for c, _ in TEXT_COLUMNS])
    rows = rows.withColumns(words | {"_length": length, "_near": _all([F.col(f"_n{i}") for i in range(len(terms))])})
    return rows.drop(*[f"_f_{c}" for c, _ in TEXT_COLUMNS], *[f"_n{i}" for i in range(len(terms))])


def postings(items: DataFrame) -> DataFrame:
    """id, col, pos, term of every token."""
    arrays = [F.struct(F.lit(c).alias("col"), tokens(c).alias("words")) for c, _ in TEXT_COLUMNS]
    rows = dealt(items, "id").select("id", F.explode(F.array(*arrays)).alias("x")).select("id", F.col("x.col").alias("col"), F.posexplode("x.words").alias("pos", "term"))
    return rows.select("id", "col", F.col("pos").cast("long").alias("pos"), "term")


def updated_postings(old: DataFrame, items: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings after the items with a changed id (id) were saved or deleted: only their rows are made anew."""
    return old.join(changed.select("id"), "id", "left_anti").unionByName(postings(items.join(changed.select("id"), "id", "left_semi")))


def term_statistics(items: DataFrame) -> DataFrame:
    """term, and the number of items and of tokens that have it."""
    return postings(items).groupBy("term").agg(F.countDistinct("id").alias("n_items"), F.count(F.lit(1)).alias("n_tokens"))


def _counter(term: Term) -> Callable[[Column], Column]:
    return lambda column_tokens: hits(column_tokens, term)


def matched(rows: DataFrame, terms: list[Term]) -> DataFrame:
    """Analysed rows with the hits of each term (``_h0`` and so on, weighted in ``_f0``), whether all match, and whether all match in trusted columns."""
    # hits by column are made once a term (an array that the optimiser does not copy into its uses)
    columns = F.array(*[F.col(f"_t_{c}") for c, _ in TEXT_COLUMNS])
    out = rows.withColumns({f"_c{i}": F.transform(columns, _counter(term)) for i, term in enumerate(terms)})
    sums = []
    for i in range(len(terms)):
        found = {c: F.get(F.col(f"_c{i}"), F.lit(k)) for k, (c, _) in enumerate(TEXT_COLUMNS)}
        sums.append(_sum(found.values()).alias(f"_h{i}"))
        sums.append(_sum([found[c] * F.lit(w) for c, w in TEXT_COLUMNS]).alias(f"_f{i}"))
        sums.append((_sum([found[c] for c in TRUSTED_COLUMNS]) > 0).alias(f"_r{i}"))
    # a generator of one row: the optimiser would copy what is counted into filters and scores above it, but for this
    kept = [c for c in out.columns if not c.startswith(("_c", "_t_"))]
    out = out.select(*kept, F.inline(F.array(F.struct(*sums))))
    return out.withColumns({"_all": _all([F.col(f"_h{i}") > 0 for i in range(len(terms))]), "trusted": _all([F.col(f"_r{i}") for i in range(len(terms))])})


def _relevance(n: int, mean: float, having: list[int] | list[Column]) -> Column:
    """BM25 of a matched row, from the number of rows, their mean length, and the rows that have each term."""
    score: Column = F.lit(0.0)
    for i, m in enumerate(having):
        idf = F.log((F.lit(n) - F.lit(m) + 0.5) / (F.lit(m) + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        f = F.col(f"_f{i}")
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_length") / F.lit(mean)))
    return score


def _scaled(best: float | Column | None) -> Column:
    """Evidence of 0.04 to 0.20 by relevance, and 0.25 more where the match is trusted."""
    relevance, best = F.col("relevance"), F.lit(best)
    share = F.when(best > 0, F.lit(BASE) + F.lit(SPREAD) * relevance / best).otherwise(relevance)
    return share + F.when(F.col("trusted"), F.lit(TRUST)).otherwise(F.lit(0.0))


def evidence(items: DataFrame, terms: list[Term], scope: Column | None = None, only: bool = False) -> DataFrame:
    """items with ``relevance``, ``trusted`` and ``lexical`` where they match and are in scope, else null (only: those that do); statistics are over all items."""
    every, names = near(items, terms), [c for c in items.columns if c != "_length" and not c.startswith("_t_")]
    n, found = len(terms), F.col("_all") if scope is None else F.col("_all") & scope
    # one pass: rows that count alike are one group, whose shortest row scores best
    alike = [*[f"_f{i}" for i in range(n)], *[(F.col(f"_h{i}") > 0).cast("long").alias(f"_h{i}") for i in range(n)], F.coalesce(found, F.lit(False)).alias("_found")]
    groups = matched(every, terms).groupBy(*alike).agg(F.count(F.lit(1)).alias("rows"), F.sum("_length").alias("tokens"), F.min("_length").alias("_length")).persist()
    having = [F.coalesce(F.sum(F.col("rows") * F.col(f"_h{i}")), F.lit(0)) for i in range(n)]
    rows, total, *having = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), *having).head()
    relevance = _relevance(rows, total / rows if total else 1.0, having)
    best = groups.filter("_found").agg(F.max(relevance)).head()[0]
    groups.unpersist()
    hits_only = matched(every.filter("_near"), terms).filter(found).withColumn("relevance", relevance)
    if only:
        return hits_only.withColumn("lexical", _scaled(best)).select(*names, "relevance", "trusted", "lexical")
    rows = matched(every, terms).withColumn("relevance", F.when(found, relevance))
    good = F.col("relevance").isNotNull()
    return rows.select(*names, "relevance", F.when(good, F.col("trusted")).alias("trusted"), F.when(good, _scaled(best)).alias("lexical"))


@dataclass(frozen=True)
class Index:
    """postings (id, col, pos, term), best in the order of terms, and the length (id, length) of every item.

    Postings of segments also have the item's length and the segment's number (seq); totals is then the number
    of items and of tokens, and replaced the ids whose older postings are void (id, last).
    """

    postings: DataFrame
    lengths: DataFrame
    totals: tuple[int, int] | None = None
    replaced: DataFrame | None = None

    def _hits(self, term: Term) -> DataFrame:
        """id and col of every hit of a term, with what else the postings tell."""
        more = [c for c in ("seq", "length") if c in self.postings.columns]
        first = self.postings.filter(F.col("term").startswith(term.words[0]) if term.prefix else F.col("term") == term.words[0]).select("id", "col", "pos", *more)
        for k, word in enumerate(term.words[1:], 1):
            after = self.postings.filter(F.col("term") == word).select("id", "col", (F.col("pos") - k).alias("pos"), *more[:1])
            first = first.join(after, ["id", "col", "pos", *more[:1]], "left_semi")
        return first.select("id", "col", *more)

    def _matches(self, terms: list[Term]) -> DataFrame:
        """id, hits by term (_h0 and so on, weighted in _f0, whether in trusted columns in _r0) and _length of the items with a hit."""
        every = reduce(lambda a, b: a.unionByName(b), [self._hits(t).withColumn("i", F.lit(i)) for i, t in enumerate(terms)])
        if self.replaced is not None:
            every = every.join(self.replaced, "id", "left").filter(F.col("last").isNull() | (F.col("seq") >= F.col("last")))
        weight = reduce(lambda x, y: x.when(F.col("col") == y[0], F.lit(y[1])), TEXT_COLUMNS[1:], F.when(F.col("col") == TEXT_COLUMNS[0][0], F.lit(TEXT_COLUMNS[0][1])))
        sums = []
        for i in range(len(terms)):
            own = F.col("i") == i
            sums += [F.count(F.when(own, 1)).alias(f"_h{i}"), F.coalesce(F.sum(F.when(own, weight)), F.lit(0.0)).alias(f"_f{i}"), (F.count(F.when(own & F.col("col").isin(*TRUSTED_COLUMNS), 1)) > 0).alias(f"_r{i}")]
        if "length" in every.columns:
            return every.groupBy("id").agg(*sums, F.max("length").alias("_length"))
        return every.groupBy("id").agg(*sums).join(self.lengths.select("id", F.col("length").alias("_length")), "id")

    def evidence(self, terms: list[Term], ids: DataFrame | None = None) -> DataFrame:
        """id, relevance, trusted and lexical of the items that match; ids: those in scope.

        The numbers of items that have each term, and the best score, are one row each that is joined with every match.
        """
        n, every = len(terms), self._matches(terms)
        items, words = self.totals or self.lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).head()
        having = every.agg(*[F.coalesce(F.sum((F.col(f"_h{i}") > 0).cast("long")), F.lit(0)).alias(f"_n{i}") for i in range(n)])
        rows = every.filter(_all([F.col(f"_h{i}") > 0 for i in range(n)]))
        rows = rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")
        scored = rows.crossJoin(F.broadcast(having)).withColumn("relevance", _relevance(items, words / items if words else 1.0, [F.col(f"_n{i}") for i in range(n)]))
        best = scored.agg(F.max("relevance").alias("_best"))
        scored = scored.select("id", "relevance", _all([F.col(f"_r{i}") for i in range(n)]).alias("trusted")).crossJoin(F.broadcast(best))
        return scored.select("id", "relevance", "trusted", _scaled(F.col("_best")).alias("lexical"))


def lengths(items: DataFrame) -> DataFrame:
    """id and length (tokens) of every item."""
    return items.select("id", _sum([F.regexp_count(fold(F.coalesce(F.col(c), F.lit(""))), F.lit(TOKEN)) for c, _ in TEXT_COLUMNS]).cast("long").alias("length"))


def indexed(items: DataFrame) -> Index:
    return Index(postings(items), lengths(items))


def lexical(items: DataFrame, query: str, mode: Mode = Mode.HYBRID, scope: Column | None = None, keep: tuple[str, ...] = (), index: Index | None = None) -> DataFrame | None:
    """id, relevance, trusted and lexical (evidence of 0.04 to 0.20, and 0.25 more where trusted) of the items that match; None without terms."""
    terms = parse_query(query, keep_stop_words=mode is Mode.TEXT)
    if not terms:
        return None
    if index is not None:
        rows = index.evidence(terms, None if scope is None else items.filter(scope))
        return rows.join(items.select("id", *keep), "id") if keep else rows
    return evidence(items, terms, scope, only=True).select("id", *keep, "relevance", "trusted", "lexical")
