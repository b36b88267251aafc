"""Searches: lexical, visual, hybrid and similar, ordered and paged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import rounded
from ..operators import filters, pages, search
from ..operators.layout import shared_folder
from ..operators.lexical import indexed, lexical
from ..schema import DIMENSIONS, Mode, Orientation, SearchRequest, Similarity, Sort
from ..sources import catalog as C
from ..sources.catalog import table
from . import sql as S
from .base import query

_VECTOR = "(SELECT vector FROM vec WHERE id = 0)"


def _embedder(spark: SparkSession, d: str) -> search.FixedEmbedder:
    """Stands in for a text model: the vector of item 0, for any of the queries below."""
    own = search.semantic(C.catalog(spark, d, whole=False)).filter("id = 0").select("vector").head()["vector"]
    return search.FixedEmbedder({r.text: list(own) for r in _BY_TEXT})


def _page(spark: SparkSession, d: str, request: SearchRequest, columns: tuple[str, ...] = ("id", "name", "score", "reason"), paged: bool = True) -> DataFrame:
    looks = request.has_reference and request.similarity is not Similarity.SUBJECT
    searcher = search.Searcher(C.catalog(spark, d, index=bool(request.text), whole=looks), _embedder(spark, d) if request.text and request.mode is not Mode.TEXT and not request.has_reference else None)
    rows, ranks, _ = searcher.plan(request)
    if paged:
        rows = search.page(rows, search.order(request, ranks or bool(request.text)), request.offset, request.limit)
    return rows.withColumn("score", rounded("score", 6)).select(*columns)


_TEXT = SearchRequest(query="red", mode=Mode.TEXT)
_VISUAL = SearchRequest(query="red", mode=Mode.VISUAL)
_HYBRID = SearchRequest(query="red plate*")
_SCOPED = SearchRequest(query="red", favorites=True, orientation=Orientation.LANDSCAPE, extension="png", mode=Mode.TEXT)
_BY_TEXT = (_TEXT, _VISUAL, _HYBRID, SearchRequest(query="red"))


@query(S.search(_TEXT))
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _TEXT)


@query(S.search(_VISUAL, _VECTOR))
def visual_search(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _VISUAL)


@query(S.search(_HYBRID, _VECTOR))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _HYBRID)


_SUBJECT = SearchRequest(similar_id=1)
_LOOK, _SHAPE, _COLOR = (SearchRequest(similar_id=2, similarity=k) for k in (Similarity.APPEARANCE, Similarity.SHAPE, Similarity.COLOR))
_PLUS = SearchRequest(similar_id=1, query="red")


@query(S.search(_SUBJECT))
def similar_subject(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SUBJECT)


@query(S.search(_LOOK))
def similar_appearance(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _LOOK)


@query(S.search(_SHAPE))
def similar_shape(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SHAPE)


@query(S.search(_COLOR))
def similar_color(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _COLOR)


@query(S.search(_PLUS))
def similar_plus_text(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _PLUS)


_FILE = SearchRequest(reference_path="/outside/picture.png", query="red", similarity=Similarity.SUBJECT)


@query(S.search(_FILE, _VECTOR))
def similar_by_file(spark: SparkSession, d: str) -> DataFrame:
    """A picture outside of the catalog, embedded on the way."""
    rows = C.catalog(spark, d, index=True, whole=False)
    own = search.semantic(rows).filter("id = 0").select("vector").head()["vector"]
    searcher = search.Searcher(rows, search.FixedEmbedder({_FILE.reference_path: list(own)}))
    found, ranks, _ = searcher.plan(_FILE)
    return search.page(found, search.order(_FILE, ranks), 0, _FILE.limit).select("id", "name", rounded("score", 6).alias("score"), "reason")


@query(S.search(_VISUAL))
def visual_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Without a vector for the query the text decides."""
    searcher = search.Searcher(C.catalog(spark, d, index=True, whole=False))
    rows, ranks, _ = searcher.plan(_VISUAL)
    return search.page(rows, search.order(_VISUAL, True), 0, _VISUAL.limit).select("id", "name", rounded("score", 6).alias("score"), "reason")


# orders and pages

_SORTS = {s: SearchRequest(query="red", mode=Mode.TEXT, sort=s, limit=50) for s in Sort}
_PLAIN = "id, name, round(score, 6) AS score"


@query(S.search(_SORTS[Sort.RELEVANCE], columns=_PLAIN))
def sort_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SORTS[Sort.RELEVANCE], ("id", "name", "score"))


@query(S.search(_SORTS[Sort.NEWEST], columns=_PLAIN))
def sort_newest(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SORTS[Sort.NEWEST], ("id", "name", "score"))


@query(S.search(_SORTS[Sort.OLDEST], columns=_PLAIN))
def sort_oldest(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SORTS[Sort.OLDEST], ("id", "name", "score"))


@query(S.search(_SORTS[Sort.NAME], columns=_PLAIN))
def sort_name(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SORTS[Sort.NAME], ("id", "name", "score"))


@query(S.search(_SORTS[Sort.LARGEST], columns=_PLAIN))
def sort_largest(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SORTS[Sort.LARGEST], ("id", "name", "score"))


_BROWSE = SearchRequest(limit=100)
_SECOND = SearchRequest(query="red", mode=Mode.TEXT, limit=20, offset=20)


@query(S.search(_BROWSE, columns="id, name, reason"))
def browse(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _BROWSE, ("id", "name", "reason"))


@query(S.search(_SECOND, columns=_PLAIN))
def page_second(spark: SparkSession, d: str) -> DataFrame:
    """A continuation through a cursor, as a caller would ask for it."""
    from dataclasses import replace

    searcher = search.Searcher(C.catalog(spark, d, index=True, whole=False))
    first = searcher.search(replace(_SECOND, offset=0))
    rows = searcher.search(replace(_SECOND, cursor=first.cursor)).page
    return rows.select("id", "name", rounded("score", 6).alias("score"))


_WALK = SearchRequest(query="red", mode=Mode.TEXT, limit=60)


@query(S.search(_WALK, columns="id"))
def page_walk(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of one cursor: no row twice, none left out."""
    from dataclasses import replace

    searcher, request = search.Searcher(C.catalog(spark, d, index=True, whole=False)), replace(_WALK, limit=20)
    first = searcher.search(request)
    pages = [first.page, *(searcher.search(replace(request, offset=k, cursor=first.cursor)).page for k in (20, 40))]
    return reduce(lambda a, b: a.unionByName(b), [p.select("id") for p in pages])


_SIZE = 30
#: what was shown, and what there is now: one result that grew at its end, one with an edited row, one that lost a row
_CASES = {"grown": ("doc_id % 10 < 9 AND doc_id < 120", "doc_id % 10 < 9", "source"), "edited": ("doc_id < 150", "true", "CASE WHEN doc_id = 97 THEN 'edited' ELSE source END"), "lost": ("true", "doc_id <> 40", "source")}


def _continued_sql(case: str) -> str:
    shown, now, edit = _CASES[case]
    side = lambda where, source: f"(SELECT doc_id, {source} AS source, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE {where})"
    return f"""SELECT '{case}' AS scenario, CASE WHEN min(u) IS NULL THEN 'append' ELSE 'reset' END AS action, coalesce(min(u), (max(pos) + {_SIZE}) // {_SIZE})::BIGINT AS same_pages, count(*) AS n_shown, (SELECT count(*) FROM documents WHERE {now}) AS n_now
    FROM (SELECT a.pos, CASE WHEN b.pos IS NULL OR a.doc_id <> b.doc_id OR a.source <> b.source THEN a.pos // {_SIZE} END AS u FROM {side(shown, "source")} a LEFT JOIN {side(now, edit)} b ON a.pos = b.pos)"""


@query(" UNION ALL ".join(_continued_sql(case) for case in _CASES))
def append_or_reset(spark: SparkSession, d: str) -> DataFrame:
    """Whether a shown result goes on or begins anew, by the digests of its pages."""
    docs, by, out = table(spark, d, "documents"), [F.col("doc_id").asc()], []
    for case, (shown, now, edit) in _CASES.items():
        old = pages.stored(docs.filter(shown).select("doc_id", "source"), by)
        new = pages.stored(docs.filter(now).select("doc_id", F.expr(edit).alias("source")), by)
        out.append(pages.continuation(old, new, ["doc_id", "source"], _SIZE).select(F.lit(case).alias("scenario"), "*"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(S.search(_SCOPED, columns="count(*) AS total", paged=False))
def result_total(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _SCOPED, ("id",), paged=False).agg(F.count(F.lit(1)).alias("total"))


@query(S.search(_BY_TEXT[3], _VECTOR, columns="reason, count(*) AS n", paged=False) + " GROUP BY reason")
def match_reason(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, _BY_TEXT[3], ("reason",), paged=False).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(S.search(SearchRequest(query="hot_plate_100.png", mode=Mode.TEXT), columns=_PLAIN, paged=False))
def exact_name_boost(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, SearchRequest(query="hot_plate_100.png", mode=Mode.TEXT), ("id", "name", "score"), paged=False)


# the lexical operator on its own


def _lexical_sql(q: str, columns: str, mode: Mode = Mode.HYBRID, where: str = "true") -> str:
    return f"WITH items AS ({C.ITEMS_SQL}), {S.lexical(q, mode, where)} SELECT {columns} FROM lex"


_REL = "id, round(relevance, 6) AS relevance"


def _lexical(spark: SparkSession, d: str, q: str, mode: Mode = Mode.HYBRID, scope=None) -> DataFrame:
    return lexical(C.items(spark, d), q, mode, scope, index=C.indexed(spark, d).index())


@query(_lexical_sql("red the", _REL))
def lexical_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "red the").select("id", rounded("relevance", 6).alias("relevance"))


@query(_lexical_sql("red the", _REL))
def lexical_scanned(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index: the texts are folded and counted on the way."""
    return lexical(C.items(spark, d), "red the").select("id", rounded("relevance", 6).alias("relevance"))


@query(S.search(_TEXT))
def text_search_scanned(spark: SparkSession, d: str) -> DataFrame:
    rows, ranks, _ = search.Searcher(C.catalog(spark, d)).plan(_TEXT)
    return search.page(rows, search.order(_TEXT, True), 0, _TEXT.limit).select("id", "name", rounded("score", 6).alias("score"), "reason")


@query(_lexical_sql("red good", _REL, Mode.TEXT))
def lexical_and(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "red good", Mode.TEXT).select("id", rounded("relevance", 6).alias("relevance"))


@query(_lexical_sql('"of the" red', _REL))
def lexical_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, '"of the" red').select("id", rounded("relevance", 6).alias("relevance"))


@query(_lexical_sql("red or", _REL, Mode.TEXT))
def lexical_operators(spark: SparkSession, d: str) -> DataFrame:
    """Operators, brackets and quotes are words or nothing."""
    return _lexical(spark, d, 'red") -or:*', Mode.TEXT).select("id", rounded("relevance", 6).alias("relevance"))


@query(f"WITH items AS ({C.ITEMS_SQL}), {S.lexical('the of', Mode.HYBRID)} SELECT id, relevance FROM lex")
def lexical_no_terms(spark: SparkSession, d: str) -> DataFrame:
    """Stop words alone find nothing in a search that describes."""
    request = SearchRequest(query="the of")
    rows, _, _ = search.Searcher(C.catalog(spark, d)).plan(request)
    return rows.select("id", F.col("score").alias("relevance"))


@query(_lexical_sql('"of the" re*', f"{_REL}, trusted, round(lexical, 6) AS lexical", Mode.TEXT, S.scope(SearchRequest(favorites=True))))
def lexical_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same evidence from postings."""
    items = C.items(spark, d)
    rows = lexical(items, '"of the" re*', Mode.TEXT, filters.scope(SearchRequest(favorites=True)), index=indexed(items))
    return rows.select("id", rounded("relevance", 6).alias("relevance"), "trusted", rounded("lexical", 6).alias("lexical"))


_REWRITTEN = f"(SELECT * REPLACE (CASE WHEN id % 20 = 3 THEN 'red note' WHEN id % 20 = 5 THEN '' ELSE notes END AS notes, CASE WHEN id % 20 = 5 THEN '' ELSE ocr END AS ocr) FROM ({C.ITEMS_SQL}) WHERE id % 20 <> 4)"


@query(f"WITH items AS {_REWRITTEN}, {S.lexical('\"of the\" re*', Mode.TEXT, 'true')} SELECT {_REL}, trusted, round(lexical, 6) AS lexical FROM lex")
def lexical_segments(spark: SparkSession, d: str) -> DataFrame:
    """From the stored index, three segments of edits and the merge of two of them: some items gone, some with another note, some emptied."""
    items = C.items(spark, d).drop("embedding").withColumn("embedding", F.lit(None).cast("array<float>"))
    root, here = f"{shared_folder(spark)}/text-index", F.col("id") % 20
    touched = lambda k: items.filter(here == k).select("id", F.lit(True).alias("texts"))
    noted = items.withColumn("notes", F.when(here == 3, F.lit("red note")).otherwise(F.col("notes")))
    emptied = noted.withColumns({"notes": F.when(here == 5, F.lit("")).otherwise(F.col("notes")), "ocr": F.when(here == 5, F.lit("")).otherwise(F.col("ocr"))})
    edited = C.indexed(spark, d).append(root, items.limit(0), touched(4), keep_items=False).append(root, noted, touched(3), keep_items=False)
    index = edited.merged(1, root, keep_items=False).append(root, emptied, touched(5), keep_items=False).index()
    rows = lexical(items, '"of the" re*', Mode.TEXT, index=index)
    return rows.select("id", rounded("relevance", 6).alias("relevance"), "trusted", rounded("lexical", 6).alias("lexical"))


@query(_lexical_sql("pla*", _REL))
def lexical_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "pla*").select("id", rounded("relevance", 6).alias("relevance"))


@query(_lexical_sql("red", "id, round(lexical - CASE WHEN trusted THEN 0.25::DOUBLE ELSE 0 END, 6) AS scaled"))
def lexical_scaled(spark: SparkSession, d: str) -> DataFrame:
    rows = _lexical(spark, d, "red")
    return rows.select("id", rounded(F.col("lexical") - F.when(F.col("trusted"), F.lit(0.25)).otherwise(F.lit(0.0)), 6).alias("scaled"))


@query(_lexical_sql("good", "id, trusted, round(lexical, 6) AS lexical"))
def lexical_trusted(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "good").select("id", "trusted", rounded("lexical", 6).alias("lexical"))


@query(_lexical_sql("red", f"{_REL}, round(lexical, 6) AS lexical", Mode.TEXT, S.scope(_SCOPED)))
def lexical_scoped(spark: SparkSession, d: str) -> DataFrame:
    rows = _lexical(spark, d, "red", Mode.TEXT, filters.scope(_SCOPED))
    return rows.select("id", rounded("relevance", 6).alias("relevance"), rounded("lexical", 6).alias("lexical"))


@query("SELECT item_id, w AS words, len(w)::INT AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark)")
def parse_query_terms(spark: SparkSession, d: str) -> DataFrame:
    words = text.query_tokens("text")
    return table(spark, d, "benchmark").select("item_id", words.alias("words"), F.size(words).alias("n"))


_ASKED = """SELECT item_id, w, concat('"', w[1], ' ', w[2], '"  ', w[3], '* the (', w[4], ') -"') AS mixed, array_to_string(w, ' ') AS whole
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark)"""


@query(
    f"""SELECT item_id, list_concat([strip_accents(w[1] || ' ' || w[2])], list_transform(list_filter([w[3] || '*', w[4]], lambda x: replace(x, '*', '') NOT IN ({S.STOPS})), lambda x: strip_accents(x))) AS mixed,
    list_transform(list_filter(w, lambda x: x NOT IN ({S.STOPS})), lambda x: strip_accents(x))[1:{text.MOST_TERMS}] AS whole FROM ({_ASKED})"""
)
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Whole queries: phrases, prefixes, stop words, operators as data, and the most terms that count."""
    w = text.query_tokens("text")
    mixed = F.concat(F.lit('"'), w[0], F.lit(" "), w[1], F.lit('"  '), w[2], F.lit("* the ("), w[3], F.lit(') -"'))
    return table(spark, d, "benchmark").select("item_id", text.parsed(mixed).alias("mixed"), text.parsed(F.array_join(w, " ")).alias("whole"))


@query(f"SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({S.STOPS})) AS words FROM benchmark")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.without_stop_words(text.query_tokens("text")).alias("words"))


@query(
    f"WITH e AS (SELECT * FROM embeddings), q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT e.vec_id, round({S.dot('e.embedding', 'q.v')}, 6) AS score FROM e, q ORDER BY {S.dot('e.embedding', 'q.v')} DESC, vec_id LIMIT 100"
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    own = rows.filter("vec_id = 0").select("embedding").head()["embedding"]
    return search.top_k(rows, list(own), 100, DIMENSIONS).select("vec_id", rounded("score", 6).alias("score"))
