"""Hybrid search: exact cosine, full-text evidence and exact names, fused, filtered, ordered and paged."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.text import parse_query, stem
from ..schema import (
    APPEARANCE_VERSION,
    CATALOG_TEXT_LIMIT,
    CURRENT_MODELS,
    DIMENSIONS,
    OLDER_MODELS,
    Catalog,
    Mode,
    SearchRequest,
    SearchResult,
    Similarity,
    Sort,
)
from . import filters, pages
from .layout import tagged
from .lexical import Index, analysed, evidence, lexical

EXACT_NAME = 0.65
FILENAME_EVIDENCE = 0.25
COLUMNS = ("id", "path", "folder", "name", "thumb", "width", "height", "bytes", "modified", "favorite", "tags", "ocr", "notes")
#: why a result matches, in words that callers may show (fixed values)
REASONS = {Similarity.SHAPE: "Shape and detail", Similarity.COLOR: "Color palette", Similarity.APPEARANCE: "Appearance similarity", Similarity.SUBJECT: "Subject similarity"}


class Embedder(Protocol):
    """What turns a query into a vector; None means that it can't."""

    def text(self, query: str) -> list[float] | None: ...

    def image(self, path: str, similarity: Similarity) -> list[float] | None: ...


class NoEmbedder:
    """No model: search falls back to text."""

    def text(self, query: str) -> list[float] | None:
        return None

    def image(self, path: str, similarity: Similarity) -> list[float] | None:
        return None


class FixedEmbedder(NoEmbedder):
    """Vectors known beforehand, by query text or by path."""

    def __init__(self, vectors: dict[str, list[float]]) -> None:
        self.vectors = vectors

    def text(self, query: str) -> list[float] | None:
        return self.vectors.get(query)

    def image(self, path: str, similarity: Similarity) -> list[float] | None:
        return self.vectors.get(path)


def shown(rows: DataFrame) -> DataFrame:
    """What browsing shows of rows: no vectors, long texts are cut."""
    short = {c: F.substring(c, 1, CATALOG_TEXT_LIMIT).alias(c) for c in ("ocr", "notes")}
    return rows.select(*[short.get(c, F.col(c)) for c in COLUMNS], *[c for c in ("score", "evidence", "reason") if c in rows.columns])


def metadata(catalog: Catalog) -> DataFrame:
    return shown(catalog.items)


def semantic(catalog: Catalog, dimensions: int = DIMENSIONS) -> DataFrame:
    """Items with ``vector`` at length 1 (zeros where unusable) and ``semantic_available``."""
    good = V.usable("embedding", "model", dimensions)
    rows = catalog.items.withColumn("semantic_available", good)
    return rows.withColumn("vector", V.normalized_or_zero("embedding", F.col("semantic_available"), dimensions)).drop("embedding")


def current_descriptors(catalog: Catalog) -> DataFrame:
    """Items with the descriptor that fits their present file, or null."""
    a = catalog.appearances.filter(F.col("version") == APPEARANCE_VERSION).select(F.col("photo_id").alias("id"), "modified", "bytes", "descriptor")
    return catalog.items.drop("embedding").join(a, ["id", "modified", "bytes"], "left")


def appearance(catalog: Catalog, similarity: Similarity = Similarity.APPEARANCE, dimensions: int = DIMENSIONS) -> DataFrame:
    """Items with ``vector``, the descriptor (or its focus) at length 1, and ``semantic_available``."""
    rows = current_descriptors(catalog).withColumn("semantic_available", V.usable("descriptor", None, dimensions))
    rows = rows.withColumn("vector", V.normalized_or_zero("descriptor", F.col("semantic_available"), dimensions)).drop("descriptor")
    if similarity in (Similarity.SHAPE, Similarity.COLOR):
        rows = rows.withColumn("vector", V.projected("vector", similarity, dimensions))
    return rows


def scored(catalog: Catalog, query: list[float], similarity: Similarity = Similarity.SUBJECT, dimensions: int = DIMENSIONS) -> DataFrame:
    """Items with ``semantic_available`` and ``cosine`` to a query: as ``semantic`` or ``appearance`` and an inner product, in one pass over each vector."""
    if similarity is Similarity.SUBJECT:
        rows, vector, known = catalog.items, "embedding", F.coalesce(F.col("model").isin(*known_models()), F.lit(False))
    else:
        rows, vector, known = current_descriptors(catalog), "descriptor", F.lit(True)
    # a generator of one row: a filter on what is available would be put below with a second run of the function, but for this
    one = F.inline(F.array(V.scored(vector, known, query, dimensions, similarity)))
    return rows.select(*[c for c in rows.columns if c != vector], one).withColumnsRenamed({"available": "semantic_available", "score": "cosine"})


def availability(catalog: Catalog, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row: usable vectors, those of older models among them, and items without one."""
    good = V.usable("embedding", "model", dimensions)
    rows = catalog.items.select(good.alias("good"), "model")
    older = F.col("good") & F.col("model").isin(*OLDER_MODELS)
    return rows.agg(F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("available"), F.coalesce(F.sum(older.cast("long")), F.lit(0)).alias("legacy"), F.coalesce(F.sum((~F.col("good")).cast("long")), F.lit(0)).alias("unavailable"))


def exact_name(query: str) -> Column:
    return F.when((F.lower("name") == query.lower()) | (F.lower(stem("name")) == query.lower()), F.lit(EXACT_NAME)).otherwise(F.lit(0.0))


def ranked(rows: DataFrame, request: SearchRequest, query_vector: list[float] | None, text_items: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """The matches of a request with ``score``, ``evidence`` and ``reason``, not yet ordered.

    rows: the catalog in the form that the request needs, with ``semantic_available`` and
    ``vector`` or ``cosine`` if there is a query vector.  The full text is searched in rows, in one pass with the
    vectors, or in text_items (analysed) or an index where these are given.
    """
    text, scope = request.text, filters.scope(request)
    semantic_search = query_vector is not None
    out = rows
    lexical_column: Column = F.lit(None).cast("double")
    if text and (request.mode is not Mode.VISUAL or not semantic_search):
        terms = parse_query(request.query, keep_stop_words=request.mode is Mode.TEXT)
        if terms and (index is not None or text_items is not None):
            hits = lexical(text_items if text_items is not None else rows, request.query, request.mode, scope, index=index)
            out = out.join(hits.select("id", "lexical"), "id", "left")
        elif terms:
            out = evidence(rows, terms, scope, only=not semantic_search)
        if terms:
            lexical_column = F.col("lexical")
    for c in (scope, filters.without_subject(request)):
        out = out if c is None else out.filter(c)
    if semantic_search:
        if request.has_reference:
            out = out.filter("semantic_available")
        cosine = F.col("cosine") if "cosine" in out.columns else F.when(F.col("semantic_available"), V.dot("vector", V.literal(query_vector))).otherwise(F.lit(0.0))
        has_vector = F.col("semantic_available")
    else:
        cosine, has_vector = F.lit(0.0), F.lit(False)
    out = out.withColumns({"_cosine": cosine, "_has": has_vector, "_lexical": lexical_column})
    found = F.coalesce("_lexical", F.lit(0.0))
    score = F.col("_cosine") + found
    if text:
        if request.mode is not Mode.VISUAL:
            score = score + exact_name(text)
        out = out.filter(F.col("_has") | F.col("_lexical").isNotNull())
    out = out.withColumns({"score": score, "evidence": found})
    if request.has_reference:
        other = F.lit(REASONS[request.similarity])
    else:
        other = F.lit("Visual meaning" if semantic_search else "")
    # in words that callers may show (fixed values)
    reason = F.when(F.col("evidence") >= FILENAME_EVIDENCE, F.lit("Filename / description match")).when(F.col("evidence") > 0, F.lit("Text found in labels or image")).otherwise(other)
    return shown(out.withColumn("reason", reason))


def order(request: SearchRequest, by_score: bool) -> list[Column]:
    """The order of results; the catalog's own (newest, then largest id) breaks ties."""
    catalog_order = [F.col("modified").desc(), F.col("id").desc()]
    if request.sort is Sort.NEWEST:
        return catalog_order
    if request.sort is Sort.OLDEST:
        return [F.col("modified").asc(), F.col("id").desc()]
    if request.sort is Sort.NAME:
        return [F.lower("name").asc(), *catalog_order]
    if request.sort is Sort.LARGEST:
        return [(F.col("width").cast("long") * F.col("height")).desc(), *catalog_order]
    return [F.col("score").desc(), *catalog_order] if by_score else catalog_order


def page(rows: DataFrame, by: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of an order: a bounded top-k, never a full sort, for the first pages."""
    return rows.orderBy(*by).offset(max(0, offset)).limit(max(0, limit))


class Searcher:
    """Searches over a catalog, with cursors that stay on one snapshot of the results.

    The first page is a bounded top-k.  Who asks for a second has the matches stored in order, with
    a directory of their parts, until another search replaces them; a page then reads its own part.  keep_tokens: also keep the token
    arrays of the items, for a session of many text searches.  A catalog with
    an index is searched by that.
    """

    def __init__(self, catalog: Catalog, embedder: Embedder | None = None, dimensions: int = DIMENSIONS, keep_tokens: bool = False) -> None:
        self.catalog, self.embedder, self.dimensions, self.keep_tokens = catalog, embedder or NoEmbedder(), dimensions, keep_tokens
        self._tokens: DataFrame | None = None
        self.latest = 0
        self._cursors = itertools.count(1)
        self._last: tuple[SearchRequest, SearchResult, DataFrame, list[Column]] | None = None
        self._pages: pages.Directory | None = None
        self._tag = f"search-{uuid.uuid4().hex}"

    def supersede(self, generation: int) -> None:
        """A later request is coming: jobs of the search that is running end now, from whatever thread this is said, and it gives None."""
        self.latest = max(self.latest, generation)
        self.catalog.items.sparkSession.sparkContext.cancelJobsWithTag(self._tag)

    def close(self) -> None:
        """Forget the results so far."""
        if self._pages:
            self._pages.forget()
        self._last = self._pages = None

    def reload(self, catalog: Catalog | None = None) -> None:
        """Forget the results so far, and use another snapshot of the catalog."""
        self.close()
        self._use(catalog or self.catalog)

    def _use(self, catalog: Catalog) -> None:
        if self._tokens is not None:
            self._tokens.unpersist()
        self.catalog, self._tokens = catalog, None

    def _text_items(self) -> DataFrame | None:
        if not self.keep_tokens:
            return None
        if self._tokens is None:
            self._tokens = analysed(self.catalog.items.drop("embedding")).persist()
        return self._tokens

    def metadata_changed(self, catalog: Catalog) -> None:
        """New notes or favorites: results that depend on them are dropped, others go on."""
        if self._last and (self._last[0].favorites or self._last[0].text):
            self.reload(catalog)
        else:
            self._use(catalog)

    def plan(self, request: SearchRequest) -> tuple[DataFrame, bool, Callable[[], str]]:
        """(matches, whether a vector ranks them, what gives the status); ValueError with a message where the subject has no vector."""
        wants_vector = request.has_reference or bool(request.text) and request.mode is not Mode.TEXT
        looks = request.has_reference and request.similarity is not Similarity.SUBJECT
        vector, without = None, False
        if looks:
            rows = appearance(self.catalog, request.similarity, self.dimensions)
        elif wants_vector:
            rows = semantic(self.catalog, self.dimensions)
        else:
            rows = self.catalog.items
        if request.similar_id is not None:
            own = rows.filter(F.col("id") == request.similar_id).filter("semantic_available").select("vector").head()
            if own is None:
                raise ValueError("Build the appearance index to search by appearance." if looks else "This item has no vector yet. Rescan its folder.")
            vector = list(own["vector"])
        elif request.reference_path:
            vector = self.embedder.image(request.reference_path, request.similarity)
            if vector is None:
                raise ValueError("The reference could not be read.")
        elif wants_vector:
            vector = self.embedder.text(request.text)
            without = vector is None
        if without:  # text alone decides
            rows = self.catalog.items
        elif vector is not None:
            rows = scored(self.catalog, vector, request.similarity if request.has_reference else Similarity.SUBJECT, self.dimensions)
        matches = ranked(rows, request, vector, self._text_items(), self.catalog.index)
        return matches, vector is not None, lambda: self._status(request, vector is not None, looks, without)

    def _status(self, request: SearchRequest, ranks: bool, looks: bool, without: bool) -> str:
        """What to say of a search, in words that callers may show (fixed values)."""
        if without:
            return "Text matches only · no vector for this query"
        if looks:
            focus = {Similarity.SHAPE: "shape and detail", Similarity.COLOR: "color palette"}.get(request.similarity, "color, silhouette and edges")
            return f"Appearance · {focus}"
        if ranks:
            status = "Visual similarity" if request.mode is Mode.VISUAL or request.has_reference else "Visual + text search"
            counts = availability(self.catalog, self.dimensions).head()
            if counts["legacy"]:
                status += " · Earlier index supported"
            if counts["unavailable"]:
                status += f" · {counts['unavailable']} items need a rescan for visual search"
            return status
        return "Text matches · filenames, labels, OCR and descriptions" if request.text else "All items"

    def search(self, request: SearchRequest) -> SearchResult | None:
        """A page of results; None if a later generation has been asked for meanwhile."""
        if self._stale(request):
            return None
        self.latest = max(self.latest, request.generation)
        try:
            with tagged(self.catalog.items.sparkSession, self._tag):
                result = self._search(request)
        except Exception:
            if self._stale(request):
                return None
            raise
        return None if self._stale(request) else result

    def _stale(self, request: SearchRequest) -> bool:
        return bool(self.latest and request.generation and request.generation < self.latest)

    def _search(self, request: SearchRequest) -> SearchResult:
        began = time.monotonic()
        last = self._last
        goes_on = last and request.offset > 0 and request.cursor and request.cursor == last[1].cursor and request.identity() == last[0].identity()
        if not goes_on:
            try:
                matches, ranks, status = self.plan(request)
            except ValueError as e:
                return SearchResult(request.generation, 0, 0, 0, False, str(e), None, True, (time.monotonic() - began) * 1000)
            self.close()
            by = order(request, ranks or bool(request.text))
            result = SearchResult(request.generation, next(self._cursors), 0, matches.count(), ranks, status())
            self._last = last = (request, result, matches, by)
        _, result, matches, by = last
        offset = min(request.offset, result.total) if goes_on else 0
        if goes_on and self._pages is None:
            self._pages = pages.stored(matches, by)
        rows = self._pages.page(offset, request.limit) if goes_on else page(matches, by, 0, request.limit)
        return replace(result, generation=request.generation, offset=offset, page=rows, elapsed_ms=(time.monotonic() - began) * 1000)


def top_k(vectors: DataFrame, query: list[float], k: int, dimensions: int = DIMENSIONS, key: str = "vec_id", vector: str = "embedding", norm: str | None = None) -> DataFrame:
    """The k rows with the greatest inner product, ties to the smaller key; k <= 0 or a query of another length: none.

    Each task keeps the best k of its batches, each a matrix, so k rows a task are ordered at the end.  norm: a column with
    the length of each vector; a batch that is too short to reach the k-th score by it is not multiplied.
    """
    if k <= 0 or len(query) != dimensions:
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    q = np.asarray(query, float)
    reach = float(np.sqrt(q @ q)) * (1 + 1e-9)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores = np.empty(0, np.int64), np.empty(0)
        for b in batches:
            if not b.num_rows or norm and len(keys) == k and pc.max(b.column(2)).as_py() * reach < scores[-1]:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dimensions)
            keys, scores = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([scores, np.einsum("ij,j->i", m, q)])
            if len(keys) > k:
                scores_or_none = np.where(np.isnan(scores), -np.inf, scores)
                least = np.partition(scores_or_none, -k)[-k]
                some = np.flatnonzero(scores_or_none >= least)
                some = some[np.lexsort((keys[some], -scores_or_none[some]))][:k]
                keys, scores = keys[some], scores[some]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(scores)], names=[key, "score"])

    rows = vectors.filter(F.size(vector) == dimensions).select(F.col(key).cast("long").alias(key), vector, *([F.col(norm).cast("double")] if norm else []))
    return rows.mapInArrow(best, T.StructType([T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])).orderBy(F.col("score").desc(), F.col(key).asc()).limit(k)


def known_models() -> tuple[str, ...]:
    return (*CURRENT_MODELS, *OLDER_MODELS)
