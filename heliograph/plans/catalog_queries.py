"""Scans, filters, statistics, maintenance and indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import dml, filters, indexing, lexical, search, stats
from ..schema import DIMENSIONS, Orientation, SearchRequest
from ..sources import catalog as C
from ..sources.catalog import run_sql, table
from . import sql as S
from .base import query

_KEYS = "id, path, modified"


@query(f"{S.views('items')} SELECT id, path, folder, name, width, height, bytes, modified, favorite FROM items")
def scan_items_ordered(spark: SparkSession, d: str) -> DataFrame:
    return C.items(spark, d).select("id", "path", "folder", "name", "width", "height", "bytes", "modified", "favorite").orderBy(F.desc("modified"), F.desc("id"))


@query(f"{S.views('items')} SELECT id, path, name, width, height, bytes, modified, favorite FROM items WHERE id = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.items(spark, d).filter("id = 42").limit(1).select("id", "path", "name", "width", "height", "bytes", "modified", "favorite")


@query(f"{S.views('folders')} SELECT path FROM folders ORDER BY path")
def folders_ordered(spark: SparkSession, d: str) -> DataFrame:
    return C.catalog(spark, d).folders.select("path").orderBy("path")


@query(f"{S.views('items')} SELECT id, path, folder, name, thumb, width, height, bytes, modified, favorite, tags, substr(ocr, 1, 700) AS ocr, substr(notes, 1, 700) AS notes FROM items")
def catalog_metadata(spark: SparkSession, d: str) -> DataFrame:
    return search.metadata(C.catalog(spark, d))


_ROUNDED = "list_transform(vector, lambda x: round(x::DOUBLE, 5))"


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("id", "semantic_available", scalars.rounded_all("vector", 5).alias("vector"))


@query(
    f"WITH items AS ({C.ITEMS_SQL}), {S.vectors(S.Similarity.SUBJECT)} SELECT id, available AS semantic_available, CASE WHEN available THEN {_ROUNDED} ELSE list_transform(range(0, {DIMENSIONS}), lambda x: 0.0::DOUBLE) END AS vector FROM vec"
)
def catalog_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(search.semantic(C.catalog(spark, d)))


@query(
    f"WITH items AS ({C.ITEMS_SQL}), app AS ({C.APPEARANCES_SQL}), {S.vectors(S.Similarity.APPEARANCE)} SELECT id, available AS semantic_available, CASE WHEN available THEN {_ROUNDED} ELSE list_transform(range(0, {DIMENSIONS}), lambda x: 0.0::DOUBLE) END AS vector FROM vec"
)
def catalog_appearance(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(search.appearance(C.catalog(spark, d)))


# filters


def _filtered(spark: SparkSession, d: str, request: SearchRequest) -> DataFrame:
    return C.items(spark, d).filter(filters.scope(request)).select("id", "path", "modified")


def _filter_sql(request: SearchRequest) -> str:
    return f"{S.views('items')} SELECT {_KEYS} FROM items WHERE {S.scope(request)}"


_FOLDER = SearchRequest(folder="/lib/src3")
_FAVORITES = SearchRequest(favorites=True)
_PORTRAIT = SearchRequest(orientation=Orientation.PORTRAIT)
_EXTENSION = SearchRequest(extension="PNG")
_ALL = SearchRequest(folder="/lib/src5", favorites=True, orientation=Orientation.LANDSCAPE, extension="jpg")


@query(_filter_sql(_FOLDER))
def filter_folder(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, _FOLDER)


@query(_filter_sql(_FAVORITES))
def filter_favorites(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, _FAVORITES)


@query(f"{S.views('items')} SELECT CASE WHEN width > height THEN 1 WHEN height > width THEN 2 ELSE 3 END AS orientation, count(*) AS n FROM items GROUP BY 1")
def filter_orientation(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    kind = F.when(filters.oriented(Orientation.LANDSCAPE), 1).when(filters.oriented(Orientation.PORTRAIT), 2).when(filters.oriented(Orientation.SQUARE), 3)
    return items.select(kind.alias("orientation")).groupBy("orientation").agg(F.count(F.lit(1)).alias("n"))


@query(_filter_sql(_EXTENSION))
def filter_extension(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, _EXTENSION)


@query(_filter_sql(_ALL))
def filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, _ALL)


_HOSTS = ("github.com", "spam-farm.example.org", "m.therou.example.com")


@query(
    "SELECT page_id, url, regexp_matches(url, '^https://([^/?#@:]+)(:443|:)?([/?#].*)?$') AND lower(regexp_extract(url, '^https://([^/?#@:]+)', 1)) IN ("
    + ", ".join(f"'{h}'" for h in _HOSTS)
    + ") AS allowed FROM pages"
)
def url_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", scalars.redirect_allowed("url", _HOSTS).alias("allowed"))


_NESTED = "SELECT path FROM folders UNION ALL SELECT concat(path, '/sub') FROM folders UNION ALL SELECT concat(upper(path), '/sub/deep') FROM folders"


@query(
    f"WITH folders AS ({C.FOLDERS_SQL}), f AS ({_NESTED}) SELECT a.path AS \"outer\", b.path AS \"inner\" FROM f a JOIN f b ON starts_with(lower(b.path), lower(a.path) || '/')"
)
def folder_overlap(spark: SparkSession, d: str) -> DataFrame:
    return filters.overlapping(run_sql(spark, d, _NESTED, folders=C.catalog(spark, d).folders))


# statistics


@query("SELECT count(*) AS n FROM documents")
def count_items(spark: SparkSession, d: str) -> DataFrame:
    return C.items(spark, d).agg(F.count(F.lit(1)).alias("n"))


_FIT = f"a.version = 1 AND len(a.descriptor) = {DIMENSIONS} AND a.modified = i.modified AND a.bytes = i.bytes"


@query(
    f"""{S.views('items', 'app')}, s AS (SELECT count(*) AS images, coalesce(sum(i.bytes), 0)::BIGINT AS bytes, coalesce(sum((i.model IS NULL OR i.model NOT IN ({S.CURRENT}))::INT), 0)::BIGINT AS outdated,
    coalesce(sum(({_FIT})::INT), 0)::BIGINT AS appearances FROM items i LEFT JOIN app a ON a.photo_id = i.id) SELECT *, images - appearances AS missing_appearances FROM s"""
)
def stats_(spark: SparkSession, d: str) -> DataFrame:
    return stats.stats(C.catalog(spark, d), DIMENSIONS)


@query(
    f"""{S.views('items', 'app')} SELECT i.id, i.path, i.modified, i.bytes, coalesce(i.model IN ({S.CURRENT}) AND len(i.embedding) = {DIMENSIONS}, false) AS embedding_current, coalesce({_FIT}, false) AS appearance_current
    FROM items i LEFT JOIN app a ON a.photo_id = i.id"""
)
def scan_entries(spark: SparkSession, d: str) -> DataFrame:
    return stats.scan_entries(C.catalog(spark, d), DIMENSIONS)


@query(f"WITH items AS ({C.ITEMS_SQL}), {S.vectors(S.Similarity.SUBJECT)} SELECT sum(available::INT)::BIGINT AS available, sum((available AND model IN ('legacy-v1', 'previous-v2'))::INT)::BIGINT AS legacy, sum((NOT available)::INT)::BIGINT AS unavailable FROM vec")
def vector_availability(spark: SparkSession, d: str) -> DataFrame:
    return search.availability(C.catalog(spark, d))


_PICKED = "x[n // 2 + 1] AS p50, x[floor(n * 0.95::DOUBLE)::BIGINT + 1] AS p95, x[(n - 1) * 95 // 100 + 1] AS p95_of_last, x[1] AS least"


@query(f"SELECT event_type, n, {_PICKED} FROM (SELECT event_type, count(value) AS n, list_sort(list(value)) AS x FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def order_stat_percentiles(spark: SparkSession, d: str) -> DataFrame:
    picks = {"p50": stats.p50(), "p95": stats.p95(), "p95_of_last": stats.p95_of_last(), "least": F.lit(0)}
    return stats.ranked_values(table(spark, d, "events"), "value", ("event_type",), picks)


@query("SELECT event_type, round(median(value), 9) AS median, count(DISTINCT user_id) AS runs FROM events GROUP BY event_type")
def median_by_group(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    runs = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("runs"))
    return stats.medians(events, ("event_type",), "value").select("event_type", scalars.rounded("median", 9).alias("median")).join(runs, "event_type")


@query("SELECT event_type, round(sum(value / 1000), 6) AS ms, count(*) AS n FROM events GROUP BY event_type")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    return stats.stage_timings(table(spark, d, "events"), "event_type", "value").withColumn("ms", scalars.rounded("ms", 6))


def _tree_sql() -> str:
    """The levels of a digest's tree, one SELECT each."""
    out, below = [], "r"
    for depth in range(stats.LEVELS + 1):
        above = f"k >> {stats.BITS}" if depth < stats.LEVELS else "0::BIGINT"
        out.append(f"l{depth} AS (SELECT part, up AS k, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY k, h)) AS h FROM (SELECT *, {above} AS up FROM {below}) GROUP BY part, up)")
        below = f"l{depth}"
    return ", ".join(out)


@query(
    f"""WITH e AS (SELECT doc_id % 8 AS part, doc_id AS k, sha256(encode(concat(octet_length(encode(source)), ':', source, octet_length(encode(text)), ':', text))) AS h FROM documents),
    r AS (SELECT part, k, concat(h, ':', count(*)) AS h, count(*) AS n FROM e GROUP BY part, k, e.h), {_tree_sql()} SELECT part, n, h AS digest FROM l{stats.LEVELS}"""
)
def result_digest(spark: SparkSession, d: str) -> DataFrame:
    return stats.result_digest(table(spark, d, "documents"), "doc_id", ["source", "text"], F.col("doc_id") % 8)


@query(
    """WITH a AS (SELECT DISTINCT source AS v FROM documents WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT source AS v FROM documents WHERE doc_id % 4 <> 9)
    SELECT (SELECT count(*) FROM a WHERE v NOT IN (SELECT v FROM b)) AS only_left, (SELECT count(*) FROM b WHERE v NOT IN (SELECT v FROM a)) AS only_right,
      (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS same_rows, NOT EXISTS (SELECT v FROM a EXCEPT SELECT v FROM b) AND NOT EXISTS (SELECT v FROM b EXCEPT SELECT v FROM a) AND (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS equal"""
)
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return stats.same_set(docs.filter("doc_id % 3 = 0").select("source").distinct(), docs.filter("doc_id % 4 <> 9").select("source").distinct())


# maintenance: old and new snapshots are cut from the items by id

_NEW = "SELECT CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS id, path, folder, name, thumb, width + 1 AS width, height, bytes + 5 AS bytes, modified + 1 AS modified, false AS favorite, 'fresh' AS tags, ocr, 'lost' AS notes, 'cpu-v3' AS model FROM items WHERE id % 4 < 2"
_OLD = "SELECT id, path, folder, name, thumb, width, height, bytes, modified, favorite, tags, ocr, notes, model FROM items WHERE id % 4 > 0"


@query(
    f"""{S.views('items')}, o AS ({_OLD}), n AS ({_NEW}) SELECT CASE WHEN o.path IS NULL THEN n.id ELSE o.id END AS id, coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN o.width ELSE n.width END AS width,
    coalesce(n.bytes, o.bytes) AS bytes, coalesce(n.modified, o.modified) AS modified, coalesce(o.favorite, n.favorite) AS favorite, coalesce(n.tags, o.tags) AS tags, coalesce(o.notes, n.notes) AS notes, CASE WHEN n.path IS NULL THEN o.model ELSE n.model END AS model
    FROM o FULL JOIN n ON n.path = o.path"""
)
def upsert_items(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    out = dml.upsert(run_sql(spark, d, _OLD, items=items), run_sql(spark, d, _NEW, items=items))
    return out.select("id", "path", "width", "bytes", "modified", "favorite", "tags", "notes", "model")


@query("SELECT path FROM (SELECT DISTINCT concat('/lib/', source) AS path FROM documents) UNION SELECT DISTINCT concat('/new/', lang) FROM documents")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = C.catalog(spark, d).folders
    new = docs.select(F.concat(F.lit("/new/"), "lang").alias("path")).unionByName(docs.select(F.concat(F.lit("/lib/"), "source").alias("path")))
    return dml.insert_or_ignore(old, new, "path")


_OFFER = "SELECT path, modified + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS modified, bytes, cast(7 AS int) AS version, embedding AS descriptor FROM items WHERE id % 2 = 0 AND embedding IS NOT NULL"


@query(
    f"""{S.views('items', 'app')}, o AS ({_OFFER}), g AS (SELECT i.id AS photo_id, o.modified, o.bytes, o.version FROM o JOIN items i ON i.path = o.path AND i.modified = o.modified AND i.bytes = o.bytes)
    SELECT photo_id, modified, bytes, version FROM app WHERE photo_id NOT IN (SELECT photo_id FROM g) UNION ALL SELECT * FROM g"""
)
def guarded_replace(spark: SparkSession, d: str) -> DataFrame:
    c = C.catalog(spark, d)
    return dml.guarded_replace(c.appearances, c.items, run_sql(spark, d, _OFFER, items=c.items)).drop("descriptor")


@query(
    f"""{S.views('items', 'app', 'thumbs', 'folders')}, l AS (SELECT * FROM items WHERE folder <> '/lib/src2') SELECT 'items' AS kept, count(*) AS n FROM l UNION ALL SELECT 'appearances', count(*) FROM app WHERE photo_id IN (SELECT id FROM l)
    UNION ALL SELECT 'thumbnails', count(*) FROM thumbs WHERE key IN (SELECT thumb FROM l) UNION ALL SELECT 'folders', count(*) FROM folders WHERE path <> '/lib/src2'"""
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    c = C.catalog(spark, d)
    left = dml.remove_folder(c.items, c.appearances, c.thumbnails, c.folders, "/lib/src2")
    counts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("kept"), "n") for n, x in zip(("items", "appearances", "thumbnails", "folders"), left, strict=True)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query(f"{S.views('items')} SELECT id, path FROM items WHERE folder NOT IN ('/lib/src1', '/lib/src4') OR id % 3 <> 0")
def prune_unseen(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    reachable = items.select("folder").distinct().filter(F.col("folder").isin("/lib/src1", "/lib/src4"))
    return dml.prune_unseen(items, items.filter("id % 3 <> 0").select("folder", "path"), reachable).select("id", "path")


@query(f"{S.views('items', 'thumbs')} SELECT key FROM thumbs WHERE key NOT IN (SELECT thumb FROM items)")
def orphan_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    c = C.catalog(spark, d)
    return dml.orphan_thumbnails(c.thumbnails, c.items).select("key")


@query(f"{S.views('items')} SELECT id, CASE WHEN id % 50 = 7 THEN substr(repeat('note ', 4000), 1, 16000) ELSE notes END AS notes, CASE WHEN id % 50 = 7 THEN NOT favorite ELSE favorite END AS favorite FROM items")
def update_notes(spark: SparkSession, d: str) -> DataFrame:
    some = F.col("id") % 50 == 7
    items = dml.set_notes(C.items(spark, d), some, F.repeat(F.lit("note "), 4000))
    return dml.set_favorite(items, some, ~F.col("favorite")).select("id", "notes", "favorite")


_FIRST = "SELECT path, folder, ordinal FROM (SELECT path, folder, 0 AS ordinal FROM items WHERE id % 2 = 0 UNION ALL SELECT path, '/lib' AS folder, 1 AS ordinal FROM items)"


@query(f"{S.views('items')} SELECT path, min_by(folder, ordinal) AS folder, min(ordinal)::INT AS ordinal FROM ({_FIRST}) GROUP BY path")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return dml.first_root_wins(run_sql(spark, d, _FIRST, items=C.items(spark, d)))


@query("SELECT sha256(encode(text)) AS key, any_value(octet_length(encode(text)))::INT AS size FROM documents GROUP BY 1")
def content_address(spark: SparkSession, d: str) -> DataFrame:
    return dml.content_addressed(table(spark, d, "documents"), "text").select("key", F.octet_length("data").alias("size"))


@query(
    """WITH h AS (SELECT doc_id AS id, sha256(encode(text)) AS h FROM documents), k AS (SELECT h, min(id) AS vec FROM h WHERE id % 10 = 0 GROUP BY h)
    SELECT h.id, k.vec, k.vec IS NOT NULL OR row_number() OVER (PARTITION BY h.h ORDER BY h.id) > 1 AS reused FROM h LEFT JOIN k ON k.h = h.h"""
)
def embedding_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    known = rows.filter("id % 10 = 0").groupBy("h").agg(F.min("id").alias("vec"))
    return dml.shared_results(rows, "h", known, "vec").select("id", "vec", "reused")


@query(f"{S.views('items')} SELECT thumb, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM items GROUP BY thumb")
def thumb_fanout(spark: SparkSession, d: str) -> DataFrame:
    return C.items(spark, d).groupBy("thumb").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# indexing

_FILES = """SELECT path, modified + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS modified, bytes FROM items WHERE id % 9 <> 8
  UNION ALL SELECT concat(path, '.new.png') AS path, modified, bytes FROM items WHERE id % 11 = 0"""


def _classified_sql(select: str, tail: str = "") -> str:
    return f"""{S.views('items', 'app')}, e AS (SELECT i.id, i.path, i.modified, i.bytes, coalesce(i.model IN ({S.CURRENT}) AND len(i.embedding) = {DIMENSIONS}, false) AS v, coalesce({_FIT}, false) AS l FROM items i LEFT JOIN app a ON a.photo_id = i.id),
    f AS ({_FILES}), c AS (SELECT f.path, f.modified, f.bytes, e.id AS item_id, CASE WHEN e.id IS NULL THEN 'new' WHEN e.modified <> f.modified OR e.bytes <> f.bytes THEN 'changed' WHEN NOT e.v THEN 'stale_vector' WHEN NOT e.l THEN 'stale_appearance' ELSE 'unchanged' END AS status,
      e.id IS NULL OR e.modified <> f.modified OR e.bytes <> f.bytes OR NOT e.v AS embed FROM f LEFT JOIN e ON e.path = f.path) SELECT {select} FROM c {tail}"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    c = C.catalog(spark, d)
    return indexing.classify(run_sql(spark, d, _FILES, items=c.items), stats.scan_entries(c, DIMENSIONS))


@query(_classified_sql("path, modified, bytes, item_id, status, embed"))
def scan_classify(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


@query(_classified_sql("status, count(*) AS n, sum(embed::INT)::BIGINT AS to_embed", "GROUP BY status"))
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return indexing.summary(_classified(spark, d))


@query(f"{S.views('items')} SELECT id, concat('broken: ', name) AS error FROM items WHERE id % 23 = 5 ORDER BY id LIMIT 30")
def errors_limited(spark: SparkSession, d: str) -> DataFrame:
    results = C.items(spark, d).select("id", F.when(F.col("id") % 23 == 5, F.concat(F.lit("broken: "), "name")).alias("error"))
    return indexing.error_log(indexing.split_errors(results)[1], "id")


@query(
    f"""{S.views('items')} SELECT folder, concat('{{"folder":"', folder, '","n":', count(*), ',"bytes":', sum(bytes)::BIGINT, '}}') AS json FROM items GROUP BY folder"""
)
def report_json(spark: SparkSession, d: str) -> DataFrame:
    rows = C.items(spark, d).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return rows.select("folder", F.to_json(F.struct("folder", "n", "bytes")).alias("json"))


@query("SELECT concat(sha256(encode(text)), '  ', 'doc-', doc_id, '.txt') AS line FROM documents")
def checksums_file(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.manifest import checksums

    rows = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), "text")
    return checksums(rows, "name", "text")


@query(
    """WITH e AS (SELECT p_partkey, p_name, p_size FROM part), r AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 17 <> 0)
    SELECT e.p_partkey, e.p_name, e.p_size, r.k IS NULL AS missing FROM e LEFT JOIN r ON r.k = e.p_partkey WHERE r.k IS NULL OR r.p_name IS DISTINCT FROM e.p_name OR r.p_size IS DISTINCT FROM e.p_size"""
)
def asset_diff(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.manifest import differing

    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    remote = part.filter("p_partkey % 17 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return differing(part, remote, "p_partkey", ("p_name", "p_size"))


# postings

_POST = " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest(range(0, len(w)))::BIGINT AS pos, unnest(w) AS term FROM (SELECT id, {S.tokens(S.search_name('name') if c == 'search_name' else c)} AS w FROM {{}})" for c, _ in lexical.TEXT_COLUMNS)


@query(f"{S.views('items')} {_POST.replace('{}', 'items')}")
def postings_full(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(C.items(spark, d))


_EDITED = "(SELECT * REPLACE (CASE WHEN id % 20 = 3 THEN 'edited note' ELSE notes END AS notes) FROM items WHERE id % 20 <> 4)"


@query(f"{S.views('items')} {_POST.replace('{}', _EDITED)}")
def postings_incremental(spark: SparkSession, d: str) -> DataFrame:
    items = C.items(spark, d)
    edited = items.withColumn("notes", F.when(F.col("id") % 20 == 3, F.lit("edited note")).otherwise(F.col("notes"))).filter("id % 20 <> 4")
    return lexical.updated_postings(lexical.postings(items), edited, items.filter("id % 20 in (3, 4)").select("id"))


@query(f"{S.views('items')} SELECT term, count(DISTINCT id) AS n_items, count(*) AS n_tokens FROM ({_POST.replace('{}', 'items')}) GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_statistics(C.items(spark, d))


@query(rf"""SELECT p_partkey, {S.search_name("concat(replace(initcap_name, ' ', ''), p_partkey, 'HDIcon.png')")} AS readable FROM (SELECT p_partkey, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2, 2), upper(substr(p_name, 4, 1)), substr(p_name, 5)) AS initcap_name FROM part)""")
def split_identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_name")
    name = F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2), F.upper(F.substring(p, 4, 1)), F.expr("substr(p_name, 5)"))
    made = F.concat(F.regexp_replace(name, " ", ""), F.col("p_partkey").cast("string"), F.lit("HDIcon.png"))
    return table(spark, d, "part").select("p_partkey", text.search_name(made).alias("readable"))
