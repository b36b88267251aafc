"""SQL text, for DuckDB, of the catalog views and of searches over them."""

from __future__ import annotations

from ..functions.text import STOP_WORDS, Term, parse_query
from ..operators.lexical import B, BASE, K1, LEAST_IDF, SPREAD, TRUST
from ..operators.search import EXACT_NAME, REASONS
from ..schema import CURRENT_MODELS, DIMENSIONS, OLDER_MODELS, TEXT_COLUMNS, TRUSTED_COLUMNS, Mode, Orientation, SearchRequest, Similarity, Sort
from ..sources.catalog import APPEARANCES_SQL, FOLDERS_SQL, ITEMS_SQL, THUMBNAILS_SQL

VIEWS = {"items": ITEMS_SQL, "app": APPEARANCES_SQL, "thumbs": THUMBNAILS_SQL, "folders": FOLDERS_SQL}
MODELS = ", ".join(f"'{m}'" for m in (*CURRENT_MODELS, *OLDER_MODELS))
CURRENT = ", ".join(f"'{m}'" for m in CURRENT_MODELS)
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def spaced(x: str) -> str:
    """An identifier with a space at its boundaries, without look-around: one step a kind, digits beside letters twice."""
    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})", r"(\p{N})(\p{L})"):
        x = rf"regexp_replace({x}, '{pattern}', '\1 \2', 'g')"
    return x


def search_name(x: str) -> str:
    return f"CASE WHEN {spaced(x)} = {x} THEN '' ELSE {spaced(x)} END"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def norm2(v: str) -> str:
    return f"list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE))"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: (x::DOUBLE / sqrt({norm2(v)}))::FLOAT)"


def focused(v: str, kind: Similarity, d: int = DIMENSIONS) -> str:
    from ..functions.vectors import parts

    return "list_concat(" + ", ".join(f"{v}[{s + 1}:{s + n}]" for s, n in parts(kind, d)) + ")"


def scope(r: SearchRequest) -> str:
    out = []
    if r.extension:
        out.append(f"lower(regexp_extract(name, '\\.([^.]*)$', 1)) = '{r.extension.lower()}'")
    if r.favorites:
        out.append("favorite")
    if r.folder:
        out.append(f"folder = '{r.folder}'")
    if r.orientation is not Orientation.ALL:
        out.append("width " + {Orientation.LANDSCAPE: ">", Orientation.PORTRAIT: "<", Orientation.SQUARE: "="}[r.orientation] + " height")
    return " AND ".join(out) or "true"


def _hits(column: str, term: Term) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in term.words) + "]"
    if len(term.words) > 1:
        return f"len(list_filter(range(1, len({column}) + 1), lambda i: {column}[i:i + {len(term.words) - 1}] = {words}))"
    test = f"starts_with(x, '{term.words[0]}')" if term.prefix else f"x = '{term.words[0]}'"
    return f"len(list_filter({column}, lambda x: {test}))"


def lexical(query: str, mode: Mode = Mode.HYBRID, where: str = "true") -> str:
    """CTEs that end in lex(id, relevance, trusted, lexical), over items."""
    terms = parse_query(query, mode is Mode.TEXT)
    if not terms:
        return "lex AS (SELECT id, 0::DOUBLE AS relevance, false AS trusted, 0::DOUBLE AS lexical FROM items WHERE false)"
    fields = [f"{tokens(search_name('name') if c == 'search_name' else c)} AS t_{c}" for c, _ in TEXT_COLUMNS]
    counts = []
    for i, t in enumerate(terms):
        counts.append(" + ".join(_hits(f"t_{c}", t) for c, _ in TEXT_COLUMNS) + f" AS h{i}")
        counts.append(" + ".join(f"{_hits(f't_{c}', t)} * {w}::DOUBLE" for c, w in TEXT_COLUMNS) + f" AS f{i}")
        counts.append("(" + " + ".join(_hits(f"t_{c}", t) for c in TRUSTED_COLUMNS) + f") > 0 AS r{i}")
    n = range(len(terms))
    idf = [f"CASE WHEN ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) <= 0 THEN {LEAST_IDF}::DOUBLE ELSE ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END" for i in n]
    score = " + ".join(f"({idf[i]}) * (f{i} * {K1 + 1}::DOUBLE) / (f{i} + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * l / mean))" for i in n)
    return f"""
    tok AS (SELECT *, {', '.join(fields)} FROM items),
    hit AS (SELECT *, {' + '.join(f'len(t_{c})' for c, _ in TEXT_COLUMNS)} AS l, {', '.join(counts)} FROM tok),
    stat AS (SELECT count(*) AS n, avg(l) AS mean, {', '.join(f'sum(CASE WHEN h{i} > 0 THEN 1 ELSE 0 END)::BIGINT AS n{i}' for i in n)} FROM hit),
    rel AS (SELECT id, {score} AS relevance, {' AND '.join(f'r{i}' for i in n)} AS trusted FROM hit, stat WHERE {' AND '.join(f'h{i} > 0' for i in n)} AND {where}),
    lex AS (SELECT id, relevance, trusted, CASE WHEN max(relevance) OVER () > 0 THEN {BASE}::DOUBLE + {SPREAD}::DOUBLE * relevance / max(relevance) OVER () ELSE relevance END
              + CASE WHEN trusted THEN {TRUST}::DOUBLE ELSE 0 END AS lexical FROM rel)"""


def vectors(kind: Similarity) -> str:
    """A CTE vec(all of items, vector, available)."""
    if kind is Similarity.SUBJECT:
        good = f"coalesce(model IN ({MODELS}), false) AND coalesce(len(embedding) = {DIMENSIONS} AND {norm2('embedding')} >= 1e-12, false)"
        return f"vec AS (SELECT * EXCLUDE (embedding), {good} AS available, CASE WHEN {good} THEN {unit('embedding')} END AS vector FROM items)"
    good = f"coalesce(len(descriptor) = {DIMENSIONS} AND {norm2('descriptor')} >= 1e-12, false)"
    base = f"CASE WHEN {good} THEN {unit('descriptor')} END"
    if kind is not Similarity.APPEARANCE:
        f = focused("u", kind)
        base = f"list_transform({f}, lambda x: x::DOUBLE / sqrt({norm2(f)}))"
        inner = f"(SELECT i.* EXCLUDE (embedding), a.descriptor, CASE WHEN {good} THEN {unit('descriptor')} END AS u FROM items i LEFT JOIN app a ON a.photo_id = i.id AND a.version = 1 AND a.modified = i.modified AND a.bytes = i.bytes)"
        return f"vec AS (SELECT * EXCLUDE (descriptor, u), {good} AS available, {base} AS vector FROM {inner})"
    return f"vec AS (SELECT i.* EXCLUDE (embedding), {good} AS available, {base} AS vector FROM items i LEFT JOIN app a ON a.photo_id = i.id AND a.version = 1 AND a.modified = i.modified AND a.bytes = i.bytes)"


def search(r: SearchRequest, query_vector: str | None = None, columns: str = "id, name, round(score, 6) AS score, reason", paged: bool = True) -> str:
    """The page of a request.  query_vector: SQL of a vector, where text has one."""
    text, ctes = r.text, []
    by_vector = r.similar_id is not None or query_vector is not None and (r.has_reference or r.mode is not Mode.TEXT)
    kind = r.similarity if r.has_reference else Similarity.SUBJECT
    ctes.append(f"items AS ({ITEMS_SQL})")
    if kind is not Similarity.SUBJECT:
        ctes.append(f"app AS ({APPEARANCES_SQL})")
    if by_vector:
        ctes.append(vectors(kind))
    own = f"(SELECT vector FROM vec WHERE id = {r.similar_id})" if r.similar_id is not None else query_vector
    uses_text = bool(text) and (r.mode is not Mode.VISUAL or not by_vector)
    if uses_text:
        ctes.append(lexical(r.query, r.mode, scope(r)))
    where = [scope(r)]
    if r.similar_id is not None:
        where += [f"id <> {r.similar_id}", "available"]
    elif r.reference_path:
        where += [f"path <> '{r.reference_path}'", "available"]
    cosine = f"CASE WHEN available THEN {dot('vector', own)} ELSE 0 END" if by_vector else "0::DOUBLE"
    exact = f"CASE WHEN lower(name) = '{text.lower()}' OR lower(regexp_replace(name, '\\.[^.]*$', '')) = '{text.lower()}' THEN {EXACT_NAME}::DOUBLE ELSE 0 END" if text and r.mode is not Mode.VISUAL else "0"
    evidence = "coalesce(lex.lexical, 0::DOUBLE)" if uses_text else "0::DOUBLE"
    if text:
        where.append(("available OR " if by_vector else "") + ("lex.id IS NOT NULL" if uses_text else "false"))
    source = "vec" if by_vector else "items"
    joined = f"{source} s" + (" LEFT JOIN lex USING (id)" if uses_text else "")
    other = REASONS[r.similarity] if r.has_reference else "Visual meaning" if by_vector else ""
    ctes.append(f"scored AS (SELECT id, name, path, width, height, modified, {cosine} + {evidence} + {exact} AS score, {evidence} AS evidence FROM {joined} WHERE {' AND '.join(f'({w})' for w in where)})")
    ctes.append(f"result AS (SELECT *, CASE WHEN evidence >= 0.25 THEN 'Filename / description match' WHEN evidence > 0 THEN 'Text found in labels or image' ELSE '{other}' END AS reason FROM scored)")
    base = "modified DESC, id DESC"
    by = {Sort.NEWEST: base, Sort.OLDEST: "modified ASC, id DESC", Sort.NAME: f"lower(name), {base}", Sort.LARGEST: f"width::BIGINT * height DESC, {base}", Sort.RELEVANCE: f"score DESC, {base}" if by_vector or text else base}[r.sort]
    tail = f" ORDER BY {by} LIMIT {r.limit} OFFSET {r.offset}" if paged else ""
    return f"WITH {', '.join(ctes)} SELECT {columns} FROM result{tail}"
