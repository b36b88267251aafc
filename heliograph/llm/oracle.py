"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from . import fill_middle, mixing, prefix_trie, quality_rules, warc

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def op1() -> str:
    return """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    n AS (SELECT r, doc_id, h, length(h) // 2 AS n_bytes FROM d),
    s AS (SELECT r, unnest(range(0, n_bytes - 199)) AS pos, h FROM n WHERE n_bytes >= 200),
    k AS (SELECT r, pos, md5(substr(h, 2 * pos + 1, 400)) AS k FROM s),
    twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
    fresh AS (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 200 THEN 0 ELSE 1 END AS f FROM twice),
    islands AS (SELECT r, pos, sum(f) OVER (PARTITION BY r ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM fresh),
    spans AS (SELECT r, i, min(pos) AS s, max(pos) + 200 AS e FROM islands GROUP BY r, i),
    gaps AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS before FROM spans),
    cut AS (SELECT g.r, sum(g.e - g.s) AS removed, count(*) AS spans, max(g.e) AS tail, string_agg(substr(n.h, 2 * g.before + 1, 2 * (g.s - g.before)), '' ORDER BY g.s) AS kept
            FROM gaps g JOIN n USING (r) GROUP BY g.r)
    SELECT n.doc_id, n.n_bytes::BIGINT AS n_bytes, coalesce(c.removed, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
      sha256(unhex(CASE WHEN c.r IS NULL THEN n.h ELSE c.kept || substr(n.h, 2 * c.tail + 1) END)) AS kept_sha256
    FROM n LEFT JOIN cut c ON c.r = n.r
    """


def op2() -> str:
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(mixing.WEIGHTS))
    most = mixing.MOST_PASSES
    times = []
    for k, knots in enumerate(mixing.SCHEDULES):
        whole = sum((t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False))
        done, cases = 0.0, []
        for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False):
            slope, due = (f1 - f0) / (t1 - t0), f"(share * {whole!r}::DOUBLE - {done!r}::DOUBLE)"
            step = f"{due} / {f0!r}::DOUBLE" if slope == 0 else f"(sqrt(greatest({f0 * f0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {due}, 0.0::DOUBLE)) - {f0!r}::DOUBLE) / {slope!r}::DOUBLE"
            done += (t1 - t0) * (f0 + f1) / 2
            cases.append(f"WHEN share * {whole!r}::DOUBLE <= {done!r}::DOUBLE THEN {t0!r}::DOUBLE + {step}")
        times.append(f"WHEN class = {k} THEN CASE {' '.join(cases)} ELSE {knots[-1][0]!r}::DOUBLE END")
    return f"""
    WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5('{mixing.SEED}' || coalesce(doc_id::VARCHAR, '#' || coalesce(text, ''))) AS o FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    c AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS class FROM s),
    w AS (SELECT *, CASE class {weights} END::BIGINT AS weight, source_size * {most} AS cap FROM c),
    l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left
          FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, min(CASE WHEN cap * weight_left < words_left * weight THEN 1 ELSE 0 END) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS capped FROM l),
    t AS (SELECT source, class, source_size, CASE WHEN capped = 1 THEN cap::DOUBLE
            ELSE ((sum(source_size) OVER () - sum(CASE WHEN capped = 1 THEN cap ELSE 0 END) OVER ())::BIGINT * weight)::DOUBLE
               / (sum(CASE WHEN capped = 1 THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM f),
    p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.class, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
          FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
    q AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE floor(target / greatest(source_size, 1))::BIGINT
            + CASE WHEN before + size / 2.0::DOUBLE < target - floor(target / greatest(source_size, 1)) * source_size THEN 1 ELSE 0 END END AS passes,
            least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS share FROM p)
    SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken,
      CASE WHEN passes > 0 THEN round(round(CASE {' '.join(times)} END, 9), 6) END AS position FROM q
    """


def op4() -> str:
    parts = []
    for k in range(4):
        value = f"('0x' || substr(h, {10 * k + 1}, 10))::BIGINT"
        parts += [f"substr('{warc.BASE32}', ((({value}) >> {s}) & 31)::INT + 1, 1)" for s in range(35, -1, -5)]
    return f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    x AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, sha256(b) AS k FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS top, row_number() OVER (PARTITION BY k ORDER BY page_id DESC) AS nth FROM x)
    SELECT page_id, payload_bytes, {' || '.join(parts)} AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN nth = 1 THEN NULL ELSE top END AS refers_to FROM m
    """


def op7() -> str:
    return """
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
    n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles, md5(array_to_string(list_sort(g), chr(10))) AS k FROM s),
    reps AS (SELECT k, min(doc_id) AS id, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY k),
    e AS (SELECT r.id, r.n, unnest(s.g) AS g FROM reps r JOIN s ON s.doc_id = r.id),
    pairs AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
              GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach(id, r) AS (SELECT id, id FROM reps UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
    c AS (SELECT reps.k, min(reach.r) AS component_id FROM reach JOIN reps ON reps.id = reach.id GROUP BY reps.k)
    SELECT n.doc_id, n.n_shingles, CASE WHEN n.n_shingles > 0 THEN c.component_id ELSE n.doc_id END AS component_id,
      n.doc_id = CASE WHEN n.n_shingles > 0 THEN c.component_id ELSE n.doc_id END AS kept
    FROM n LEFT JOIN c ON c.k = n.k
    """


def op10() -> str:
    q = quality_rules
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    visible = lambda x: f"length(translate({x}, {space}, ''))"
    quiet = lambda x: f"translate({x}, {_quoted(q.NOISE)}, '')"
    fails = (
        f"({visible('x')} - {visible(quiet('x'))}) - {q.FREE_MARKS} > {visible('x')} * {q.NOISE_SHARE}::DOUBLE"
        f" OR (NOT regexp_matches(x, {_quoted(q.CLOSED)}) AND NOT regexp_matches(x, {_quoted(f'^{q.SPACE}*({q.WORD}+{q.SPACE}+){{{q.SHORT_LINE - 1}}}{q.WORD}')}) AND NOT regexp_matches(x, {_quoted(q.LONG_UNSPACED)}))"
        f" OR regexp_matches(x, {_quoted(q.NAVIGATION)}) OR regexp_matches(x, {_quoted(q.BOILERPLATE)})"
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
    g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
    covered AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
    lines AS (SELECT r, p, x FROM (SELECT r, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM (SELECT r, string_split(t, chr(10)) AS l FROM d)) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
    own AS (SELECT r, x, min(p) AS p, count(*) AS n FROM lines GROUP BY r, x),
    l AS (SELECT r, sum(n - 1)::BIGINT AS dup, sum(CASE WHEN {fails} THEN 0 ELSE {visible('x')} END)::BIGINT AS kept_chars FROM own GROUP BY r),
    o AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, {visible('d.t')}::BIGINT AS word_chars, (length(d.t) - length(translate(d.t, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
        coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.kept_chars, 0)::BIGINT AS left_chars
      FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN covered c ON c.r = d.r),
    v AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
    SELECT *, NOT base_failed AND left_chars >= word_chars * {1 - q.LOSS}::DOUBLE AS kept FROM v
    """


def op12() -> str:
    f = fill_middle
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    cut = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    marked = " OR ".join(f"contains(t, '{m}')" for m in (f.PREFIX, f.SUFFIX, f.MIDDLE))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{f.LINE}') AS u, sha256('{f.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    c AS (SELECT *, len(u) AS n, {number(0)} % (len(u) + 1) AS c1, {number(1)} % (len(u) + 1) AS c2,
            CASE WHEN t = '' OR {marked} OR {number(2)} % 100 >= {f.RATE} THEN 'plain' WHEN {number(3)} % 100 < {f.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, {cut(1, "least(c1, c2)")} AS prefix, {cut("least(c1, c2) + 1", "greatest(c1, c2)")} AS middle, {cut("greatest(c1, c2) + 1", "n")} AS suffix FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '{f.PREFIX}' || prefix || '{f.SUFFIX}' || suffix || '{f.MIDDLE}' || middle
             WHEN 'spm' THEN '{f.SUFFIX}' || suffix || '{f.PREFIX}' || prefix || '{f.MIDDLE}' || middle ELSE t END) AS output_sha256,
      sha256(CASE WHEN form = 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256 FROM p
    """


def op13() -> str:
    t = prefix_trie
    bits = "list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, 3988292384::BIGINT * (p & 1)))"
    crc32 = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(str_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {bits}), 4294967295)"
    return f"""
    WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {crc32} % {t.MOST_HEAD + 1} AS h FROM (SELECT DISTINCT conv_id FROM o)),
    r AS (SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {t.BASE} AND o.pos < c.h
          UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
    p AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, ',') OVER w) AS k, length(text) AS chars
          FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
          UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    l AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id),
    q AS (SELECT p.*, l.n = p.depth AS ends, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p JOIN l USING (conv_id)),
    g AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY depth, k),
    ch AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
    n AS (SELECT g.*, coalesce(ch.n_children, 0) AS n_children FROM g LEFT JOIN ch USING (depth, k)),
    s AS (SELECT p.depth, p.k, sum((n.n_convs - 1) * n.chars) AS saved_tokens, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
          FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.k)
    SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
      s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM n JOIN s USING (depth, k) LEFT JOIN n u ON u.depth = n.depth - 1 AND u.k = n.up
    """


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": op1(), "op2_mixing": op2(), "op4_warc": op4(), "op7_near_dedup": op7(), "op10_quality_rules": op10(), "op12_fill_middle": op12(), "op13_prefix_trie": op13()}
