"""SQL fragments the checks are put together from (DuckDB dialect)."""

from __future__ import annotations

from ..sources import driver_tables as D

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
TOK = r"list_filter(regexp_split_to_array(lower({x}), '[\n\r\p{{Z}}\p{{P}}]+'), lambda t: t <> '')"
STOPS = "['" + "','".join(__import__("quillspark.functions.text", fromlist=["x"]).STOP_WORDS) + "']"
RTOK = (
    "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), "
    "lambda t: length(t) >= 2 AND NOT list_contains(" + STOPS + ", t))"
)


def tok(x: str) -> str:
    return TOK.format(x=x)


def rtok(x: str) -> str:
    return RTOK.format(x=x)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


NOTES, QUERIES, GOLD, CASES, MAP, DECISIONS = (
    D.NOTES_SQL, D.QUERIES_SQL, D.GOLD_SQL, D.CASES_SQL, D.MAP_SQL, D.DECISIONS_SQL,
)
CASE_PARTS = (NOTES, QUERIES, GOLD, CASES)

POSTINGS = f"""
flds AS (
  SELECT path, field, toks, len(list_distinct(toks)) AS flen FROM (
    SELECT path, 'title' AS field, {tok('title')} AS toks FROM notes
    UNION ALL
    SELECT path, 'tags', {tok("type_tag || ' project/' || source || ' topic/' || lang")} FROM notes
    UNION ALL
    SELECT path, 'content', {tok('content')} FROM notes)),
postings AS (
  SELECT path, field, term, count(*) AS tf, any_value(flen) AS flen
  FROM (SELECT path, field, flen, unnest(toks) AS term FROM flds) GROUP BY 1, 2, 3),
field_stats AS (SELECT field, count(*) AS n_notes, avg(flen) AS avg_len FROM flds GROUP BY 1),
dfs AS (SELECT term, field, count(*) AS df FROM postings GROUP BY 1, 2)
"""


# The SQL engine counts edits in bytes; accented letters become one-byte stand-ins first.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿßœæ"


def edits(a: str, b: str) -> str:
    to = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&"[: len(ACCENTED)]
    return f"levenshtein(translate({a}, '{ACCENTED}', '{to}'), translate({b}, '{ACCENTED}', '{to}'))"


def terms(name: str, source: str, column: str) -> str:
    """(query_id, source_term, term, weight) of exact terms."""
    return f"""
{name} AS (
  SELECT query_id, t AS source_term, t AS term, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT query_id, unnest({tok(column)}) AS t FROM {source}) GROUP BY 1, 2, 3)
"""


def expanded(name: str, source: str, column: str) -> str:
    """The same with extensions and near spellings from the dictionary."""
    return f"""
{name}_q AS (
  SELECT query_id, t AS source_term, count(*) AS n
  FROM (SELECT query_id, unnest({tok(column)}) AS t FROM {source}) GROUP BY 1, 2),
{name}_d AS (
  SELECT s.source_term, v.term,
    CASE WHEN v.term = s.source_term THEN 1.0
         WHEN starts_with(v.term, s.source_term)
           THEN 0.375 * length(v.term) / (length(v.term) + 0.3 * (length(v.term) - length(s.source_term)))
         ELSE 0.45 * length(v.term) / (length(v.term) + {edits("v.term", "s.source_term")}) END AS w
  FROM (SELECT DISTINCT source_term FROM {name}_q) s
  JOIN (SELECT DISTINCT term FROM dfs UNION SELECT DISTINCT source_term FROM {name}_q) v
    ON v.term = s.source_term OR starts_with(v.term, s.source_term)
    OR (abs(length(v.term) - length(s.source_term)) <= least(6, floor(length(s.source_term) * 0.2 + 0.5))
        AND {edits("v.term", "s.source_term")} <= least(6, floor(length(s.source_term) * 0.2 + 0.5)))),
{name} AS (
  SELECT q.query_id, q.source_term, d.term, d.w * q.n AS weight FROM {name}_q q JOIN {name}_d d USING (source_term))
"""


def hits(name: str, terms_name: str, k: int, where: str = "TRUE", session_asked: bool = False) -> str:
    """Ranked keyword hits (query_id, path, score, rank)."""
    session = "1.0" if session_asked else "CASE WHEN n.type_tag = 'type/session' THEN 0.3 ELSE 1.0 END"
    return f"""
{name}_s AS (
  SELECT t.query_id, p.path,
    sum(t.weight * CASE p.field WHEN 'title' THEN 3.0 WHEN 'tags' THEN 2.0 ELSE 1.0 END
        * ln(1 + (s.n_notes - d.df + 0.5) / (d.df + 0.5))
        * (0.5 + p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.7 + 0.7 * p.flen / s.avg_len))))
      * count(DISTINCT t.source_term) AS raw
  FROM {terms_name} t JOIN postings p USING (term) JOIN dfs d ON d.term = p.term AND d.field = p.field
  JOIN field_stats s ON s.field = p.field GROUP BY 1, 2),
{name}_b AS (
  SELECT h.query_id, h.path, round(h.raw
    * CASE WHEN n.created_at >= TIMESTAMP '{D.AS_OF}' THEN 1.5
           WHEN n.created_at >= TIMESTAMP '{D.AS_OF}' - INTERVAL 7 DAY THEN 1.3
           WHEN n.created_at < TIMESTAMP '{D.AS_OF}' - INTERVAL 30 DAY THEN 0.7 ELSE 1.0 END
    * {session} * CASE WHEN n.type_tag = 'type/digest' THEN 1.5 ELSE 1.0 END, 6) AS score
  FROM {name}_s h JOIN notes n USING (path) WHERE {where}),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM {name}_b)
  WHERE rank <= {k})
"""


ROUTABLE = "n.type_tag = 'type/brief'"

CHUNKS = rf"""
parts AS (
  SELECT path, title, unnest(regexp_split_to_array(content, '\n## ')) AS part,
         unnest(range(len(regexp_split_to_array(content, '\n## ')))) AS ord FROM notes),
secs AS (
  SELECT path, title, ord,
    CASE WHEN ord = 0 THEN '' ELSE trim(split_part(part, chr(10), 1), {WS}) END AS heading,
    trim(CASE WHEN ord = 0 THEN regexp_replace(part, '\A# [^\n]*', '') 
              ELSE substr(part, length(split_part(part, chr(10), 1)) + 1) END, {WS}) AS body
  FROM parts),
chunks AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS chunk_ix, heading,
    trim(concat_ws(chr(10), nullif(title, ''), nullif(heading, ''), nullif(body, '')), {WS}) AS text
  FROM secs WHERE heading <> '' OR body <> '')
"""


def sparse(name: str, source: str, keys: str, column: str) -> str:
    """Sparse hashed vectors (keys, dim, v) scaled to unit length."""
    return f"""
{name}_w AS (
  SELECT {keys}, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS dim,
         CASE WHEN CAST('0x' || substr(md5(w), 5, 1) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS sign
  FROM (SELECT {keys}, unnest({tok(column)}) AS w FROM {source})),
{name}_v AS (SELECT {keys}, dim, sum(sign) AS v FROM {name}_w GROUP BY ALL),
{name} AS (
  SELECT {keys}, dim, v / sqrt(sum(v * v) OVER (PARTITION BY {keys})) AS v FROM {name}_v WHERE v <> 0)
"""


def semantic(k: int) -> str:
    """Chunk hits (sem_chunks) and note hits (sem) of the offline embedder."""
    return f"""
{CHUNKS.strip()},
{sparse('cv', 'chunks', 'path, chunk_ix', 'text').strip()},
{sparse('qv', 'queries', 'query_id', 'query').strip()},
sims AS (
  SELECT q.query_id, c.path, c.chunk_ix,
         round(coalesce(s.score, 0.0), 6) + 0.0 AS score
  FROM (SELECT DISTINCT query_id FROM queries) q CROSS JOIN (SELECT path, chunk_ix FROM chunks) c
  LEFT JOIN (SELECT a.query_id, b.path, b.chunk_ix, sum(a.v * b.v) AS score FROM qv a JOIN cv b USING (dim)
             GROUP BY 1, 2, 3) s USING (query_id, path, chunk_ix)),
sem_chunks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
    path || chr(1) || lpad(CAST(chunk_ix AS VARCHAR), 8, '0')) AS rank FROM sims) WHERE rank <= {k}),
sem AS (
  SELECT query_id, path, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank
  FROM sem_chunks GROUP BY query_id, path)
"""


def fused(name: str, lists: list[str], pins: str | None = None, limit: int | None = None) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, path, rank FROM {x}" for x in lists)
    join = f"LEFT JOIN {pins} p USING (query_id, path)" if pins else ""
    order = ("p.pin_ord NULLS LAST, " if pins else "") + "score DESC, path"
    cut = f"WHERE rank <= {limit}" if limit else ""
    return f"""
{name}_u AS (
  SELECT query_id, path, round(sum(1.0::DOUBLE / (60 + rank))
    * CASE WHEN starts_with(path, 'sessions/') AND NOT starts_with(path, 'sessions/digests/') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score
  FROM ({union}) GROUP BY query_id, path),
{name} AS (
  SELECT query_id, path, score, rank FROM (
    SELECT u.query_id, u.path, u.score, row_number() OVER (PARTITION BY u.query_id ORDER BY {order.replace('score', 'u.score').replace(', path', ', u.path')}) AS rank
    FROM {name}_u u {join}) {cut})
"""


def candidates(name: str, topic_source: str, top2: str) -> str:
    """Routing candidates per topic from ``topic_source`` (query_id, topic)."""
    return f"""
{name}_t AS (SELECT query_id, trim(lower(topic), {WS}) AS topic FROM {topic_source}),
{name} AS (
  SELECT t.query_id, t.topic, m.path AS mapped, a.path AS top_path, a.score AS top_score, b.score AS second_score,
    round(CASE WHEN b.score > 0 THEN a.score / b.score END, 6) AS margin,
    coalesce(trim(lower(n.title), {WS}) = t.topic, FALSE) AS exact,
    coalesce(list_has_any({rtok('t.topic')}, list_filter(list_concat({rtok('n.title')},
        {rtok("regexp_replace(split_part(n.path, '/', -1), '.md$', '')")}), lambda z: z <> 'brief')), FALSE)
      OR EXISTS (SELECT 1 FROM brief_map bm WHERE bm.path = a.path AND list_has_any({rtok('t.topic')}, {rtok('bm.keyword')})) AS trig
  FROM {name}_t t LEFT JOIN brief_map m ON m.keyword = t.topic
  LEFT JOIN (SELECT * FROM {top2} WHERE rank = 1) a ON a.query_id = t.query_id
  LEFT JOIN (SELECT * FROM {top2} WHERE rank = 2) b ON b.query_id = t.query_id
  LEFT JOIN notes n ON n.path = a.path)
"""


def decided(name: str, cand: str, floor: str = "4.0", margin: str = "1.3", extra: str = "") -> str:
    return f"""
{name} AS (
  SELECT query_id, {extra} CASE method WHEN 'direct_map' THEN mapped WHEN 'abstain' THEN NULL ELSE top_path END AS path, method,
    CASE WHEN method <> 'direct_map' THEN top_score END AS score,
    CASE WHEN method IN ('tag_search', 'abstain') THEN margin END AS margin
  FROM (SELECT *, CASE WHEN mapped IS NOT NULL THEN 'direct_map' WHEN exact THEN 'exact_title'
      WHEN coalesce(top_score >= {floor}, FALSE) AND (margin IS NULL OR margin >= {margin}) AND trig THEN 'tag_search'
      ELSE 'abstain' END AS method FROM {cand}))
"""


LINKS = rf"""
raw_links AS (
  SELECT DISTINCT path AS src, trim(regexp_extract(t, '^([^|#]*)', 1), {WS}) AS target FROM (
    SELECT path, unnest(regexp_extract_all(
      regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`\n]*`', '', 'g'), '\[\[([^\]]+)\]\]', 1)) AS t
    FROM notes)),
link_rows AS (SELECT * FROM raw_links WHERE target <> '' AND NOT starts_with(target, '...')),
tkeys AS (
  SELECT lower(regexp_replace(path, '\.md$', '')) AS key, 0 AS tier, path FROM notes
  UNION ALL SELECT lower(regexp_replace(split_part(path, '/', -1), '\.md$', '')), 1, path FROM notes
  UNION ALL SELECT 'b' || doc_id, 2, path FROM notes WHERE kind = 3
  UNION ALL SELECT replace(lower(regexp_replace(title, '\.md$', '')), '\', '/'), 3, path FROM notes),
best_keys AS (
  SELECT key, tier, path FROM (
    SELECT *, row_number() OVER (PARTITION BY key, tier ORDER BY length(path), path) AS r FROM tkeys WHERE key <> '') WHERE r = 1),
links AS (
  SELECT src, target, (SELECT arg_min(b.path, b.tier) FROM best_keys b
      WHERE (b.tier = 1 AND b.key = split_part(l.k, '/', -1)) OR (b.tier <> 1 AND b.key = l.k)) AS dst
  FROM (SELECT *, replace(lower(regexp_replace(target, '\.md$', '')), '\', '/') AS k FROM link_rows) l),
edges AS (SELECT DISTINCT src, dst FROM links WHERE dst IS NOT NULL AND dst <> src)
"""

SESSIONS = """
sess AS (
  SELECT path, title, created_at, 'src' || (doc_id % 20) AS project0, source AS project, [w6, w12] AS topics,
         ['src/mod' || (doc_id % 10) || '.py'] AS files, doc_id
  FROM (SELECT n.*, t.w6, t.w12 FROM notes n JOIN titled t USING (doc_id)) WHERE kind = 0)
"""
