"""Registered queries over the driver's tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, markdown, redact, text
from ..operators import (
    answers,
    blockmax,
    capture,
    context,
    evals,
    fusion,
    graph,
    health,
    ivf,
    keyword,
    lifecycle,
    proposals,
    routing,
    vector,
)
from ..session import apply_conf, shared_root, work_dir, written
from ..sources import driver_tables as D
from ..sources import files as log_files
from ..sources import notes as note_source
from ..streaming import jobs
from . import oracle_sql as S
from . import search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = D.AS_OF
K = 5


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[["Corpus"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Corpus(apply_conf(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@dataclass
class Corpus:
    """Lazily planned tables of one run. Nothing here is computed before it is used."""

    spark: SparkSession
    sf_dir: str
    kept: dict = field(default_factory=dict, compare=False, repr=False)

    def once(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """What a query reads several times and is small beside the notes: planned once, stored and read from there."""
        if name not in self.kept:
            self.kept[name] = written(rows(), name)
        return self.kept[name]

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.sf_dir, name)

    @cached_property
    def notes(self) -> DataFrame:
        return D.notes(self.spark, self.sf_dir)

    @cached_property
    def queries(self) -> DataFrame:
        return D.queries(self.spark, self.sf_dir)

    @property
    def gold(self) -> DataFrame:
        return self.once("gold", lambda: D.gold(self.spark, self.sf_dir))

    @cached_property
    def cases(self) -> DataFrame:
        return D.cases(self.spark, self.sf_dir, self.gold)

    @property
    def brief_map(self) -> DataFrame:
        return self.once("map", lambda: routing.build_map(routing.note_keywords(self.notes), D.file_map(self.cases)))

    @cached_property
    def index_root(self) -> str:
        """A folder for the index of the notes as their files are now."""
        files = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        return f"{shared_root(self.spark)}/index-{blockmax.state_of(files)}"

    @cached_property
    def index(self) -> blockmax.StoredIndex:
        """Loaded from shared storage; built by the first query that asks for it."""
        return blockmax.current(self.spark, lambda: self.notes, self.index_root)

    @cached_property
    def vector_index(self) -> ivf.VectorIndex:
        """Loaded from shared storage if the vectors' files are as they were, else built."""
        files = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet")
        root = f"{shared_root(self.spark)}/vectors-{blockmax.state_of(files)}"
        return ivf.load(self.spark, root) or ivf.publish(_vector_items(self), root)

    def hits(self, limit: int, **options) -> DataFrame:
        return keyword.search(self.index, self.queries, AS_OF, limit=limit, **options)

    @cached_property
    def chunks(self) -> DataFrame:
        return vector.chunk_table(self.notes)

    @cached_property
    def embedded(self) -> DataFrame:
        c = self.chunks.withColumn("words", vector.word_text("text"))
        vectors = vector.embed_new(c, None, vector.hash_embedder(), "words")
        return vector.embedded_chunks(self.chunks.select("path", "chunk_ix", "hash"), vectors)

    @property
    def semantic(self) -> DataFrame:
        return self.once("semantic", self._semantic)

    def _semantic(self) -> DataFrame:
        q = self.queries.select("query_id", vector.word_text("query").alias("text"))
        hits = vector.semantic_search(q, self.embedded, vector.hash_embedder(), 3 * K)
        return vector.first_hit_per_note(hits)

    def topic_candidates(self, column: str) -> DataFrame:
        topics = self.queries.select("query_id", F.col(column).alias("topic"))
        top2 = routing.routable_hits(self.index, topics, AS_OF)
        return routing.candidates(topics, self.brief_map, top2, self.notes.select("path", "title"))

    def routes(self, column: str) -> DataFrame:
        decided = lambda: routing.decide(self.topic_candidates(column), F.lit(routing.FLOOR), F.lit(routing.MARGIN))
        return self.once(f"routes-{column}", decided)

    @cached_property
    def links(self) -> DataFrame:
        return graph.resolve_links(self.notes)

    @cached_property
    def sessions(self) -> DataFrame:
        return lifecycle.sessions(self.notes)

    @cached_property
    def prompts(self) -> DataFrame:
        return self.queries.select("query_id", F.col("query").alias("prompt"))


def minute(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


# --- corpus listings ----------------------------------------------------------------------------


@register(
    "tag_counts",
    S.with_(S.NOTES)
    + """SELECT tag, count(*) AS n_notes FROM (
      SELECT unnest([type_tag, 'project/' || source, 'topic/' || lang]) AS tag FROM notes) GROUP BY 1""",
)
def tag_counts(c: Corpus) -> DataFrame:
    return note_source.tag_counts(c.notes)


@register(
    "list_notes",
    S.with_(S.NOTES)
    + """SELECT path, title, strftime(modified_at, '%Y-%m-%d %H:%M') AS modified, size FROM notes
    WHERE starts_with(path, 'kb/') ORDER BY modified_at DESC, path LIMIT 100""",
)
def list_notes(c: Corpus) -> DataFrame:
    rows = note_source.list_notes(c.notes, "kb", True, 100)
    return rows.select("path", "title", minute("modified_at").alias("modified"), "size")


@register(
    "curated_count",
    S.with_(S.NOTES)
    + """SELECT count(*) FILTER (WHERE NOT (starts_with(path, 'sessions/') AND NOT starts_with(path, 'sessions/digests/'))) AS curated,
    count(*) FILTER (WHERE NOT (starts_with(path, 'sessions/') AND NOT starts_with(path, 'sessions/digests/'))) >= 300 AS semantic_on FROM notes""",
)
def curated_count(c: Corpus) -> DataFrame:
    return note_source.curated_counts(c.notes)


@register(
    "lookup_notes",
    S.with_(S.NOTES)
    + """, asked AS (SELECT DISTINCT target_brief AS path FROM notes WHERE target_brief IS NOT NULL)
    SELECT a.path, n.path IS NOT NULL AS found, n.title FROM asked a LEFT JOIN notes n USING (path)""",
)
def lookup_notes(c: Corpus) -> DataFrame:
    asked = c.notes.where(F.col("fm.target_brief").isNotNull()).select(
        text.drop_dot_slash(F.col("fm.target_brief")).alias("path")
    )
    return note_source.lookup_notes(c.notes, asked.distinct()).select("path", "found", "title")


@register(
    "index_diff",
    S.with_(S.NOTES)
    + """, known AS (SELECT path, modified_at, size FROM notes WHERE created_at < TIMESTAMP '2024-03-10'),
    disk AS (SELECT path, CASE WHEN last_reviewed IS NOT NULL THEN modified_at + INTERVAL 1 DAY ELSE modified_at END AS modified_at, size
             FROM notes WHERE created_at >= TIMESTAMP '2024-01-05')
    SELECT coalesce(k.path, d.path) AS path, CASE WHEN k.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'removed'
      WHEN k.modified_at <> d.modified_at OR k.size <> d.size THEN 'changed' ELSE 'unchanged' END AS change
    FROM known k FULL JOIN disk d USING (path)""",
)
def index_diff(c: Corpus) -> DataFrame:
    known = c.notes.where(F.col("created_at") < "2024-03-10")
    later = F.when(
        F.col("fm.last_reviewed").isNotNull(), F.col("modified_at") + F.expr("INTERVAL 1 DAY")
    ).otherwise(F.col("modified_at"))
    disk = c.notes.where(F.col("created_at") >= "2024-01-05").withColumn("modified_at", later)
    return keyword.snapshot_diff(known, disk)


# --- keyword search -------------------------------------------------------------------------------


@register(
    "index_build",
    S.with_(S.NOTES, S.POSTINGS)
    + """SELECT p.field, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT term) AS n_terms,
    any_value(n_notes) AS n_notes, round(any_value(avg_len), 6) AS avg_len
    FROM postings p JOIN field_stats USING (field) GROUP BY 1""",
)
def index_build(c: Corpus) -> DataFrame:
    """A new build, stored and published; the counts are read from what was stored."""
    ix = blockmax.current(c.spark, lambda: c.notes, c.index_root, rebuild=True)
    return _per_field(ix).join(ix.field_stats, "field").select(
        "field", "n_postings", "n_tokens", "n_terms", "n_notes", F.round("avg_len", 6).alias("avg_len")
    )


def _per_field(ix: keyword.KeywordIndex) -> DataFrame:
    """(field, n_postings, n_tokens, n_terms): three rows from one-row sums over both tables."""
    fields = tuple(keyword.FIELD_BOOSTS)
    sums = ix.postings.agg(
        *[F.count_if(F.col(f"tf_{f}") > 0).alias(f"p_{f}") for f in fields],
        *[F.sum(f"tf_{f}").alias(f"t_{f}") for f in fields],
    )
    terms = ix.dictionary.agg(*[F.count_if(F.col(f"df_{f}") > 0).alias(f"n_{f}") for f in fields])

    def long(df: DataFrame, **prefixes: str) -> DataFrame:
        rows = [
            F.struct(F.lit(f).alias("field"), *[F.col(f"{p}_{f}").alias(n) for n, p in prefixes.items()])
            for f in fields
        ]
        return df.select(F.inline(F.array(*rows)))

    return long(sums, n_postings="p", n_tokens="t").join(long(terms, n_terms="n"), "field")


@register(
    "index_incremental",
    S.with_(S.NOTES, S.POSTINGS)
    + "SELECT field, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT term) AS n_terms FROM postings GROUP BY 1",
)
def index_incremental(c: Corpus) -> DataFrame:
    """Build on an older state, then bring it up to date: must equal a full build."""
    older = c.notes.where(F.col("created_at") < "2024-03-10").withColumn(
        "content", F.concat("content", F.lit(" old"))
    )
    old_ix = keyword.build_index(older, parts=keyword.parts_of(older))
    removed = c.notes.select("path").limit(0)
    new_ix = keyword.update_index(old_ix, c.notes, removed, c.notes)
    return _per_field(new_ix)


EXACT = (S.NOTES, S.QUERIES, S.POSTINGS, S.terms("qt", "queries", "query"))


@register(
    "keyword_topk",
    S.with_(*EXACT, S.hits("kw", "qt", K)) + "SELECT query_id, path, score, rank FROM kw",
)
def keyword_topk(c: Corpus) -> DataFrame:
    return c.hits(K, expand=False)


@register(
    "keyword_topk_textbook",
    S.with_(*EXACT, S.hits("kw", "qt", K)
            .replace("(0.5 + p.tf * 2.2", "(0.0 + p.tf * 2.2")
            .replace("1 - 0.7 + 0.7 *", "1 - 0.75 + 0.75 *")
            .replace("* count(DISTINCT t.source_term)", ""))
    + "SELECT query_id, path, score, rank FROM kw",
)
def keyword_topk_textbook(c: Corpus) -> DataFrame:
    return c.hits(K, expand=False, params=keyword.KeywordParams.textbook())


@register(
    "prefix_expand",
    S.with_(S.NOTES, S.QUERIES, S.POSTINGS)
    + f"""SELECT s.source_term, v.term FROM (SELECT DISTINCT unnest({S.tok('query')}) AS source_term FROM queries) s
    JOIN (SELECT DISTINCT term FROM postings) v ON starts_with(v.term, s.source_term) AND v.term <> s.source_term""",
)
def prefix_expand(c: Corpus) -> DataFrame:
    words = keyword.query_terms(c.queries).select("source_term").distinct()
    return keyword.prefix_matches(words, c.index.dictionary.select("term"))


@register(
    "fuzzy_expand",
    S.with_(S.NOTES, S.QUERIES, S.POSTINGS)
    + f"""SELECT * FROM (SELECT s.source_term, v.term, CAST({S.edits("v.term", "s.source_term")} AS INTEGER) AS distance
    FROM (SELECT DISTINCT unnest({S.tok('query')}) AS source_term FROM queries) s
    JOIN (SELECT DISTINCT term FROM postings) v
      ON abs(length(v.term) - length(s.source_term)) <= least(6, floor(length(s.source_term) * 0.2 + 0.5)))
    WHERE distance > 0 AND distance <= least(6, floor(length(source_term) * 0.2 + 0.5))""",
)
def fuzzy_expand(c: Corpus) -> DataFrame:
    words = keyword.query_terms(c.queries).select("source_term").distinct()
    return keyword.fuzzy_matches(words, c.index.dictionary.select("term"), parts=c.index.spellings)


@register(
    "keyword_expanded_topk",
    S.with_(S.NOTES, S.QUERIES, S.POSTINGS, S.expanded("xt", "queries", "query"), S.hits("kw", "xt", K))
    + "SELECT query_id, path, score, rank FROM kw",
)
def keyword_expanded_topk(c: Corpus) -> DataFrame:
    return c.hits(K)


@register(
    "keyword_filtered",
    S.with_(
        *EXACT,
        S.hits("kw", "qt", K, "starts_with(h.path, 'kb/') AND n.type_tag IN ('type/brief', 'type/reference')"),
    )
    + "SELECT query_id, path, score, rank FROM kw",
)
def keyword_filtered(c: Corpus) -> DataFrame:
    return c.hits(K, expand=False, folder="kb", tags=("type/brief", "type/reference"))


@register(
    "keyword_sessions",
    S.with_(*EXACT, S.hits("kw", "qt", K, "n.type_tag = 'type/session'", session_asked=True))
    + "SELECT query_id, path, score, rank FROM kw",
)
def keyword_sessions(c: Corpus) -> DataFrame:
    """Asking for sessions lifts their demotion; here the filter comes from the query row."""
    q = c.queries.withColumn("tags", F.array(F.lit("type/session")))
    return keyword.search(c.index, q, AS_OF, limit=K, expand=False)


_POS = "list_filter(list_transform(regexp_split_to_array(lower(query), '\\s+'), lambda w: instr(lower(content), w)), lambda p: p > 0)"
SNIPPET = f"""
snip AS (
  SELECT *, coalesce(({_POS})[1], 1) - 1 AS best FROM (
    SELECT k.query_id, k.path, k.rank, n.title, n.content, n.type_tag, q.query
    FROM kw k JOIN notes n USING (path) JOIN queries q USING (query_id))),
snip2 AS (
  SELECT *, greatest(0, best - CASE WHEN type_tag = 'type/session' THEN 120 ELSE 80 END) AS s,
         least(length(content), best + CASE WHEN type_tag = 'type/session' THEN 280 ELSE 120 END) AS e FROM snip),
snip3 AS (
  SELECT query_id, path, rank, title, CASE WHEN type_tag = 'type/session' THEN
      trim(regexp_extract(content, '(?s)## Topics\\n(.*?)\\n##', 1), {S.WS})
    ELSE regexp_replace(CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(content, s + 1, e - s), {S.WS})
         || CASE WHEN e < length(content) THEN '...' ELSE '' END, '\\n+', ' ', 'g') END AS snippet FROM snip2)
"""


@register(
    "keyword_snippets",
    S.with_(*EXACT, S.hits("kw", "qt", 3), SNIPPET)
    + "SELECT query_id, rank, path, title, CASE WHEN length(snippet) > 400 THEN substr(snippet, 1, 400) || '...' ELSE snippet END AS snippet FROM snip3",
)
def keyword_snippets(c: Corpus) -> DataFrame:
    return keyword.with_snippets(c.hits(3, expand=False), c.notes, c.queries).select(
        "query_id", "rank", "path", "title", "snippet"
    )


# --- vectors ----------------------------------------------------------------------------------------

_EMB = """
items AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
qs AS (SELECT vec_id AS query_id, v AS embedding FROM items WHERE vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT q.query_id, i.vec_id AS item_id, round(list_dot_product(q.embedding, i.v) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(i.v, i.v))), 6) AS score
    FROM qs q CROSS JOIN items i))
"""


def _vector_queries(c: Corpus) -> DataFrame:
    """Every vector whose number is divisible by 20."""
    return c.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vector_items(c: Corpus) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@register("cosine_topk", S.with_(_EMB) + "SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 10")
def cosine_topk(c: Corpus) -> DataFrame:
    return vector.nearest(_vector_queries(c), _vector_items(c), 10)


@register("cosine_topk_blocks", S.with_(_EMB) + "SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 10")
def cosine_topk_blocks(c: Corpus) -> DataFrame:
    """The same with many small blocks of both sides."""
    return vector.nearest(_vector_queries(c), _vector_items(c), 10, query_block=3, item_block=100)


@register(
    "chunk_dedupe",
    S.with_(_EMB)
    + """SELECT query_id, CAST(path AS BIGINT) AS path, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (
      SELECT query_id, item_id // 4 AS path, max(score) AS score, min(rank) AS r FROM ranked WHERE rank <= 24 GROUP BY 1, 2)""",
)
def chunk_dedupe(c: Corpus) -> DataFrame:
    """Four neighbouring vectors stand for the chunks of one note."""
    hits = vector.nearest(_vector_queries(c), _vector_items(c), 24)
    return vector.first_hit_per_note(
        hits.withColumn("path", F.floor(F.col("item_id") / 4).cast("long"))
    )


@register(
    "ann_recall",
    S.with_(_EMB) + "SELECT query_id, count(*) AS n_found, min(score) AS last_score, true AS recalled FROM ranked WHERE rank <= 10 GROUP BY 1",
)
def ann_recall(c: Corpus) -> DataFrame:
    """Per query: rows the stored index finds, the score of the last exact neighbour, and whether the index finds nine of ten of these."""
    q, items = _vector_queries(c), _vector_items(c)
    near = ivf.search(c.vector_index, q, items, 10).select("query_id", "item_id", F.lit(True).alias("found"))
    exact = vector.nearest(q, items, 10).select("query_id", "item_id", "score")
    both = exact.join(near, ["query_id", "item_id"], "full")
    return both.groupBy("query_id").agg(
        F.count("found").alias("n_found"),
        F.min("score").alias("last_score"),
        (F.count_if(F.col("found") & F.col("score").isNotNull()) >= 0.9 * F.count("score")).alias("recalled"),
    )


@register(
    "chunks",
    S.with_(S.NOTES, S.CHUNKS)
    + "SELECT path, chunk_ix, heading, sha1(text) AS hash, length(text) AS n_chars FROM chunks",
)
def chunks(c: Corpus) -> DataFrame:
    return c.chunks.select(
        "path",
        F.col("chunk_ix").cast("long").alias("chunk_ix"),
        "heading",
        "hash",
        F.length("text").cast("long").alias("n_chars"),
    )


@register(
    "embed_pending",
    S.with_(S.NOTES, S.CHUNKS)
    + """SELECT DISTINCT sha1(c.text) AS hash FROM chunks c WHERE sha1(c.text) NOT IN (
      SELECT sha1(o.text) FROM chunks o JOIN notes n USING (path) WHERE n.created_at < TIMESTAMP '2024-03-10')""",
)
def embed_pending(c: Corpus) -> DataFrame:
    """Texts the vector cache of an older state does not hold yet."""
    old = vector.chunk_table(c.notes.where(F.col("created_at") < "2024-03-10")).select("hash").distinct()
    return c.chunks.select("hash").distinct().join(old, "hash", "left_anti")


SEMANTIC = (S.NOTES, S.QUERIES, S.semantic(3 * K))


@register("semantic_topk", S.with_(*SEMANTIC) + "SELECT query_id, path, score, rank FROM sem")
def semantic_topk(c: Corpus) -> DataFrame:
    return c.semantic


# --- fusion ---------------------------------------------------------------------------------------

BOTH = (*SEMANTIC, S.POSTINGS, S.expanded("qt", "queries", "query"), S.hits("kw", "qt", 3 * K))


@register("rrf_fusion", S.with_(*BOTH, S.fused("f", ["kw", "sem"])) + "SELECT query_id, path, score, rank FROM f")
def rrf_fusion(c: Corpus) -> DataFrame:
    return fusion.fuse([c.hits(3 * K), c.semantic], weight=fusion.path_weight())


_GOLD_PINS = "pins AS (SELECT case_id AS query_id, min(path) AS path, 1 AS pin_ord FROM gold GROUP BY 1)"


@register(
    "rrf_pins",
    S.with_(*BOTH, S.GOLD, _GOLD_PINS, S.fused("f", ["kw", "sem"], "pins", K))
    + "SELECT query_id, path, score, rank FROM f",
)
def rrf_pins(c: Corpus) -> DataFrame:
    pins = (
        c.gold.groupBy(F.col("case_id").alias("query_id"))
        .agg(F.min("path").alias("path"))
        .withColumn("pin_ord", F.lit(1))
    )
    return fusion.fuse([c.hits(3 * K), c.semantic], weight=fusion.path_weight(), pins=pins, limit=K)


def _routes_sql(name: str, column: str) -> tuple[str, ...]:
    src = f"{name}_src AS (SELECT query_id, {column} AS topic FROM queries)"
    return (
        src,
        S.expanded(f"{name}_qt", f"{name}_src", "topic"),
        S.hits(f"{name}_top", f"{name}_qt", 2, S.ROUTABLE),
        S.candidates(f"{name}_c", f"{name}_src", f"{name}_top"),
        S.decided(name, f"{name}_c"),
    )


MAPPED = (S.GOLD, S.CASES, S.MAP)


@register(
    "hybrid_search",
    S.with_(
        *BOTH,
        *MAPPED,
        *_routes_sql("rq", "query"),
        "pins AS (SELECT query_id, path, 1 AS pin_ord FROM rq WHERE path IS NOT NULL)",
        S.fused("f", ["kw", "sem"], "pins", K),
    )
    + """SELECT f.query_id, f.rank, f.path, CASE WHEN k.path IS NOT NULL THEN n.title
      ELSE regexp_replace(split_part(f.path, '/', -1), '\\.md$', '') END AS title, r.method AS route_method
    FROM f JOIN notes n USING (path) JOIN rq r ON r.query_id = f.query_id
    LEFT JOIN kw k ON k.query_id = f.query_id AND k.path = f.path""",
)
def hybrid_search(c: Corpus) -> DataFrame:
    out = search.hybrid_search(
        c.index,
        c.notes,
        c.queries,
        c.brief_map,
        AS_OF,
        limit=K,
        embedded=c.embedded,
        embedder=vector.hash_embedder(),
        explain=True,
    )
    return out.select("query_id", "rank", "path", "title", F.col("route.method").alias("route_method"))


# --- routing -----------------------------------------------------------------------------------------


@register("brief_map", S.with_(*S.CASE_PARTS, S.MAP) + "SELECT keyword, path, src FROM brief_map")
def brief_map(c: Corpus) -> DataFrame:
    return c.brief_map


@register(
    "inverted_map",
    S.with_(*S.CASE_PARTS, S.MAP)
    + "SELECT path, string_agg(keyword, '|' ORDER BY keyword) AS keywords FROM brief_map GROUP BY 1",
)
def inverted_map(c: Corpus) -> DataFrame:
    return routing.invert_map(c.brief_map).select("path", F.array_join("keywords", "|").alias("keywords"))


ROUTED = (*S.CASE_PARTS, S.MAP, S.POSTINGS)


@register(
    "route_briefs",
    S.with_(*ROUTED, *_routes_sql("r", "query"))
    + "SELECT query_id, path, method, round(score, 6) AS score, margin FROM r",
)
def route_briefs(c: Corpus) -> DataFrame:
    return c.routes("query").withColumn("score", F.round("score", 6))


@register(
    "route_topics",
    S.with_(*ROUTED, *_routes_sql("r", "topic"))
    + "SELECT query_id, path, method, round(score, 6) AS score, margin FROM r",
)
def route_topics(c: Corpus) -> DataFrame:
    return c.routes("topic").withColumn("score", F.round("score", 6))


_METRICS = """count(*) AS n_cases, count(path) AS n_routed,
  round(CASE WHEN count(path) > 0 THEN count(*) FILTER (WHERE ok) / count(path) ELSE 1.0 END, 6) AS precision,
  round(CASE WHEN count(*) FILTER (WHERE NOT negative) > 0 THEN count(*) FILTER (WHERE ok) / count(*) FILTER (WHERE NOT negative) ELSE 0.0 END, 6) AS recall,
  round(count(*) FILTER (WHERE path IS NULL) / count(*), 6) AS abstention,
  round(CASE WHEN count(*) FILTER (WHERE negative) > 0 THEN count(*) FILTER (WHERE negative AND path IS NULL) / count(*) FILTER (WHERE negative) ELSE 1.0 END, 6) AS negative_accuracy,
  count(*) FILTER (WHERE path IS NOT NULL AND NOT ok) AS wrong_routes"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(x, 6).alias(x) if x in names else F.col(x) for x in df.columns])


RATES = ("precision", "recall", "abstention", "negative_accuracy")


@register(
    "routing_quality",
    S.with_(*ROUTED, *_routes_sql("r", "topic"))
    + f"""SELECT {_METRICS} FROM (SELECT r.*, c.negative, coalesce(NOT c.negative AND r.path = c.expected_brief, FALSE) AS ok
      FROM r JOIN cases c ON c.case_id = r.query_id)""",
)
def routing_quality(c: Corpus) -> DataFrame:
    return _rounded(evals.routing_quality(c.cases, c.routes("topic")), *RATES)


@register(
    "routing_sweep",
    S.with_(
        *ROUTED,
        *_routes_sql("r", "query")[:-1],
        "grid AS (SELECT * FROM r_c CROSS JOIN (SELECT unnest([4.0, 6.0, 8.0, 10.0])::DOUBLE AS floor) CROSS JOIN (SELECT unnest([1.0, 1.3, 1.6, 2.0])::DOUBLE AS min_margin))",
        S.decided("d", "grid", "floor", "min_margin", "floor, min_margin,"),
    )
    + f"""SELECT floor, min_margin, {_METRICS} FROM (SELECT d.*, c.negative, coalesce(NOT c.negative AND d.path = c.expected_brief, FALSE) AS ok
      FROM d JOIN cases c ON c.case_id = d.query_id) GROUP BY floor, min_margin""",
)
def routing_sweep(c: Corpus) -> DataFrame:
    return _rounded(evals.routing_sweep(c.cases, c.topic_candidates("query")), *RATES)


@register(
    "brief_lookup",
    S.with_(*ROUTED, S.expanded("kt", "queries", "topic"), S.hits("kw3", "kt", 3), *_routes_sql("r", "topic"))
    + """SELECT r.query_id, r.path IS NOT NULL AS found, r.method, r.path, n.title,
      CASE WHEN r.path IS NULL THEN (SELECT string_agg(k.path, '|' ORDER BY k.rank) FROM kw3 k WHERE k.query_id = r.query_id) END AS related
    FROM r LEFT JOIN notes n USING (path)""",
)
def brief_lookup(c: Corpus) -> DataFrame:
    q = c.queries.select("query_id", F.col("topic").alias("query"))
    related = keyword.search(c.index, q, AS_OF, limit=3)
    out = routing.brief_lookup(c.routes("topic"), c.notes, related)
    return out.select(
        "query_id",
        "found",
        "method",
        "path",
        "title",
        F.array_join(F.transform("related", lambda r: r["path"]), "|").alias("related"),
    )


# --- recall ------------------------------------------------------------------------------------------

_CURATED = "NOT (starts_with({p}, 'sessions/') AND NOT starts_with({p}, 'sessions/digests/')) AND NOT starts_with({p}, 'proposals/') AND NOT starts_with({p}, 'sessions/digests/_runs/')"
VOCAB = f"""
vocab AS (
  SELECT DISTINCT token FROM (
    SELECT unnest({S.rtok('keyword')}) AS token FROM brief_map
    UNION ALL SELECT unnest({S.rtok('title')}) FROM notes WHERE {_CURATED.format(p='path')}
    UNION ALL SELECT unnest(list_filter({S.rtok("regexp_replace(split_part(path, '/', -1), '.md$', '')")}, lambda z: z <> 'brief')) FROM notes WHERE {_CURATED.format(p='path')})
  WHERE length(token) >= 3),
on_domain AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest({S.rtok('query')}) AS token FROM queries) SEMI JOIN vocab USING (token))
"""


@register("domain_gate", S.with_(*S.CASE_PARTS, S.MAP, VOCAB) + "SELECT query_id FROM on_domain")
def domain_gate(c: Corpus) -> DataFrame:
    return context.on_domain(c.prompts, context.domain_vocabulary(c.notes, c.brief_map))


_GATE = f"""
gated AS (
  SELECT query_id, path, in_title OR n_body >= 2 AS ok FROM (
    SELECT k.query_id, k.path, list_has_any({S.rtok('q.query')}, {S.rtok('n.title')}) AS in_title,
      len(list_filter(list_distinct({S.rtok('q.query')}), lambda w: regexp_matches(lower(n.content), '\\b' || w || '\\b'))) AS n_body
    FROM kw k JOIN queries q USING (query_id) JOIN notes n USING (path)))
"""


@register(
    "content_gate",
    S.with_(*EXACT, S.hits("kw", "qt", 9), _GATE) + "SELECT query_id, path, ok FROM gated",
)
def content_gate(c: Corpus) -> DataFrame:
    pairs = c.hits(9, expand=False).select("query_id", "path")
    return (
        pairs.join(c.prompts, "query_id")
        .join(c.notes.select("path", "title", "content"), "path")
        .select(
            "query_id",
            "path",
            context.shares_content(F.col("prompt"), F.col("title"), F.col("content")).alias("ok"),
        )
    )


@register(
    "content_gate_tokens",
    S.with_(*EXACT, S.hits("kw", "qt", 9), _GATE) + "SELECT query_id, path FROM gated WHERE ok",
)
def content_gate_tokens(c: Corpus) -> DataFrame:
    pairs = c.hits(9, expand=False).select("query_id", "path")
    return context.shares_content_by_tokens(c.prompts, pairs, c.notes)


@register(
    "recall_tier",
    S.with_(
        *ROUTED,
        S.expanded("qt", "queries", "query"),
        S.hits("kw", "qt", 9),
        *_routes_sql("r", "query"),
        VOCAB,
        S.fused("f", ["kw"]),
        _GATE,
        f"""kept AS (
          SELECT f.query_id, f.path, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS n
          FROM f JOIN gated g ON g.query_id = f.query_id AND g.path = f.path AND g.ok
          WHERE {_CURATED.format(p='f.path')} AND f.query_id IN (SELECT query_id FROM on_domain))""",
    )
    + f"""SELECT q.query_id, CASE WHEN n.path IS NOT NULL AND {_CURATED.format(p='r.path')} THEN 'brief' WHEN h.paths IS NOT NULL THEN 'hits' ELSE 'none' END AS tier,
      r.method, CASE WHEN n.path IS NOT NULL AND {_CURATED.format(p='r.path')} THEN r.path ELSE coalesce(h.paths, '') END AS injected
    FROM queries q JOIN r USING (query_id) LEFT JOIN notes n ON n.path = r.path
    LEFT JOIN (SELECT query_id, string_agg(path, '|' ORDER BY n) AS paths FROM kept WHERE n <= 3 GROUP BY 1) h ON h.query_id = q.query_id""",
)
def recall_tier(c: Corpus) -> DataFrame:
    out = search.recall_prompts(c.index, c.notes, c.prompts, c.brief_map, AS_OF)
    return out.select("query_id", "tier", "method", F.array_join("injected", "|").alias("injected"))


@register("recall_text")
def recall_text(c: Corpus) -> DataFrame:
    """Length of the injected block, which never exceeds the budget."""
    out = search.recall_prompts(
        c.index, c.notes, c.prompts, c.brief_map, AS_OF, budget_tokens=200
    )
    return out.select("query_id", "tier", F.length("text").alias("n_chars"))


@register("context_budget")
def context_budget(c: Corpus) -> DataFrame:
    """Requests of neighbouring topics share one budget."""
    routed = c.routes("topic").join(c.queries.select("query_id", "topic"), "query_id")
    requests = routed.select(
        F.floor(F.col("query_id") / 6).alias("request_id"),
        (F.col("query_id") % 6).cast("int").alias("topic_ix"),
        "topic",
        "path",
    )
    out = context.assemble(requests, c.notes, max_tokens=2000)
    return out.select(
        "request_id", "total_chars", F.size("resolved").alias("n_resolved"), F.size("not_found").alias("n_missing")
    )


@register(
    "suppress_repeat",
    S.with_(S.DECISIONS)
    + """, shown AS (SELECT session_id, prompt_id, ts, unnest(injected) AS path FROM decisions),
    fresh AS (SELECT DISTINCT session_id, prompt_id FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY ts, prompt_id) AS r FROM shown) WHERE r = 1)
    SELECT d.session_id, d.prompt_id, len(d.injected) > 0 AND f.prompt_id IS NULL AND d.method <> 'direct_map' AS suppressed
    FROM decisions d LEFT JOIN fresh f USING (session_id, prompt_id)""",
)
def suppress_repeat(c: Corpus) -> DataFrame:
    out = context.suppress_repeats(D.decisions(c.spark, c.sf_dir))
    return out.select("session_id", "prompt_id", "suppressed")


# --- link graph -----------------------------------------------------------------------------------------


@register("wikilink_resolve", S.with_(S.NOTES, S.LINKS) + "SELECT src, target, dst FROM links")
def wikilink_resolve(c: Corpus) -> DataFrame:
    return c.links


@register(
    "backlinks", S.with_(S.NOTES, S.LINKS) + "SELECT dst, count(*) AS n_sources FROM edges GROUP BY 1"
)
def backlinks(c: Corpus) -> DataFrame:
    return graph.backlinks(c.links)


@register(
    "dangling", S.with_(S.NOTES, S.LINKS) + "SELECT DISTINCT src, target FROM links WHERE dst IS NULL"
)
def dangling(c: Corpus) -> DataFrame:
    return graph.dangling(c.links)


_MOC = "(type_tag = 'type/moc' OR starts_with(path, 'MOCs/') OR path = 'Home.md')"
ORPHANS = f"""
incoming AS (
  SELECT e.dst AS path, count(*) AS n, max(CASE WHEN m.path IS NOT NULL THEN 1 END) AS moc
  FROM edges e LEFT JOIN (SELECT path FROM notes WHERE {_MOC}) m ON m.path = e.src GROUP BY 1),
orphans AS (
  SELECT n.path, n.title, CASE WHEN i.n IS NULL THEN 'isolated' ELSE 'no-moc' END AS reason, coalesce(i.n, 0) AS backlink_count
  FROM notes n LEFT JOIN incoming i USING (path) WHERE n.type_tag IN ('type/note', 'type/reference') AND i.moc IS NULL),
unlinked_maps AS (
  SELECT path, title FROM notes WHERE {_MOC} AND path <> 'Home.md' AND path NOT IN (SELECT dst FROM edges WHERE src = 'Home.md'))
"""


@register("orphans", S.with_(S.NOTES, S.LINKS, ORPHANS) + "SELECT path, title, reason, backlink_count FROM orphans")
def orphans(c: Corpus) -> DataFrame:
    return graph.orphans(c.notes, c.links)


@register("unlinked_maps", S.with_(S.NOTES, S.LINKS, ORPHANS) + "SELECT path, title FROM unlinked_maps")
def unlinked_maps(c: Corpus) -> DataFrame:
    return graph.unlinked_maps(c.notes, c.links)


# --- lifecycle --------------------------------------------------------------------------------------------

GROUPS = """
groups AS (
  SELECT g.project, g.period, g.digest_path, n.path IS NOT NULL AS exists, g.n_sessions, g.first_created, g.last_created
  FROM (SELECT project, strftime(created_at, '%G-W%V') AS period, 'sessions/digests/' || strftime(created_at, '%G-W%V') || '-' || project || '.md' AS digest_path,
          count(*) AS n_sessions, min(created_at) AS first_created, max(created_at) AS last_created FROM sess GROUP BY 1, 2, 3) g
  LEFT JOIN notes n ON n.path = g.digest_path)
"""
SESS = (S.NOTES, S.SESSIONS)


@register(
    "digest_candidates",
    S.with_(*SESS, GROUPS)
    + """SELECT project, period, digest_path, exists, n_sessions, strftime(first_created, '%Y-%m-%d %H:%M') AS first_created,
      strftime(last_created, '%Y-%m-%d %H:%M') AS last_created FROM groups""",
)
def digest_candidates(c: Corpus) -> DataFrame:
    g = lifecycle.digest_groups(c.sessions, c.notes)
    return g.withColumns({k: minute(k) for k in ("first_created", "last_created")})


@register(
    "digest_members",
    S.with_(*SESS, GROUPS)
    + """SELECT s.project, g.period, s.path, s.title, array_to_string(list_filter(s.topics, lambda t: t <> ''), '|') AS topics, 1 AS files_changed_count
      FROM sess s JOIN groups g ON g.project = s.project AND g.period = strftime(s.created_at, '%G-W%V') WHERE g.n_sessions >= 2""",
)
def digest_members(c: Corpus) -> DataFrame:
    groups = lifecycle.digest_groups(c.sessions, c.notes, min_sessions=2)
    m = lifecycle.digest_members(c.sessions, groups)
    return m.select(
        "project", "period", "path", "title", F.array_join("topics", "|").alias("topics"), "files_changed_count"
    )


@register(
    "malformed_dates",
    S.with_(S.NOTES) + "SELECT path FROM notes WHERE kind = 0 AND doc_id % 97 = 0",
)
def malformed_dates(c: Corpus) -> DataFrame:
    return lifecycle.malformed_sessions(c.sessions)


COVERED = """
covered AS (
  SELECT DISTINCT unnest(['sessions/2024/d' || (doc_id - 1) || '.md', 'sessions/2024/d' || (doc_id - 11) || '.md']) AS path
  FROM notes WHERE kind = 1 AND doc_id % 3 <> 0)
"""


@register("digest_coverage", S.with_(S.NOTES, COVERED) + "SELECT path FROM covered")
def digest_coverage(c: Corpus) -> DataFrame:
    return lifecycle.covered_sessions(c.notes)


_OLD = f"created_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"


@register(
    "archive_plan",
    S.with_(*SESS, COVERED)
    + f"""SELECT count(*) FILTER (WHERE c.path IS NOT NULL) AS candidates, count(*) FILTER (WHERE c.path IS NULL) AS skipped_undigested,
      strftime(min(created_at) FILTER (WHERE c.path IS NOT NULL), '%Y-%m-%d') AS oldest,
      strftime(max(created_at) FILTER (WHERE c.path IS NOT NULL), '%Y-%m-%d') AS newest
    FROM sess s LEFT JOIN covered c USING (path) WHERE {_OLD}""",
)
def archive_plan(c: Corpus) -> DataFrame:
    return lifecycle.archive_plan(c.sessions, lifecycle.covered_sessions(c.notes), AS_OF)


@register(
    "archive_renames",
    S.with_(*SESS, COVERED)
    + f"""SELECT path, 'sessions/archive/' || substr(path, 10) AS to_path FROM sess SEMI JOIN covered USING (path) WHERE {_OLD}""",
)
def archive_renames(c: Corpus) -> DataFrame:
    r = lifecycle.archive_candidates(c.sessions, lifecycle.covered_sessions(c.notes), AS_OF)
    return r.select("path", "to_path")


def _renames(c: Corpus) -> DataFrame:
    r = lifecycle.archive_candidates(c.sessions, lifecycle.covered_sessions(c.notes), AS_OF)
    return r.select(F.col("path").alias("from_path"), "to_path")


@register(
    "repoint",
    S.with_(*SESS, COVERED)
    + f""", moved AS (SELECT path FROM sess SEMI JOIN covered USING (path) WHERE {_OLD}),
    cited AS (SELECT path, unnest([doc_id - 1, doc_id - 11]) AS i, unnest([1, 2]) AS ord FROM notes WHERE kind = 1 AND doc_id % 3 <> 0)
    SELECT c.path, string_agg(CASE WHEN m.path IS NOT NULL THEN 'sessions/archive/2024/d' ELSE 'sessions/2024/d' END || i || '.md', '|' ORDER BY ord) AS sources
    FROM cited c LEFT JOIN moved m ON m.path = 'sessions/2024/d' || i || '.md' GROUP BY 1""",
)
def repoint(c: Corpus) -> DataFrame:
    out = lifecycle.repoint_digests(c.notes, _renames(c)).where(F.size("sources") > 0)
    bare = F.transform("sources", text.drop_dot_slash)
    return out.select("path", F.array_join(bare, "|").alias("sources"))


STALE = f"""
briefs AS (
  SELECT m.path, m.keyword,
    coalesce(CAST(n.last_reviewed AS TIMESTAMP), CAST(n.updated AS TIMESTAMP), n.modified_at) AS review_date,
    CASE WHEN n.last_reviewed IS NOT NULL THEN 'last_reviewed' WHEN n.updated IS NOT NULL THEN 'updated' ELSE 'mtime' END AS source
  FROM brief_map m JOIN notes n USING (path)
  WHERE m.path NOT IN (SELECT target_brief FROM notes WHERE status = 'proposed')),
spoken AS (SELECT path AS session_path, created_at, array_to_string(list_concat([title], list_concat(list_filter(topics, lambda t: t <> ''), files)), chr(10)) AS spoken FROM sess),
stale AS (
  SELECT b.path AS brief_path, b.review_date, b.source, s.session_path, s.created_at AS session_created, b.keyword
  FROM briefs b JOIN spoken s ON s.created_at > b.review_date
    AND regexp_matches(s.spoken, '(?i)\\b' || regexp_replace(b.keyword, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g') || '\\b')
  WHERE b.review_date <= TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY)
"""


@register(
    "stale_matches",
    S.with_(*S.CASE_PARTS, S.MAP, S.SESSIONS, STALE) + "SELECT brief_path, source, session_path, keyword FROM stale",
)
def stale_matches(c: Corpus) -> DataFrame:
    m = lifecycle.stale_matches(c.notes, c.sessions, c.brief_map, AS_OF)
    return m.select("brief_path", "source", "session_path", "keyword")


@register(
    "stale_briefs",
    S.with_(*S.CASE_PARTS, S.MAP, S.SESSIONS, STALE)
    + """SELECT brief_path, strftime(review_date, '%Y-%m-%d %H:%M') AS review_date, source, count(DISTINCT session_path) AS n_sessions,
      strftime(min(session_created), '%Y-%m-%d %H:%M') AS first_session, strftime(max(session_created), '%Y-%m-%d %H:%M') AS last_session,
      count(DISTINCT keyword) AS n_keywords FROM stale GROUP BY brief_path, review_date, source""",
)
def stale_briefs(c: Corpus) -> DataFrame:
    b = lifecycle.stale_briefs(lifecycle.stale_matches(c.notes, c.sessions, c.brief_map, AS_OF))
    return b.withColumns({k: minute(k) for k in ("review_date", "first_session", "last_session")})


@register(
    "resurface",
    S.with_(S.NOTES)
    + f"""SELECT * FROM (SELECT path, title, 'topic/' || lang AS topics, last_reviewed,
      CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(CAST(last_reviewed AS TIMESTAMP), CASE WHEN doc_id % 97 <> 0 THEN created_at END))) / 86400000000) AS INTEGER) AS age_days
    FROM notes WHERE type_tag = 'type/note') WHERE age_days >= 14""",
)
def resurface(c: Corpus) -> DataFrame:
    q = lifecycle.review_queue(c.notes, AS_OF)
    return q.withColumn("topics", F.array_join("topics", "|"))


@register(
    "topic_clusters",
    S.with_(S.NOTES)
    + f"""SELECT tag, n_notes FROM (SELECT 'topic/' || lang AS tag, count(*) FILTER (WHERE NOT {_MOC}) AS n_notes, bool_or({_MOC}) AS owned FROM notes GROUP BY 1)
    WHERE n_notes >= 3 AND NOT owned""",
)
def topic_clusters(c: Corpus) -> DataFrame:
    return lifecycle.topic_clusters(c.notes)


# The folders and line references that count as citations.
LINT = rf"""
struct_issues AS (
  SELECT 'missing-link' AS rule, path, 'Home.md does not link to MOC "' || title || '"' AS detail FROM unlinked_maps
  UNION ALL SELECT DISTINCT 'missing-link', src, 'unresolved [[' || target || ']]' FROM links WHERE dst IS NULL AND NOT starts_with(src, 'sessions/')
  UNION ALL SELECT 'missing-provenance', path, 'Evergreen note "' || title || '" has no Source: link' FROM notes
    WHERE type_tag = 'type/note' AND NOT regexp_matches(content, '(^|\n)\s*Source:\s*\[\[')),
refs AS (
  SELECT path, list_concat(list_distinct(regexp_extract_all(content, '(?:^|[\s(`''"])((?:src|lib|app|apps|packages|scripts|hooks|test|tests|bin|cmd|internal|pkg)/[\w.@-]+(?:/[\w.@-]+)*\.[a-z]{{1,5}})(?::\d+)?', 1)),
     list_distinct(regexp_extract_all(content, '(?i)(?:\b(?:line|lines)\s?\d{{1,5}}\b|#L\d{{1,5}}\b)'))) AS r
  FROM notes WHERE type_tag IN ('type/brief', 'type/note', 'type/reference', 'type/playbook')),
lint AS (
  SELECT 'orphan' AS rule, path, CASE WHEN reason = 'isolated' THEN 'nothing links to "' || title || '"'
     ELSE 'no MOC links to "' || title || '" (' || backlink_count || ' other backlink(s))' END AS detail FROM orphans
  UNION ALL SELECT * FROM struct_issues
  UNION ALL SELECT 'missing-page', tag, n_notes || ' notes carry ' || tag || ' and no MOC owns it' FROM (
    SELECT 'topic/' || lang AS tag, count(*) FILTER (WHERE NOT {_MOC}) AS n_notes, bool_or({_MOC}) AS owned FROM notes GROUP BY 1) WHERE n_notes >= 3 AND NOT owned
  UNION ALL SELECT 'stale-reference', path, 'cites ' || array_to_string(r[1:3], ', ') || CASE WHEN len(r) > 3 THEN ' (+' || (len(r) - 3) || ')' ELSE '' END FROM refs WHERE len(r) > 0
  UNION ALL SELECT 'missing-provenance', path, 'generated note has no sources/source/provenance frontmatter' FROM notes
    WHERE (kind = 1 OR starts_with(path, 'proposals/') OR doc_id % 50 = 7) AND NOT (
      (kind = 1 AND doc_id % 3 <> 0) OR doc_id % 7 = 0 OR (starts_with(path, 'proposals/') AND (contains(content, '[[sessions/') OR regexp_matches(content, 'sessions/\d{{4}}/')))))
"""
LINTED = (S.NOTES, S.LINKS, ORPHANS, LINT)


@register("lint_report", S.with_(*LINTED) + "SELECT rule, path, detail FROM lint")
def lint_report(c: Corpus) -> DataFrame:
    return lifecycle.lint(c.notes, c.links)


@register(
    "structure_issues",
    S.with_(*LINTED) + "SELECT path, detail FROM struct_issues",
)
def structure_issues(c: Corpus) -> DataFrame:
    return lifecycle.structure_issues(c.notes, c.links).select("path", "detail")


@register(
    "brief_stats",
    S.with_(S.NOTES)
    + "SELECT count(*) AS n_briefs, CAST(sum(length(content)) AS BIGINT) AS total_chars FROM notes WHERE type_tag = 'type/brief'",
)
def brief_stats(c: Corpus) -> DataFrame:
    return lifecycle.brief_stats(c.notes)


@register(
    "index_page",
    S.with_(S.NOTES)
    + rf""", blocks AS (SELECT *, trim(list_filter(list_transform(regexp_split_to_array(content, '\n\s*\n'), lambda b: trim(b, {S.WS})),
        lambda b: b <> '' AND NOT regexp_matches(b, '\A(#|---|```|\|)'))[1], {S.WS}) AS b FROM notes WHERE {_CURATED.format(p='path')}),
    summed AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(b, ''), '\s+', ' ', 'g'), '\[\[[^\]|]+\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]|]+)\]\]', '\1', 'g') AS s FROM blocks)
    SELECT CASE WHEN starts_with(path, 'sessions/digests/') THEN 'sessions/digests' WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS folder, path,
      '- [[' || regexp_replace(split_part(path, '/', -1), '\.md$', '') || '|' || title || ']] `' || substr(type_tag, 6) || '`'
      || CASE WHEN s = '' THEN '' ELSE ': ' || CASE WHEN length(s) > 120 THEN rtrim(substr(s, 1, 119), {S.WS}) || '…' ELSE s END END AS line FROM summed""",
)
def index_page(c: Corpus) -> DataFrame:
    return lifecycle.index_lines(c.notes)


APPLICABLE = """
applicable AS (
  SELECT path, target_brief, confidence, 2 AS n_edits, doc_id FROM notes WHERE kind = 2 AND status = 'proposed')
"""


@register(
    "applicable_proposals",
    S.with_(S.NOTES, APPLICABLE) + "SELECT path, target_brief, confidence, n_edits FROM applicable",
)
def applicable_proposals(c: Corpus) -> DataFrame:
    return proposals.applicable(c.notes).drop("edits")


@register(
    "apply_edits",
    S.with_(S.NOTES, APPLICABLE)
    + """SELECT a.path AS proposal, a.target_brief, a.doc_id % 8 = 2 AND n.path IS NOT NULL AS ok,
      CASE WHEN n.path IS NULL THEN 'Note not found' WHEN a.doc_id % 8 <> 2 THEN 'Cannot replace missing section "Notes"' END AS error,
      CASE WHEN a.doc_id % 8 = 2 THEN n.content || chr(10) || '- [[d' || a.doc_id || ']]' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || 'note ' || a.doc_id END AS new_body
    FROM applicable a LEFT JOIN notes n ON n.path = a.target_brief""",
)
def apply_edits(c: Corpus) -> DataFrame:
    out = proposals.apply_proposals(c.notes, proposals.applicable(c.notes), "2024-03-25")
    bodies = out["briefs"].select(F.col("path").alias("target_brief"), F.col("content").alias("new_body"))
    return out["results"].join(bodies, "target_brief", "left").select(
        "proposal", "target_brief", "ok", "error", "new_body"
    )


@register(
    "file_proposals",
    S.with_(S.NOTES)
    + f"""SELECT 'proposals/brief-updates/2024-03-25-' || CASE WHEN sl = '' THEN 'proposal' ELSE sl END || '.md' AS path, title, NULL AS reason FROM (
      SELECT *, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS sl FROM notes WHERE kind = 2) WHERE doc_id % 7 = 0
    UNION ALL SELECT NULL, title, 'no source' FROM notes WHERE kind = 2 AND doc_id % 7 <> 0""",
)
def file_proposals(c: Corpus) -> DataFrame:
    requests = c.notes.where(F.array_contains("tags", "type/proposal")).select(
        "title",
        F.col("fm.target_brief").alias("target"),
        F.col("fm.confidence").alias("confidence"),
        F.when(F.col("fm.source").isNotNull(), F.array("fm.source")).alias("sources"),
        F.col("content").alias("body"),
    )
    ok, bad = proposals.file_proposals(requests, AS_OF)
    return ok.select("path", "title", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.lit(None).cast("string").alias("path"), "title", "reason")
    )


@register(
    "weekly_summary",
    S.with_(*SESS, GROUPS, COVERED, S.LINKS, ORPHANS, LINT, APPLICABLE)
    + f"""SELECT 'digests' AS section, CASE WHEN exists THEN 'written' ELSE 'pending' END AS item, count(*) AS n FROM groups GROUP BY 1, 2
    UNION ALL SELECT 'proposals', confidence, count(*) FROM applicable GROUP BY 1, 2
    UNION ALL SELECT 'archived', 'candidates', count(*) FROM sess SEMI JOIN covered USING (path) WHERE {_OLD}
    UNION ALL SELECT 'health', rule, count(*) FROM lint GROUP BY 1, 2
    UNION ALL SELECT 'review', 'due', count(*) FROM notes WHERE type_tag = 'type/note' AND
      floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(CAST(last_reviewed AS TIMESTAMP), CASE WHEN doc_id % 97 <> 0 THEN created_at END))) / 86400000000) >= 14""",
)
def weekly_summary(c: Corpus) -> DataFrame:
    return lifecycle.weekly_summary(
        lifecycle.digest_groups(c.sessions, c.notes),
        proposals.applicable(c.notes),
        lifecycle.archive_plan(c.sessions, lifecycle.covered_sessions(c.notes), AS_OF),
        lifecycle.lint(c.notes, c.links),
        lifecycle.review_queue(c.notes, AS_OF),
    )


# --- redaction and log ------------------------------------------------------------------------------------


def _redact_sql(column: str) -> str:
    out = column
    for _, pattern, replacement in redact.RULES:
        flags = "g"
        p = pattern.replace("'", "''")
        r = replacement.replace("$1", "\\1").replace("'", "''")
        out = f"regexp_replace({out}, '{p}', '{r}', '{flags}')"
    named = redact.NAMED_VALUE.replace("'", "''")
    exempt = redact._EXEMPT.replace("'", "''")
    marked = f"regexp_replace({out}, '{named}', '{redact._OPEN}\\1\\2{redact._MID}\\3{redact._CLOSE}', 'g')"
    return f"regexp_replace({marked}, '{exempt}', '\\1\\2', 'g')"


_REST = redact._REST.replace("'", "''")


@register(
    "redact_secrets",
    f"SELECT doc_id, regexp_replace({_redact_sql('text')}, '{_REST}', '\\1[REDACTED]', 'g') AS redacted FROM documents",
)
def redact_secrets(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", redact.redact_secrets("text").alias("redacted"))


@register(
    "redact_strict_counts",
    "SELECT 'named_value' AS rule, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits FROM ("
    "SELECT len(regexp_extract_all("
    + _redact_sql("text").replace(
        redact.NAMED_VALUE.replace("'", "''"), redact.NAMED_VALUE_STRICT.replace("'", "''")
    )
    + f", '{_REST}')) AS n FROM documents) WHERE n > 0",
)
def redact_strict_counts(c: Corpus) -> DataFrame:
    """Hits per rule with bare names included; only the named-value rule fires on this corpus."""
    counted = redact.redaction_counts(c.table("documents").select("doc_id", "text"), "text", strict=True)
    return redact.redaction_totals(counted).withColumnRenamed("n_rows", "n_docs")


@register(
    "log_round_trip",
    S.with_(S.NOTES)
    + r"""SELECT 'capture' AS kind, strftime(created_at, '%Y-%m-%d') AS date,
      trim(regexp_replace(regexp_replace(title, '[|\r\n]+', ' ', 'g'), '\s+', ' ', 'g')) AS title, path FROM notes""",
)
def log_round_trip(c: Corpus) -> DataFrame:
    """Every note as a log line, and the lines parsed again."""
    events = c.notes.select(
        F.col("doc_id").alias("seq"), F.col("created_at").cast("date").alias("date"),
        F.lit("capture").alias("kind"), "title", "path",
    )
    lines = events.select(
        "seq",
        log_files.format_log_line(F.col("date"), F.col("kind"), F.col("title"), F.col("path")).alias("line"),
    )
    parsed = log_files.parse_log(lines)
    return parsed.select("kind", F.date_format("date", "yyyy-MM-dd").alias("date"), "title", "path")


@register(
    "log_tail",
    S.with_(S.NOTES) + "SELECT doc_id AS seq, path FROM notes WHERE kind = 0 ORDER BY doc_id DESC LIMIT 20",
)
def log_tail(c: Corpus) -> DataFrame:
    kind = F.when(F.array_contains("tags", "type/session"), "capture").otherwise("index")
    events = c.notes.select(F.col("doc_id").alias("seq"), kind.alias("kind"), "path")
    return log_files.log_tail(events, 20, "capture").select("seq", "path")


@register(
    "render_parse",
    S.with_(S.NOTES)
    + """SELECT path, title, type_tag || '|' || 'project/' || source AS tags, sha1(content) AS body_hash,
      CASE WHEN doc_id % 97 = 0 THEN 'not-a-date' ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') END AS created, last_reviewed, status,
      CASE WHEN kind = 3 THEN 'b' || doc_id END AS alias, doc_id % 97 = 0 AS malformed
    FROM (SELECT * FROM notes)""",
)
def render_parse(c: Corpus) -> DataFrame:
    """Notes rendered to file text and parsed back: frontmatter and body must survive."""
    tagged = c.notes.withColumn("fm", F.col("fm").withField("tags", F.slice("tags", 1, 2)))
    raw = note_source.render_notes(tagged).join(
        c.notes.select("path", "modified_at", "size"), "path"
    )
    back = note_source.parse_notes(raw)
    declared = F.filter("tags", lambda t: F.startswith(t, F.lit("type/")) | F.startswith(t, F.lit("project/")))
    by_kind = F.array_sort(declared, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    return back.select(
        "path",
        "title",
        F.array_join(by_kind, "|").alias("tags"),
        F.sha1("content").alias("body_hash"),
        F.col("fm.created").alias("created"),
        F.col("fm.last_reviewed").alias("last_reviewed"),
        F.col("fm.status").alias("status"),
        F.try_element_at(F.col("fm.aliases"), F.lit(1)).alias("alias"),
        "malformed",
    )


@register(
    "upsert_notes",
    S.with_(S.NOTES)
    + """SELECT count(*) AS n_notes, CAST(sum(length(content) + CASE WHEN kind = 3 THEN 6 WHEN kind = 4 THEN 7 ELSE 0 END) AS BIGINT) AS n_chars,
      count(*) FILTER (WHERE kind = 3) AS n_rejected FROM notes""",
)
def upsert_notes(c: Corpus) -> DataFrame:
    """Append to briefs, prepend to references, and try to create every brief again."""
    fm_type = c.notes.schema["fm"].dataType.simpleString()
    base = [F.lit(None).cast(fm_type).alias("fm"), F.lit(AS_OF).cast("timestamp").alias("changed_at")]
    has = lambda t: F.array_contains("tags", t)
    changes = c.notes.where(has("type/brief") | has("type/reference")).select(
        "path",
        F.lit("update").alias("op"),
        F.when(has("type/brief"), "append").otherwise("prepend").alias("mode"),
        F.when(has("type/brief"), "more").otherwise("ahead").alias("content"),
        *base,
    )
    again = c.notes.where(has("type/brief")).select(
        "path", F.lit("create").alias("op"), F.lit("replace").alias("mode"), F.lit("x").alias("content"), *base
    )
    notes = c.notes.drop("doc_id")
    new, _ = note_source.upsert_notes(notes, changes)
    _, rejected = note_source.upsert_notes(notes, again)
    sizes = new.agg(
        F.count(F.lit(1)).alias("n_notes"), F.sum(F.length("content").cast("long")).alias("n_chars")
    )
    n = rejected.where(F.col("reason") == "exists").agg(F.count(F.lit(1)).alias("n")).scalar()
    return sizes.withColumn("n_rejected", n)


# --- capture -------------------------------------------------------------------------------------------

CONV = rf"""
conv AS (
  SELECT 'conv-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS session_id, conv_id, turn AS pos, role, text,
    TIMESTAMP '2024-02-01' + to_hours(CAST(conv_id % 2000 AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS ts,
    trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS clean,
    CASE WHEN role = 'assistant' THEN (conv_id + turn) % 4 ELSE -1 END AS k
  FROM conversations),
facts AS (
  SELECT session_id, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS n_messages,
    count(*) FILTER (WHERE k = 0) AS n_writes, min(ts) AS first_ts,
    arg_min(substr(clean, 1, 200), pos) FILTER (WHERE role = 'user' AND length(clean) > 10) AS first_message
  FROM conv GROUP BY 1),
kept AS (SELECT * FROM facts WHERE n_messages >= 6 OR n_writes > 0)
"""


def _lines(c: Corpus) -> DataFrame:
    return capture.parse_lines(D.transcripts(c.spark, c.sf_dir))


@register(
    "session_facts",
    S.with_(CONV)
    + f"""SELECT session_id, n_messages, n_writes, strftime(first_ts, '%Y-%m-%d %H:%M') AS first_ts,
      regexp_replace({_redact_sql("coalesce('Session: ' || substr(first_message, 1, 80), 'Session: ' || substr(session_id, 1, 8))")}, '{_REST}', '\\1[REDACTED]', 'g') AS title FROM kept""",
)
def session_facts(c: Corpus) -> DataFrame:
    return capture.session_facts(_lines(c)).select(
        "session_id", "n_messages", "n_writes", minute("first_ts").alias("first_ts"), capture.session_title().alias("title")
    )


@register(
    "session_topics",
    S.with_(CONV)
    + r"""SELECT session_id, string_agg(t, '|' ORDER BY pos) AS topics FROM (
      SELECT session_id, pos, CASE WHEN length(clean) > 100 THEN substr(clean, 1, 100) || '...' ELSE clean END AS t,
        row_number() OVER (PARTITION BY session_id ORDER BY pos) AS r
      FROM conv WHERE role = 'user' AND length(clean) > 10 AND NOT regexp_matches(clean, '^(?i)[a-f0-9-]{20,}$')) WHERE r <= 20 GROUP BY 1""",
)
def session_topics(c: Corpus) -> DataFrame:
    return capture.topics(_lines(c)).select("session_id", F.array_join("topics", "|").alias("topics"))


@register(
    "session_files",
    S.with_(CONV)
    + """SELECT session_id, string_agg(f, '|' ORDER BY p) AS files FROM (
      SELECT session_id, 'src/mod' || (pos % 3) || '.py' AS f, min(pos) AS p FROM conv WHERE k = 0 GROUP BY 1, 2) GROUP BY 1""",
)
def session_files(c: Corpus) -> DataFrame:
    files = capture.files_changed(capture.tool_calls(_lines(c)))
    return files.select("session_id", F.array_join("files", "|").alias("files"))


@register(
    "session_commands",
    S.with_(CONV)
    + """SELECT session_id, string_agg(t, '|' ORDER BY pos) AS commands FROM (
      SELECT session_id, pos, 'make step' || pos AS t, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS r FROM conv WHERE k = 0) WHERE r <= 30 GROUP BY 1""",
)
def session_commands(c: Corpus) -> DataFrame:
    cmds = capture.commands(capture.tool_calls(_lines(c)))
    return cmds.select("session_id", F.array_join("commands", "|").alias("commands"))


@register(
    "tool_calls",
    S.with_(CONV)
    + """SELECT CASE WHEN x = 'e' THEN 'Edit' ELSE 'Bash' END AS name, count(*) AS n, count(DISTINCT session_id) AS n_sessions
      FROM (SELECT session_id, unnest(CASE k WHEN 0 THEN ['e', 'b'] WHEN 1 THEN ['b'] ELSE [] END) AS x FROM conv) GROUP BY 1""",
)
def tool_calls(c: Corpus) -> DataFrame:
    per_session = capture.tool_calls(_lines(c)).groupBy("name", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return per_session.groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sessions"))


def _project_map(c: Corpus) -> DataFrame:
    """Projects of the corpus, one per region of the driver's tables, plus a default."""
    rows = c.table("region").select(
        F.concat(F.lit("team"), F.col("r_regionkey").cast("string")).alias("slug"),
        F.lower("r_name").alias("vault_id"),
    )
    rows = rows.where(F.col("slug") != "team3")
    return rows.unionByName(
        rows.agg(F.lit("_default").alias("slug"), F.lit("main").alias("vault_id"))
    )


@register(
    "capture_notes",
    S.with_(CONV)
    + """SELECT k.session_id, coalesce((SELECT lower(r_name) FROM region WHERE r_regionkey <> 3 AND r_regionkey = CAST(substr(k.session_id, 6) AS BIGINT) % 5), 'main') AS vault_id,
      'sessions/2024/03-25/worktree-' || substr(k.session_id, 1, 8) || '.md' AS path, strftime(first_ts, '%Y-%m-%dT%H:%M:%S.000Z') AS created, TRUE AS is_new FROM kept k""",
)
def capture_notes(c: Corpus) -> DataFrame:
    none_yet = c.notes.select("path", F.lit(None).cast("string").alias("created")).where(
        F.startswith("path", F.lit("sessions/archive/"))
    )
    out = capture.session_notes(D.transcripts(c.spark, c.sf_dir), _project_map(c), none_yet, AS_OF)
    return out.select("session_id", "vault_id", "path", "created", "is_new")


@register(
    "nearest_project",
    r"""WITH p AS (SELECT DISTINCT '/' || regexp_replace(url, '^[a-z]+://([^?#]*).*$', '\1') AS cwd FROM pages),
    parts AS (SELECT cwd, unnest(list_filter(string_split(cwd, '/'), lambda x: x <> '')) AS slug,
                unnest(range(len(list_filter(string_split(cwd, '/'), lambda x: x <> '')))) AS depth FROM p),
    m AS (SELECT cwd, arg_max(lang, depth) AS vault_id, arg_max(slug, depth) AS matched FROM parts
          JOIN (SELECT DISTINCT lang FROM documents) l ON l.lang = parts.slug GROUP BY 1)
    SELECT p.cwd, split_part(rtrim(p.cwd, '/'), '/', -1) AS slug, coalesce(m.vault_id, 'main') AS vault_id, m.matched FROM p LEFT JOIN m USING (cwd)""",
)
def nearest_project(c: Corpus) -> DataFrame:
    """Page addresses as folders, document languages as mapped projects."""
    cwds = c.table("pages").select(
        F.concat(F.lit("/"), F.regexp_replace("url", r"\A[a-z]+://([^?#]*).*\z", "$1")).alias("cwd")
    )
    langs = c.table("documents").select(F.col("lang").alias("slug")).distinct()
    mapped = langs.select("slug", F.col("slug").alias("vault_id"))
    default = langs.agg(F.lit("_default").alias("slug"), F.lit("main").alias("vault_id"))
    return capture.resolve_projects(cwds, mapped.unionByName(default))


# --- evaluation ------------------------------------------------------------------------------------------


def _ranked_as_cases(c: Corpus) -> DataFrame:
    hits = c.hits(3 * K)
    return hits.select(F.lit("keyword").alias("mode"), F.col("query_id").alias("case_id"), "path", "rank")


def score_sql(ranked: str, modes: list[str]) -> str:
    m = "', '".join(modes)
    return f"""
found AS (
  SELECT r.mode, r.case_id, count(*) AS n_ret, count(g.path) AS n_hits, min(CASE WHEN g.path IS NOT NULL THEN rank END) AS first_hit
  FROM {ranked} r LEFT JOIN (SELECT DISTINCT case_id, path FROM gold) g ON g.case_id = r.case_id AND g.path = r.path WHERE rank <= {K} GROUP BY 1, 2),
scores AS (
  SELECT c.case_id, c.negative, m.mode, CASE WHEN c.negative THEN 0 ELSE coalesce(n_hits, 0) END AS hits,
    CASE WHEN NOT c.negative AND n_hits > 0 THEN n_hits / n_ret ELSE 0.0 END AS precision,
    CASE WHEN NOT c.negative AND n_hits > 0 THEN n_hits / e.n ELSE 0.0 END AS recall,
    NOT c.negative AND coalesce(n_hits, 0) > 0 AS success, CASE WHEN NOT c.negative AND n_hits > 0 THEN 1.0::DOUBLE / first_hit ELSE 0.0 END AS rr
  FROM cases c CROSS JOIN (SELECT unnest(['{m}']) AS mode) m LEFT JOIN found f ON f.case_id = c.case_id AND f.mode = m.mode
  LEFT JOIN (SELECT case_id, count(DISTINCT path) AS n FROM gold GROUP BY 1) e ON e.case_id = c.case_id)
"""


KW_RANKED = "ranked AS (SELECT 'keyword' AS mode, query_id AS case_id, path, rank FROM kw)"


@register(
    "precision_recall",
    S.with_(*S.CASE_PARTS, S.POSTINGS, S.expanded("qt", "queries", "query"), S.hits("kw", "qt", 3 * K), KW_RANKED, score_sql("ranked", ["keyword"]))
    + "SELECT case_id, negative, mode, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, success, round(rr, 6) AS rr FROM scores",
)
def precision_recall(c: Corpus) -> DataFrame:
    s = evals.score_cases(c.cases, c.gold, _ranked_as_cases(c), K, ("keyword",))
    return _rounded(s, "precision", "recall", "rr")


MODES_SQL = (
    *S.CASE_PARTS,
    S.MAP,
    S.semantic(3 * K),
    S.POSTINGS,
    S.expanded("qt", "queries", "query"),
    S.hits("kw", "qt", 3 * K),
    *_routes_sql("rq", "query"),
    *_routes_sql("rt", "topic"),
    "pq AS (SELECT query_id, path, 1 AS pin_ord FROM rq WHERE path IS NOT NULL)",
    "pt AS (SELECT query_id, path, 1 AS pin_ord FROM rt WHERE path IS NOT NULL)",
    S.fused("f0", ["kw", "sem"]),
    S.fused("f1", ["kw", "sem"], "pq"),
    S.fused("f2", ["kw", "sem"], "pt"),
    "ranked AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS mode, query_id AS case_id, path, rank FROM {t}"
        for m, t in zip(evals.MODES, ("kw", "sem", "f0", "f1", "f2"), strict=True)
    )
    + ")",
    score_sql("ranked", list(evals.MODES)),
    "rhits AS (SELECT c.case_id, c.negative, c.stratum, r.path, r.method, c.expected_brief, r.path IS NOT DISTINCT FROM CASE WHEN c.negative THEN NULL ELSE c.expected_brief END AS routing_hit FROM cases c JOIN rt r ON r.query_id = c.case_id)",
)


def _five(c: Corpus) -> DataFrame:
    return search.five_modes(c.hits(3 * K), c.semantic, c.routes("query"), c.routes("topic"))


def _five_scores(c: Corpus) -> DataFrame:
    return evals.score_cases(c.cases, c.gold, _five(c), K, evals.MODES)


@register(
    "mode_compare",
    S.with_(*MODES_SQL)
    + """SELECT mode, count(*) AS n_cases, count(*) FILTER (WHERE NOT negative) AS n_positive,
      round(coalesce(avg(recall) FILTER (WHERE NOT negative), 0), 6) AS recall, round(coalesce(avg(success::INT) FILTER (WHERE NOT negative), 0), 6) AS success,
      round(coalesce(avg(rr) FILTER (WHERE NOT negative), 0), 6) AS mrr, round(coalesce(avg(precision) FILTER (WHERE NOT negative), 0), 6) AS precision
    FROM scores GROUP BY 1""",
)
def mode_compare(c: Corpus) -> DataFrame:
    return _rounded(evals.aggregate_modes(_five_scores(c)), "recall", "success", "mrr", "precision")


@register(
    "parity_delta",
    S.with_(*MODES_SQL)
    + """SELECT round(avg(recall) FILTER (WHERE mode = 'hybrid_topic_pin') - avg(recall) FILTER (WHERE mode = 'hybrid_query_pin'), 6) + 0.0 AS recall_delta,
      round(avg(success::INT) FILTER (WHERE mode = 'hybrid_topic_pin') - avg(success::INT) FILTER (WHERE mode = 'hybrid_query_pin'), 6) + 0.0 AS success_delta
    FROM scores WHERE NOT negative""",
)
def parity_delta(c: Corpus) -> DataFrame:
    d = evals.parity_delta(evals.aggregate_modes(_five_scores(c)))
    return d.select(*[(F.round(x, 6) + F.lit(0.0)).alias(x) for x in d.columns])


@register(
    "strata",
    S.with_(*MODES_SQL)
    + """SELECT stratum, count(*) AS n, round(avg(success::INT) FILTER (WHERE NOT s.negative), 6) AS success,
      round(avg(routing_hit::INT) FILTER (WHERE s.negative), 6) AS negative_accuracy
    FROM scores s JOIN rhits r USING (case_id) WHERE mode = 'hybrid_query_pin' GROUP BY ROLLUP (stratum)""",
)
def strata(c: Corpus) -> DataFrame:
    hits = evals.routing_hits(c.cases, c.routes("topic"))
    out = evals.by_stratum(_five_scores(c), hits, c.cases, "hybrid_query_pin")
    return _rounded(out, "success", "negative_accuracy")


@register(
    "routing_accuracy",
    S.with_(*ROUTED, *_routes_sql("r", "topic"))
    + """SELECT round(avg(ok::INT) FILTER (WHERE NOT negative), 6) AS routing_accuracy, round(coalesce(avg(ok::INT) FILTER (WHERE negative), 1), 6) AS negative_accuracy
    FROM (SELECT c.negative, r.path IS NOT DISTINCT FROM CASE WHEN c.negative THEN NULL ELSE c.expected_brief END AS ok FROM cases c JOIN r ON r.query_id = c.case_id)""",
)
def routing_accuracy(c: Corpus) -> DataFrame:
    out = evals.aggregate_routing(evals.routing_hits(c.cases, c.routes("topic")))
    return _rounded(out, "routing_accuracy", "negative_accuracy")


@register(
    "pin_harm",
    S.with_(*MODES_SQL)
    + f""", best AS (SELECT r.case_id, r.mode, min(rank) AS b FROM ranked r JOIN gold g ON g.case_id = r.case_id AND g.path = r.path WHERE rank <= {K} GROUP BY 1, 2),
    x AS (SELECT c.case_id, c.negative, r.path IS NOT NULL AND r.path IS DISTINCT FROM c.expected_brief AS wrong_route,
        EXISTS (SELECT 1 FROM f0 WHERE f0.query_id = c.case_id AND f0.path = r.path) AS retrieved, a.b AS raw_best, p.b AS pin_best
      FROM cases c LEFT JOIN rq r ON r.query_id = c.case_id LEFT JOIN best a ON a.case_id = c.case_id AND a.mode = 'hybrid_raw'
      LEFT JOIN best p ON p.case_id = c.case_id AND p.mode = 'hybrid_query_pin')
    SELECT case_id, wrong_route, wrong_route AND retrieved AS applied, CASE WHEN wrong_route AND retrieved AND NOT negative AND raw_best IS NOT NULL AND pin_best IS NULL THEN 'severe'
      WHEN wrong_route AND retrieved AND NOT negative AND raw_best = 1 AND coalesce(pin_best, 0) <> 1 THEN 'rank1_lost' ELSE 'none' END AS regression FROM x""",
)
def pin_harm(c: Corpus) -> DataFrame:
    kw, sem, routes = c.hits(3 * K), c.semantic, c.routes("query")
    as_case = lambda d: d.withColumnRenamed("query_id", "case_id")
    raw = as_case(search.hybrid_ranks(kw, sem, None, None))
    pinned = as_case(search.hybrid_ranks(kw, sem, routes, None))
    return evals.pin_harm(c.cases, c.gold, routes, raw, raw, pinned, K)


@register(
    "misses",
    S.with_(*MODES_SQL)
    + """SELECT r.case_id, r.stratum, r.negative, coalesce(r.path, 'abstain') AS routed, coalesce(expected_brief, 'none') AS wanted FROM rhits r
      JOIN scores s ON s.case_id = r.case_id AND s.mode = 'hybrid_query_pin' WHERE CASE WHEN r.negative THEN NOT routing_hit ELSE NOT success OR NOT routing_hit END""",
)
def misses(c: Corpus) -> DataFrame:
    hits = evals.routing_hits(c.cases, c.routes("topic"))
    out = evals.misses(_five_scores(c), hits, c.cases)
    routed = hits.select("case_id", F.coalesce("path", F.lit("abstain")).alias("routed"))
    return out.join(routed, "case_id").select("case_id", "stratum", "negative", "routed", "wanted")


BOOT_ITERS = 1000


def bootstrap_sql(source: str, group: str, iters: int = BOOT_ITERS, seed: int = 42) -> str:
    """``source``: group, ix (0-based), v. Jumps through the generator bit by bit."""
    s = f"CAST({seed} AS HUGEINT)"
    for j, (a, cc) in enumerate(evals.lcg_steps()[:28]):
        s = f"(CASE WHEN (n_draw // {2**j}) % 2 = 1 THEN ({s} * {a} + {cc}) % 4294967296 ELSE {s} END)" if j < 1 else s
    steps = [f"b0 AS (SELECT *, {s} AS s0 FROM draws)"]
    for j, (a, cc) in enumerate(evals.lcg_steps()[1:28], start=1):
        steps.append(
            f"b{j} AS (SELECT {group}, it, n, n_draw, CASE WHEN (n_draw // {2**j}) % 2 = 1 THEN (s{j-1} * {a} + {cc}) % 4294967296 ELSE s{j-1} END AS s{j} FROM b{j-1})"
        )
    lo, hi = int(iters * 0.025), int(iters * 0.975)
    return f"""
sized AS (SELECT {group}, ix, v, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
draws AS (SELECT {group}, n, it, it * n + ix + 1 AS n_draw FROM sized CROSS JOIN (SELECT unnest(range({iters})) AS it)),
{", ".join(steps)},
means AS (SELECT b.{group}, it, avg(z.v) AS m FROM b27 b JOIN sized z ON z.{group} = b.{group} AND z.ix = CAST(floor(CAST(s27 AS DOUBLE) / 4294967296.0 * b.n) AS BIGINT) GROUP BY 1, 2),
ranked_means AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY m) - 1 AS r FROM means),
boot AS (SELECT z.{group}, any_value(z.n) AS n, round(avg(z.v), 6) AS mean, round((SELECT m FROM ranked_means k WHERE k.{group} = z.{group} AND r = {lo}), 6) AS lo,
  round((SELECT m FROM ranked_means k WHERE k.{group} = z.{group} AND r = {hi}), 6) AS hi FROM sized z GROUP BY z.{group})
"""


@register(
    "bootstrap_ci",
    S.with_(
        "samples AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ix, CAST(quality AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id))",
        bootstrap_sql("samples", "source"),
    )
    + "SELECT source, n, mean, lo, hi FROM boot",
)
def bootstrap_ci(c: Corpus) -> DataFrame:
    """Intervals of the share of good documents per source."""
    rows = c.table("labels").join(c.table("documents").select("doc_id", "source"), "doc_id")
    out = evals.bootstrap_ci(rows, ["source"], "doc_id", "quality", iters=BOOT_ITERS)
    return _rounded(out, "mean", "lo", "hi")


def weighted_sql(iters: int = BOOT_ITERS, seed: int = 42) -> str:
    weight = " + ".join(f"(u >= {at})::INT" for at in evals.poisson_steps())
    lo, hi = int(iters * 0.025) + 1, int(iters * 0.975) + 1
    return f"""WITH RECURSIVE jumps AS (
      SELECT 1 AS it, {evals.LCG_A}::HUGEINT AS a, {evals.LCG_C}::HUGEINT AS c
      UNION ALL SELECT it + 1, a * {evals.LCG_A} % {evals.LCG_M}, (c * {evals.LCG_A} + {evals.LCG_C}) % {evals.LCG_M} FROM jumps WHERE it < {iters}),
    samples AS (SELECT source, CAST(quality AS DOUBLE) AS v, ('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 8))::BIGINT::HUGEINT AS s
      FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    draws AS (SELECT source, v, it, (s * a + c) % {evals.LCG_M} AS u FROM samples CROSS JOIN jumps),
    weights AS (SELECT source, v, it, {weight} AS w FROM draws),
    plain AS (SELECT source, count(*) AS n, avg(v) AS mean FROM samples GROUP BY source),
    means AS (SELECT source, it, CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) END AS m FROM weights GROUP BY source, it),
    boot AS (SELECT p.source, any_value(n) AS n, any_value(mean) AS mean, list_sort(list(coalesce(m, mean))) AS ms
      FROM plain p JOIN means k ON k.source IS NOT DISTINCT FROM p.source GROUP BY p.source)
    SELECT source, n, round(mean, 6) AS mean, round(ms[{lo}], 6) AS lo, round(ms[{hi}], 6) AS hi FROM boot"""


@register("bootstrap_weighted", weighted_sql())
def bootstrap_weighted(c: Corpus) -> DataFrame:
    """The same intervals from weights per row, in one pass."""
    rows = c.table("labels").join(c.table("documents").select("doc_id", "source"), "doc_id")
    out = evals.bootstrap_weighted(rows, ["source"], "doc_id", "quality", iters=BOOT_ITERS)
    return _rounded(out, "mean", "lo", "hi")


# --- answer quality ------------------------------------------------------------------------------------------


def _task_cases(c: Corpus) -> DataFrame:
    """Every labelled document is a question; its source is the stratum, toxic ones are negative."""
    rows = c.table("labels").join(c.table("documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return rows.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("stratum"),
        (F.col("toxic") == 1).alias("negative"),
        "quality",
        "toxic",
        "n_chars",
        "doc_id",
    )


def _judgments(c: Corpus) -> DataFrame:
    """Two passes per case: the first ranks by quality, the second by toxicity."""
    t = _task_cases(c).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"))
    good = F.when(F.col("pass") == 0, F.col("quality") == 1).otherwise(F.col("toxic") == 0)
    conds = answers.CONDITIONS
    best = F.array(F.lit(conds[2]), F.lit(conds[1]), F.lit(conds[0]))
    worst = F.array(F.lit(conds[1]), F.lit(conds[0]), F.lit(conds[2]))

    def score(shift: int):
        x = F.col("doc_id") + F.col("pass") + shift
        return F.struct(
            (x % 3).cast("int").alias("correctness"),
            ((x + 1) % 3).cast("int").alias("grounding"),
            (x % 2).cast("int").alias("fabrication"),
            (x % 4 == 0).alias("abstained"),
        )

    scores = F.create_map(*[p for i, k in enumerate(conds) for p in (F.lit(k), score(i))])
    return t.select(
        F.col("id").alias("case_id"),
        "pass",
        F.when(good, best).otherwise(worst).alias("ranking"),
        scores.alias("scores"),
        F.concat(F.lit("pass "), F.col("pass").cast("string")).alias("reason"),
    )


def _answers(c: Corpus) -> DataFrame:
    return answers.answer_plan(_task_cases(c)).join(
        _task_cases(c).select(F.col("id").alias("case_id"), "n_chars", "doc_id"), "case_id"
    ).select(
        "case_id",
        "condition",
        F.concat(F.lit("answer "), "condition").alias("text"),
        F.col("n_chars").alias("latency_ms"),
        (F.col("n_chars") / 1000).alias("cost_usd"),
        F.when((F.col("doc_id") % 11 == 0) & (F.col("condition") == "plugin"), "timed out").alias("error"),
    )


TASKS = """
tcases AS (SELECT CAST(l.doc_id AS VARCHAR) AS case_id, l.doc_id, d.lang AS stratum, l.toxic = 1 AS negative, quality, toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
jd AS (
  SELECT t.*, p.pass, c.condition, c.shift, t.doc_id + p.pass + c.shift AS x,
    CASE WHEN (p.pass = 0 AND quality = 1) OR (p.pass = 1 AND toxic = 0) THEN c.condition <> 'bare' ELSE c.condition = 'recall' END AS beats
  FROM tcases t CROSS JOIN (SELECT unnest([0, 1]) AS pass) p CROSS JOIN (SELECT unnest(['bare', 'recall', 'plugin']) AS condition, unnest([0, 1, 2]) AS shift) c),
outcomes AS (
  SELECT case_id, stratum, condition, avg(x % 3) AS correctness,
    CASE WHEN condition = 'bare' THEN NULL WHEN bool_and(beats) THEN 'win' WHEN NOT bool_or(beats) THEN 'loss' ELSE 'tie' END AS outcome FROM jd GROUP BY case_id, stratum, condition)
"""


@register("task_outcomes", S.with_(TASKS) + "SELECT case_id, condition, round(correctness, 6) AS correctness, outcome FROM outcomes")
def task_outcomes(c: Corpus) -> DataFrame:
    return _rounded(answers.case_outcomes(_judgments(c)), "correctness")


@register(
    "condition_summary",
    S.with_(
        TASKS,
        "wins AS (SELECT condition, row_number() OVER (PARTITION BY condition ORDER BY case_id) - 1 AS ix, CAST(outcome = 'win' AS DOUBLE) AS v FROM (SELECT condition, case_id, CAST(outcome = 'win' AS INTEGER) AS w, outcome FROM outcomes WHERE outcome IS NOT NULL))",
        bootstrap_sql("wins", "condition"),
        "per_case AS (SELECT case_id, condition, negative, bool_and(x % 4 = 0) AS ab, bool_and(x % 3 = 2) AS fu FROM jd GROUP BY case_id, condition, negative)",
    )
    + """SELECT j.condition, count(DISTINCT j.case_id) AS n, round(avg(x % 3), 6) AS mean_correctness, round(avg((x + 1) % 3), 6) AS mean_grounding, round(avg(x % 2), 6) AS fabrication_rate,
      round((SELECT avg(ab::INT) FROM per_case p WHERE p.condition = j.condition AND negative), 6) AS negative_abstain_rate,
      round((SELECT avg(fu::INT) FROM per_case p WHERE p.condition = j.condition AND NOT negative), 6) AS fully_correct_rate,
      (SELECT count(*) FROM outcomes o WHERE o.condition = j.condition AND outcome = 'win') AS wins, (SELECT count(*) FROM outcomes o WHERE o.condition = j.condition AND outcome = 'loss') AS losses,
      (SELECT count(*) FROM outcomes o WHERE o.condition = j.condition AND outcome = 'tie') AS ties,
      coalesce((SELECT mean FROM boot b WHERE b.condition = j.condition), 0) AS win_rate, coalesce((SELECT lo FROM boot b WHERE b.condition = j.condition), 0) AS lo,
      coalesce((SELECT hi FROM boot b WHERE b.condition = j.condition), 0) AS hi, round(avg(n_chars), 6) AS mean_latency_ms, round(avg(n_chars / 1000), 6) AS mean_cost_usd,
      count(DISTINCT CASE WHEN j.condition = 'plugin' AND doc_id % 11 = 0 THEN j.case_id END) AS errors FROM jd j GROUP BY j.condition""",
)
def condition_summary(c: Corpus) -> DataFrame:
    out = answers.condition_summary(_task_cases(c), _answers(c), _judgments(c), iters=BOOT_ITERS)
    floats = [n for n, t in out.dtypes if t == "double"]
    return _rounded(out, *floats)


@register(
    "stratum_summary",
    S.with_(TASKS)
    + """SELECT o.stratum, condition, any_value(s.n) AS n, round(avg(CASE WHEN outcome IS NOT NULL THEN (outcome = 'win')::INT END), 6) AS win_rate, round(avg(correctness), 6) AS mean_correctness
      FROM outcomes o JOIN (SELECT stratum, count(*) AS n FROM tcases GROUP BY 1) s ON s.stratum = o.stratum GROUP BY 1, 2""",
)
def stratum_summary(c: Corpus) -> DataFrame:
    out = answers.stratum_summary(_task_cases(c), answers.case_outcomes(_judgments(c)))
    return _rounded(out, "win_rate", "mean_correctness")


@register(
    "task_losses",
    S.with_(TASKS)
    + "SELECT case_id, stratum, string_agg(condition, '|' ORDER BY condition) AS lost, 'pass 0' AS reason FROM outcomes WHERE outcome = 'loss' GROUP BY 1, 2",
)
def task_losses(c: Corpus) -> DataFrame:
    j = _judgments(c)
    out = answers.losses(_task_cases(c), answers.case_outcomes(j), j)
    return out.withColumn("lost", F.array_join("lost", "|"))


@register(
    "task_pending",
    S.with_(TASKS)
    + "SELECT case_id, c.condition FROM tcases CROSS JOIN (SELECT unnest(['bare', 'recall', 'plugin']) AS condition) c WHERE c.condition = 'plugin' AND doc_id % 11 = 0",
)
def task_pending(c: Corpus) -> DataFrame:
    """Work left when everything ran once: the answers that failed."""
    plan = answers.answer_plan(_task_cases(c))
    return answers.pending(plan, _answers(c), ["case_id", "condition"])


@register("judge_prompts")
def judge_prompts(c: Corpus) -> DataFrame:
    cases = _task_cases(c).join(
        c.table("documents").select("doc_id", F.col("text").alias("gold")), "doc_id"
    ).withColumns({"question": F.concat(F.lit("What does document "), "id", F.lit(" say?")), "notes": F.lit(None).cast("string")})
    orders = answers.shown_order(answers.judge_plan(cases, 2))
    out = answers.judge_prompts(cases, _answers(c), orders)
    return out.select("case_id", "pass", F.regexp_count("prompt", F.lit("(?m)^### Answer ")).alias("n_answers"))


# --- health -----------------------------------------------------------------------------------------------


@register(
    "health_sizes",
    S.with_(S.NOTES)
    + """SELECT path, CAST(round(size / 1024) AS BIGINT) AS kb, CASE WHEN size / 1024 > 4 THEN 'fail' ELSE 'warn' END AS level FROM notes WHERE kind = 3 AND size / 1024 > 1""",
)
def health_sizes(c: Corpus) -> DataFrame:
    return health.oversized_briefs(c.notes, warn_kb=1, fail_kb=4)


@register("backlog", S.with_(*SESS, GROUPS) + "SELECT project, period FROM groups WHERE NOT exists")
def backlog(c: Corpus) -> DataFrame:
    groups = lifecycle.digest_groups(c.sessions, c.notes)
    return health.digest_backlog(groups).select("project", "period")


@register(
    "newer_than_index",
    S.with_(S.NOTES) + "SELECT count(*) FILTER (WHERE modified_at > TIMESTAMP '2024-03-01') AS n_newer FROM notes",
)
def newer_than_index(c: Corpus) -> DataFrame:
    return health.newer_than_index(c.notes, "2024-03-01 00:00:00")


@register(
    "run_age",
    S.with_(S.NOTES)
    + f"""SELECT v.source AS vault_id, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(m)) / 86400000000) AS INTEGER) AS days,
      CASE WHEN m IS NULL THEN 'warn' WHEN floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(m)) / 86400000000) <= 10 THEN 'pass' ELSE 'fail' END AS level
    FROM (SELECT DISTINCT source FROM notes) v LEFT JOIN (SELECT source, max(modified_at) AS m FROM notes WHERE kind = 1 GROUP BY 1) r USING (source)""",
)
def run_age(c: Corpus) -> DataFrame:
    """Projects as corpora, their digests as run reports."""
    by_project = c.notes.withColumn("vault_id", text.project_of("tags")).withColumn(
        "path", F.regexp_replace("path", r"\Asessions/digests/", "sessions/digests/_runs/")
    )
    return health.run_age(by_project.select("vault_id").distinct(), by_project, AS_OF)


@register(
    "iso_weeks",
    "SELECT strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2",
)
def iso_weeks(c: Corpus) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return c.table("events").groupBy(
        dates.iso_week(ts).alias("week"), dates.year_month(ts).alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))


@register(
    "truncated_bodies",
    S.with_(S.NOTES)
    + r""", w AS (SELECT path, content, substr(content, 1, 600) AS win FROM notes),
    p AS (SELECT *, length(win) - length(regexp_extract(win, '(?s)^.*\n## (.*)$', 1)) - 4 AS h0, regexp_matches(win, '\n## ') AS hh,
       length(win) - length(regexp_extract(win, '(?s)^.*\n\n(.*)$', 1)) - 2 AS p0, contains(win, chr(10) || chr(10)) AS pp FROM w)
    SELECT path, CAST(length(CASE WHEN length(content) <= 600 THEN content WHEN hh AND h0 > 300 THEN rtrim(substr(content, 1, h0), """
    + S.WS
    + """) WHEN pp AND p0 > 300 THEN rtrim(substr(content, 1, p0), """
    + S.WS
    + """) ELSE rtrim(win, """
    + S.WS
    + """) END) AS INTEGER) AS n_chars FROM p""",
)
def truncated_bodies(c: Corpus) -> DataFrame:
    return c.notes.select(
        "path", F.length(text.truncate_at_section("content", F.lit(600))).alias("n_chars")
    )


@register(
    "section_items",
    S.with_(*SESS)
    + "SELECT path, array_to_string(list_filter(topics, lambda t: t <> ''), '|') AS topics FROM sess",
)
def section_items(c: Corpus) -> DataFrame:
    return c.notes.where(F.array_contains("tags", "type/session")).select(
        "path", F.array_join(markdown.section_items("content", "Topics"), "|").alias("topics")
    )


# --- streams ------------------------------------------------------------------------------------------------


def _stream(c: Corpus, name: str) -> DataFrame:
    schema = c.spark.read.parquet(f"{c.sf_dir}/{name}.parquet").schema
    # Written as a pattern, the path may be one file or a folder of files.
    return c.spark.readStream.schema(schema).parquet(f"{c.sf_dir}/{name}.parque[t]")


def _finish(query) -> None:
    query.awaitTermination()


@register("stream_suppress", ORACLES["suppress_repeat"])
def stream_suppress(c: Corpus) -> DataFrame:
    out = work_dir(c.spark, "suppress")
    rows = D.decision_rows(_stream(c, "events"))
    _finish(jobs.suppress(rows, f"{out}/tables", f"{out}/checkpoint"))
    log = jobs.read_batches(c.spark, f"{out}/tables", "decisions")
    return log.select("session_id", "prompt_id", "suppressed")


@register("stream_capture", ORACLES["capture_notes"])
def stream_capture(c: Corpus) -> DataFrame:
    out = work_dir(c.spark, "capture")
    rows = D.transcript_rows(_stream(c, "conversations"))
    _finish(jobs.capture_sessions(rows, f"{out}/tables", f"{out}/checkpoint"))
    none_yet = c.notes.select("path", F.lit(None).cast("string").alias("created")).where(
        F.startswith("path", F.lit("sessions/archive/"))
    )
    notes = jobs.captured_notes(c.spark, f"{out}/tables", _project_map(c), none_yet, AS_OF)
    return notes.select("session_id", "vault_id", "path", "created", "is_new")


@register(
    "stream_first_shown",
    S.with_(S.DECISIONS)
    + "SELECT DISTINCT session_id, path FROM (SELECT session_id, unnest(injected) AS path FROM decisions)",
)
def stream_first_shown(c: Corpus) -> DataFrame:
    """Each path once per session, with a delay wider than the data."""
    out = work_dir(c.spark, "first-shown")
    rows = jobs.first_shown(D.decision_rows(_stream(c, "events")), "400 days").select("session_id", "path")
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/rows")
        .trigger(availableNow=True)
        .start()
    )
    _finish(query)
    return c.spark.read.parquet(f"{out}/rows")
