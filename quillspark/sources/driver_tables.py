"""Note, query and transcript tables derived from the driver's parquet tables.

The driver has no markdown, so notes are made from ``documents`` by fixed rules: every row of the
input gives one note. The same rules are written in SQL next to each function for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import first_words
from ..schema import FRONTMATTER
from ..session import few, written

AS_OF = "2024-03-25 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on inputs of fewer splits than cores, such as one small file.

    Larger inputs have splits enough and are left as they are: no shuffle of the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _note_path() -> Column:
    i = F.col("doc_id")
    stem = F.concat(F.lit("d"), i.cast("string"), F.lit(".md"))
    kind = i % 10
    return (
        F.when(i == 9, "Home.md")
        .when(kind == 0, F.concat(F.lit("sessions/2024/"), stem))
        .when(kind == 1, F.concat(F.lit("sessions/digests/"), stem))
        .when(kind == 2, F.concat(F.lit("proposals/brief-updates/"), stem))
        .when(kind == 3, F.concat(F.lit("kb/briefs/brief-"), stem))
        .when(i % 50 == 9, F.concat(F.lit("MOCs/"), stem))
        .otherwise(F.concat(F.lit("kb/"), F.col("source"), F.lit("/"), stem))
    )


def _note_type() -> Column:
    i = F.col("doc_id")
    kind = i % 10
    return (
        F.when(kind == 0, "type/session")
        .when(kind == 1, "type/digest")
        .when(kind == 2, "type/proposal")
        .when(kind == 3, "type/brief")
        .when(kind == 4, "type/reference")
        .when(i % 50 == 9, "type/moc")
        .otherwise("type/note")
    )


def _note_content() -> Column:
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    lit = F.lit
    div = lambda n: F.expr(f"doc_id div {n}")
    session_head = F.concat(
        lit("# "),
        F.col("title"),
        lit("\n\n## Topics\n\n- "),
        first_words("text", 6),
        lit("\n- "),
        first_words("text", 6, 6),
        lit("\n\n## Files Changed\n\n- src/mod"),
        s(i % 10),
        lit(".py\n\n## Notes\n\n"),
    )
    cited = F.concat(lit("\n\nSee src/app/mod"), s(i % 7), lit(".py:12 near line "), s(i % 50))
    origin = F.concat(lit("\n\nSource: [[d"), s(i - 5), lit("]]"))
    first_link = (
        F.when(i % 3 == 0, F.concat(lit("d"), s(div(3))))
        .when(i % 3 == 1, F.concat(lit("D"), s(div(2)), lit("#part")))
        .otherwise(F.concat(lit("missing-"), s(i % 7), lit("|see")))
    )
    plain_title = F.regexp_replace("title", r"[\[\]|#`]", " ")
    named_link = (
        F.when(i % 10 == 6, F.concat(lit("\n- [[B"), s(i - 3), lit("]]")))
        .when(i % 10 == 7, F.concat(lit("\n- [["), plain_title, lit("]]")))
        .otherwise("")
    )
    return F.concat(
        F.when(i % 10 == 0, session_head).otherwise(""),
        F.col("text"),
        F.when(i % 20 == 4, cited).otherwise(""),
        F.when(i % 20 == 5, origin).otherwise(""),
        F.when(i % 20 == 14, lit("\n\n```\n[[in-code]]\n```")).otherwise(""),
        lit("\n\n## Links\n\n- [["),
        first_link,
        lit("]]\n- [[d"),
        s(i + 50),
        lit("]]"),
        named_link,
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note table over all documents. Row-local: no shuffle."""
    i = F.col("doc_id")
    kind = i % 10
    s = lambda c: c.cast("string")
    lit = F.lit
    hours = F.make_interval(hours=(i * 7 % 2000).cast("int"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", "lang", first_words("text", 4).alias("title")
    )
    created = lit("2024-01-01 00:00:00").cast("timestamp") + hours
    known = {
        "title": F.col("title"),
        "created": F.when(i % 97 == 0, "not-a-date").otherwise(
            F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ),
        "last_reviewed": F.when(
            (i % 3 == 0) & kind.between(3, 8),
            F.date_format(created + F.expr("INTERVAL 10 DAYS"), "yyyy-MM-dd"),
        ),
        "updated": F.when(
            (i % 3 == 1) & kind.between(3, 8),
            F.date_format(created + F.expr("INTERVAL 5 DAYS"), "yyyy-MM-dd"),
        ),
        "status": F.when(kind == 2, F.when(i % 4 == 0, "applied").otherwise("proposed")),
        "target_brief": F.when(kind == 2, F.concat(lit("./kb/briefs/brief-d"), s(i + 1), lit(".md"))),
        "confidence": F.when(kind == 2, F.when(i % 20 == 2, "high").otherwise("low")),
        "generated_by": F.when(i % 50 == 7, "agent"),
        "source": F.when(i % 7 == 0, "import"),
        "keywords": F.when(
            kind == 3,
            F.array(F.lower(first_words("text", 1, 1)), F.lower(first_words("text", 2, 4))),
        ),
        "aliases": F.when(kind == 3, F.array(F.concat(lit("b"), s(i)))),
        "sources": F.when(
            (kind == 1) & (i % 3 != 0),
            F.array(
                F.concat(lit("sessions/2024/d"), s(i - 1), lit(".md")),
                F.concat(lit("./sessions/2024/d"), s(i - 11), lit(".md")),
            ),
        ),
        "edits": F.when(
            kind == 2,
            F.array(
                F.struct(
                    lit("Links").alias("section"),
                    lit("append").alias("action"),
                    F.concat(lit("- [[d"), s(i), lit("]]")).alias("content"),
                ),
                F.struct(
                    lit("Notes").alias("section"),
                    F.when(i % 8 == 2, "append").otherwise("replace").alias("action"),
                    F.concat(lit("note "), s(i)).alias("content"),
                ),
            ),
        ),
    }
    fm = F.struct(
        *[
            (known[f.name] if f.name in known else lit(None)).cast(f.dataType).alias(f.name)
            for f in FRONTMATTER.fields
        ]
    )
    return docs.select(
        _note_path().alias("path"),
        "title",
        F.array(
            _note_type(),
            F.concat(lit("project/"), "source"),
            F.concat(lit("topic/"), "lang"),
        ).alias("tags"),
        created.alias("created_at"),
        (created + F.make_interval(days=(i % 5).cast("int"))).alias("modified_at"),
        F.octet_length("text").cast("long").alias("size"),
        (i % 97 == 0).alias("malformed"),
        _note_content().alias("content"),
        fm.alias("fm"),
        "doc_id",
    )


NOTES_SQL = r"""
base AS (
  SELECT *, doc_id % 10 AS kind, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws,
         TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 7 % 2000 AS INTEGER)) AS created_at
  FROM documents),
titled AS (
  SELECT *, array_to_string(ws[1:4], ' ') AS title,
         array_to_string(ws[1:6], ' ') AS w6, array_to_string(ws[7:12], ' ') AS w12 FROM base),
notes AS (
  SELECT doc_id, kind, text, source, lang, ws, title, created_at,
    created_at + to_days(CAST(doc_id % 5 AS INTEGER)) AS modified_at,
    CAST(strlen(text) AS BIGINT) AS size,
    CASE WHEN doc_id = 9 THEN 'Home.md'
         WHEN kind = 0 THEN 'sessions/2024/d' || doc_id || '.md'
         WHEN kind = 1 THEN 'sessions/digests/d' || doc_id || '.md'
         WHEN kind = 2 THEN 'proposals/brief-updates/d' || doc_id || '.md'
         WHEN kind = 3 THEN 'kb/briefs/brief-d' || doc_id || '.md'
         WHEN doc_id % 50 = 9 THEN 'MOCs/d' || doc_id || '.md'
         ELSE 'kb/' || source || '/d' || doc_id || '.md' END AS path,
    CASE WHEN kind = 0 THEN 'type/session' WHEN kind = 1 THEN 'type/digest'
         WHEN kind = 2 THEN 'type/proposal' WHEN kind = 3 THEN 'type/brief'
         WHEN kind = 4 THEN 'type/reference' WHEN doc_id % 50 = 9 THEN 'type/moc'
         ELSE 'type/note' END AS type_tag,
    CASE WHEN kind = 0 THEN '# ' || title || chr(10) || chr(10) || '## Topics' || chr(10) || chr(10)
           || '- ' || w6 || chr(10) || '- ' || w12 || chr(10) || chr(10) || '## Files Changed' || chr(10) || chr(10)
           || '- src/mod' || (doc_id % 10) || '.py' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10)
         ELSE '' END
      || text
      || CASE WHEN doc_id % 20 = 4 THEN chr(10) || chr(10) || 'See src/app/mod' || (doc_id % 7) || '.py:12 near line ' || (doc_id % 50) ELSE '' END
      || CASE WHEN doc_id % 20 = 5 THEN chr(10) || chr(10) || 'Source: [[d' || (doc_id - 5) || ']]' ELSE '' END
      || CASE WHEN doc_id % 20 = 14 THEN chr(10) || chr(10) || '```' || chr(10) || '[[in-code]]' || chr(10) || '```' ELSE '' END
      || chr(10) || chr(10) || '## Links' || chr(10) || chr(10) || '- [['
      || CASE doc_id % 3 WHEN 0 THEN 'd' || (doc_id // 3) WHEN 1 THEN 'D' || (doc_id // 2) || '#part'
              ELSE 'missing-' || (doc_id % 7) || '|see' END
      || ']]' || chr(10) || '- [[d' || (doc_id + 50) || ']]'
      || CASE WHEN kind = 6 THEN chr(10) || '- [[B' || (doc_id - 3) || ']]'
              WHEN kind = 7 THEN chr(10) || '- [[' || regexp_replace(title, '[\[\]|#`]', ' ', 'g') || ']]'
              ELSE '' END AS content,
    CASE WHEN doc_id % 3 = 0 AND kind BETWEEN 3 AND 8 THEN strftime(created_at + INTERVAL 10 DAY, '%Y-%m-%d') END AS last_reviewed,
    CASE WHEN doc_id % 3 = 1 AND kind BETWEEN 3 AND 8 THEN strftime(created_at + INTERVAL 5 DAY, '%Y-%m-%d') END AS updated,
    CASE WHEN kind = 2 THEN CASE WHEN doc_id % 4 = 0 THEN 'applied' ELSE 'proposed' END END AS status,
    CASE WHEN kind = 2 THEN 'kb/briefs/brief-d' || (doc_id + 1) || '.md' END AS target_brief,
    CASE WHEN kind = 2 THEN CASE WHEN doc_id % 20 = 2 THEN 'high' ELSE 'low' END END AS confidence
  FROM titled)
"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, topic): every passage whole, and its words of seven letters or more."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.array_join(words, " ").alias("query"),
        F.array_join(F.filter(words, lambda w: F.length(w) >= 7), " ").alias("topic"),
    )


QUERIES_SQL = r"""
queries AS (
  SELECT item_id AS query_id, text AS passage,
    array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS query,
    array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) >= 7), ' ') AS topic
  FROM benchmark)
"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, path): notes whose document holds the passage word for word.

    A document that holds a passage holds its inner words, so each passage looks for its longest
    inner word; the containment is checked on those candidates only.
    """
    docs = table(spark, sf_dir, "documents").withColumn("path", _note_path())
    inner = F.slice(F.split("text", r"\s+"), F.lit(2), F.greatest(F.lit(1), F.size(F.split("text", r"\s+")) - 2))
    keyed = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("case_id"),
        F.col("text").alias("passage"),
        F.element_at(
            F.array_sort(F.transform(inner, lambda w: F.struct(-F.length(w), w.alias("w")))), 1
        )["w"].alias("word"),
    )
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    # Passages, and documents that hold their word, are counted: while they are few, no text is shuffled to meet them.
    pairs = written(words.join(few(keyed), "word").select("doc_id", "case_id", "passage"), "candidates")
    return (
        docs.select("doc_id", "path", "text")
        .join(few(pairs), "doc_id")
        .where(F.contains("text", F.col("passage")))
        .select("case_id", "path")
    )


GOLD_SQL = """
gold AS (
  SELECT q.query_id AS case_id, n.path FROM queries q JOIN notes n ON contains(n.text, q.passage))
"""


def cases(spark: SparkSession, sf_dir: str, gold_pairs: DataFrame) -> DataFrame:
    """(case_id, query, topic, stratum, negative, expected_brief)."""
    best = gold_pairs.groupBy("case_id").agg(F.min("path").alias("expected_brief"))
    q = queries(spark, sf_dir).withColumnRenamed("query_id", "case_id")
    return q.join(best, "case_id", "left").select(
        "case_id",
        "query",
        "topic",
        F.element_at(
            F.array(F.lit("nl"), F.lit("terse"), F.lit("name")), (F.col("case_id") % 3 + 1).cast("int")
        ).alias("stratum"),
        F.col("expected_brief").isNull().alias("negative"),
        "expected_brief",
    )


CASES_SQL = """
cases AS (
  SELECT q.query_id AS case_id, q.query, q.topic, ['nl','terse','name'][CAST(q.query_id % 3 + 1 AS INTEGER)] AS stratum,
         g.expected_brief IS NULL AS negative, g.expected_brief
  FROM queries q LEFT JOIN (SELECT case_id, min(path) AS expected_brief FROM gold GROUP BY 1) g ON g.case_id = q.query_id)
"""


def file_map(case_rows: DataFrame) -> DataFrame:
    """Explicit keyword map: the topic of every second case, and the whole question of every eighth."""
    rows = case_rows.where(~F.col("negative")).select(
        F.explode(
            F.concat(
                F.when(F.col("case_id") % 2 == 0, F.array("topic")).otherwise(F.array().cast("array<string>")),
                F.when(F.col("case_id") % 8 == 0, F.array("query")).otherwise(F.array().cast("array<string>")),
            )
        ).alias("keyword"),
        F.col("expected_brief").alias("path"),
    )
    return rows.select(F.lower("keyword").alias("keyword"), "path")


MAP_SQL = r"""
file_map AS (
  SELECT keyword, max(path) AS path FROM (
    SELECT lower(topic) AS keyword, expected_brief AS path FROM cases WHERE NOT negative AND case_id % 2 = 0
    UNION ALL
    SELECT lower(query), expected_brief FROM cases WHERE NOT negative AND case_id % 8 = 0)
  GROUP BY 1),
declared AS (
  SELECT keyword, min(path) AS path FROM (
    SELECT trim(unnest([lower(ws[2]), lower(array_to_string(ws[5:6], ' ')), 'b' || doc_id])) AS keyword, path
    FROM notes WHERE type_tag = 'type/brief')
  WHERE keyword <> '' GROUP BY 1),
brief_map AS (
  SELECT keyword, coalesce(f.path, d.path) AS path, CASE WHEN f.path IS NOT NULL THEN 'file' ELSE 'note' END AS src
  FROM declared d FULL JOIN file_map f USING (keyword))
"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_rows(table(spark, sf_dir, "conversations"))


def transcript_rows(conv: DataFrame) -> DataFrame:
    """(session_id, cwd, pos, line): conversations as JSON lines, with tool calls on assistant turns.

    Row-local, so it works on a stream as well.
    """
    said = F.when(F.col("role") == "assistant", F.lit(None)).otherwise(F.col("text"))
    block = F.struct(
        F.lit("text").alias("type"),
        F.col("text").alias("text"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("struct<file_path:string,command:string>").alias("input"),
    )

    def call(name: str, **given: Column) -> Column:
        fields = [
            given.get(k, F.lit(None)).cast("string").alias(k) for k in ("file_path", "command")
        ]
        return F.struct(
            F.lit("tool_use").alias("type"),
            F.lit(None).cast("string").alias("text"),
            F.lit(name).alias("name"),
            F.struct(*fields).alias("input"),
        )

    turn = F.col("turn").cast("string")
    edit = call("Edit", file_path=F.concat(F.lit("src/mod"), (F.col("turn") % 3).cast("string"), F.lit(".py")))
    bash = call("Bash", command=F.concat(F.lit("make step"), turn))
    look = call("Bash", command=F.concat(F.lit("ls dir"), turn))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    blocks = F.when(
        F.col("role") == "assistant",
        F.when(kind == 0, F.array(block, edit, bash)).when(kind == 1, F.array(block, look)).otherwise(F.array(block)),
    )
    ts = F.date_format(
        F.lit("2024-02-01 00:00:00").cast("timestamp")
        + F.make_interval(hours=(F.col("conv_id") % 2000).cast("int"), mins=F.col("turn").cast("int")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    message = F.when(
        F.col("role") == "assistant", F.to_json(F.struct(F.struct(blocks.alias("content")).alias("message")))
    ).otherwise(F.to_json(F.struct(F.struct(said.alias("content")).alias("message"))))
    head = F.to_json(F.struct(F.col("role").alias("type"), ts.alias("timestamp")))
    line = F.concat(F.regexp_replace(head, r"\}\z", ","), F.regexp_replace(message, r"\A\{", ""))
    return conv.select(
        F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 8, "0")).alias("session_id"),
        F.concat(F.lit("/work/team"), (F.col("conv_id") % 5).cast("string"), F.lit("/app/worktree")).alias("cwd"),
        F.col("turn").cast("int").alias("pos"),
        line.alias("line"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_rows(table(spark, sf_dir, "events"))


def decision_rows(e: DataFrame) -> DataFrame:
    """(session_id, prompt_id, ts, method, injected): events as recall decisions. Row-local."""
    return e.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("prompt_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", "direct_map").otherwise("tag_search").alias("method"),
        F.when(F.col("event_type") == "error", F.array().cast("array<string>"))
        .when(
            F.col("event_type") == "purchase",
            F.array("event_type", F.get_json_object("props", "$.k")),
        )
        .otherwise(F.array(F.concat("event_type", (F.floor("value") % 7).cast("string"))))
        .alias("injected"),
    )


DECISIONS_SQL = r"""
decisions AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS prompt_id, ts,
    CASE WHEN event_type = 'signup' THEN 'direct_map' ELSE 'tag_search' END AS method,
    CASE WHEN event_type = 'error' THEN CAST([] AS VARCHAR[])
         WHEN event_type = 'purchase' THEN [event_type, json_extract_string(props, '$.k')]
         ELSE [event_type || CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR)] END AS injected
  FROM events)
"""
