"""Inverted index, term expansion and ranked keyword search.

Scoring is BM25+ per field with field boosts. A term counts once per field for the field
length, and the sum over terms is multiplied by the number of query words that matched.
``KeywordParams.textbook()`` gives the plain BM25 of the literature instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import clock, days_before

FIELD_BOOSTS = {"title": 3.0, "tags": 2.0, "content": 1.0}

# Document boosts by age and note type.
FRESH_BOOST, WEEK_BOOST, OLD_BOOST = 1.5, 1.3, 0.7
SESSION_BOOST, DIGEST_BOOST = 0.3, 1.5

SCORE_DIGITS = 6

BROADCAST_WORDS = 100_000  # asked words that are broadcast to the dictionary
PART_BYTES = 1 << 22  # text that is counted in one task, see ``parts_of``


@dataclass(frozen=True)
class KeywordParams:
    k1: float = 1.2
    b: float = 0.7
    delta: float = 0.5
    coverage: bool = True  # multiply by the number of matched query words
    prefix_weight: float = 0.375
    fuzzy_weight: float = 0.45
    fuzzy_share: float = 0.2
    max_edits: int = 6
    boosts: dict = field(default_factory=lambda: dict(FIELD_BOOSTS))
    salts: int = 8
    hot_share: float = 0.05  # words of more notes than this share are salted

    @staticmethod
    def textbook(**changes) -> "KeywordParams":
        return KeywordParams(**{"b": 0.75, "delta": 0.0, "coverage": False, **changes})


DEFAULT = KeywordParams()


@dataclass(frozen=True)
class KeywordIndex:
    """``postings``: one row per (note, term) with its count per field, the field lengths and the
    note facts scoring needs.
    ``dictionary``: one row per term with the number of notes per field.
    ``field_stats``: one row per field: notes in the corpus, mean field length.
    ``docs``: path and tags, for filters on tags."""

    postings: DataFrame
    dictionary: DataFrame
    field_stats: DataFrame
    docs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "postings": self.postings,
            "dictionary": self.dictionary,
            "field_stats": self.field_stats,
            "docs": self.docs,
        }


# --- building ---------------------------------------------------------------------------

# Note facts in one number, so that aggregates keep fixed-width buffers.
IS_SESSION, IS_DIGEST, IS_ROUTABLE = 1, 2, 4


def _flags() -> Column:
    bit = lambda value, *tags: F.when(text.has_tag("tags", *tags), value).otherwise(0)
    return (
        bit(IS_SESSION, text.SESSION_TAG)
        + bit(IS_DIGEST, text.DIGEST_TAG)
        + bit(IS_ROUTABLE, *text.ROUTABLE_TAGS)
    )


def _fields(notes: DataFrame) -> DataFrame:
    """One row per note and field with the tokens of the field and all field lengths. Row-local."""
    tokens = notes.select(
        "path",
        "created_at",
        _flags().alias("flags"),
        text.index_tokens("title").alias("t_title"),
        text.index_tokens(F.array_join("tags", " ")).alias("t_tags"),
        text.index_tokens("content").alias("t_content"),
    )
    # Lengths are columns of their own before the explode, or they are computed once per token.
    sized = tokens.withColumns(
        {f"len_{f}": F.size(F.array_distinct(f"t_{f}")) for f in FIELD_BOOSTS}
    )
    fields = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").alias("tokens")) for f in FIELD_BOOSTS]
    )
    return sized.withColumn("f", F.explode(fields)).select(
        "path", "created_at", "flags", *[f"len_{f}" for f in FIELD_BOOSTS], "f.field", "f.tokens"
    )


def parts_of(notes: DataFrame) -> int:
    """Parts of some 4 MB of text: a power of two, so that two states of the same notes mostly get as many."""
    size = notes.agg(F.sum(F.octet_length("content")).alias("n")).first()["n"] or 0
    return 1 << (size // PART_BYTES).bit_length()


def by_path(notes: DataFrame, parts: int) -> DataFrame:
    """Notes shuffled once by path, as text, which is a fraction of their postings. Counts by note and word and joins
    by path then shuffle no postings. A part is small, as its postings are counted in one task's memory."""
    return notes.select("path", "title", "tags", "content", "created_at").repartition(parts, "path")


def _token_rows(notes: DataFrame) -> DataFrame:
    return _fields(notes).withColumn("term", F.explode("tokens")).drop("tokens")


def _count_postings(token_rows: DataFrame) -> DataFrame:
    # Counted map-side first, so what is shuffled is one row per distinct (note, term). All
    # buffers are numbers or timestamps, which keeps this a hash aggregate.
    return token_rows.groupBy("path", "term").agg(
        *[F.count_if(F.col("field") == f).alias(f"tf_{f}") for f in FIELD_BOOSTS],
        *[F.max(f"len_{f}").alias(f"len_{f}") for f in FIELD_BOOSTS],
        F.max("created_at").alias("created_at"),
        F.max("flags").alias("flags"),
    )


def field_stats(notes: DataFrame) -> DataFrame:
    """(field, n_notes, avg_len): three rows, from partial sums."""
    length = F.lit(0)
    for f in FIELD_BOOSTS:
        length = F.when(F.col("field") == f, F.col(f"len_{f}")).otherwise(length)
    return (
        _fields(notes)
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("n_notes"), F.avg(length).alias("avg_len"))
    )


def dictionary(notes: DataFrame, only_terms: DataFrame | None = None) -> DataFrame:
    """(term, df_title, df_tags, df_content). Words are made unique inside each note, so this is
    one count per term that combines before the shuffle; postings are not needed."""
    rows = _fields(notes).select("field", F.explode(F.array_distinct("tokens")).alias("term"))
    if only_terms is not None:
        rows = rows.join(only_terms, "term", "left_semi")
    return rows.groupBy("term").agg(
        *[F.count_if(F.col("field") == f).alias(f"df_{f}") for f in FIELD_BOOSTS]
    )


def build_index(notes: DataFrame, only_terms: DataFrame | None = None, parts: int | None = None) -> KeywordIndex:
    """Build the inverted index. ``only_terms`` (term) restricts it to a query vocabulary:
    tokens outside it are dropped before anything is shuffled. With ``parts`` notes are shuffled in place of postings."""
    rows = _token_rows(by_path(notes, parts) if parts else notes)
    if only_terms is not None:
        rows = rows.join(only_terms, "term", "left_semi")
    return KeywordIndex(
        _count_postings(rows),
        dictionary(notes, only_terms),
        field_stats(notes),
        notes.select("path", "tags"),
    )


def update_index(
    index: KeywordIndex, changed: DataFrame, removed_paths: DataFrame, all_notes: DataFrame
) -> KeywordIndex:
    """Replace the postings of changed notes and drop those of removed ones.

    Term counts move by the difference: old postings of touched notes are taken off, new ones added.
    """
    # A part of the paths is hashed in each task, so that postings are not sorted to meet them.
    parts = parts_of(changed)
    gone = changed.select("path").unionByName(removed_paths.select("path")).repartition(parts, "path").distinct().hint("shuffle_hash")
    old = index.postings.join(gone, "path", "left_semi")
    kept = index.postings.join(gone, "path", "left_anti")
    fresh = _count_postings(_token_rows(by_path(changed, parts)))

    def counts(postings: DataFrame, sign: int) -> DataFrame:
        return postings.groupBy("term").agg(
            *[(F.count_if(F.col(f"tf_{f}") > 0) * sign).alias(f"df_{f}") for f in FIELD_BOOSTS]
        )

    moved = index.dictionary.unionByName(counts(old, -1)).unionByName(counts(fresh, 1))
    total = moved.groupBy("term").agg(*[F.sum(f"df_{f}").alias(f"df_{f}") for f in FIELD_BOOSTS])
    alive = sum((F.col(f"df_{f}") for f in FIELD_BOOSTS), F.lit(0)) > 0
    return KeywordIndex(
        kept.unionByName(fresh),
        total.where(alive),
        field_stats(all_notes),
        all_notes.select("path", "tags"),
    )


def snapshot_diff(known: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, change): added, changed (time or size differs), removed, unchanged."""
    k = known.select("path", F.col("modified_at").alias("k_at"), F.col("size").alias("k_size"))
    d = on_disk.select("path", F.col("modified_at").alias("d_at"), F.col("size").alias("d_size"))
    return k.join(d, "path", "full").select(
        "path",
        F.when(F.col("k_size").isNull(), "added")
        .when(F.col("d_size").isNull(), "removed")
        .when((F.col("k_at") != F.col("d_at")) | (F.col("k_size") != F.col("d_size")), "changed")
        .otherwise("unchanged")
        .alias("change"),
    )


# --- query terms ---------------------------------------------------------------------------


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """(query_id, source_term, n): the words of each query and how often each occurs."""
    return (
        queries.select("query_id", F.explode(text.index_tokens(query)).alias("source_term"))
        .groupBy("query_id", "source_term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_terms(terms: DataFrame) -> DataFrame:
    return terms.select(
        "query_id", "source_term", F.col("source_term").alias("term"), F.col("n").cast("double").alias("weight")
    )


def _by_size(words: DataFrame) -> DataFrame:
    """Asked words as the side that is broadcast, if they are counted to be few; else both sides are sorted. Without this Spark
    may broadcast the prefixes of the whole dictionary, which it takes to be as small as the dictionary's file."""
    few = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return words.hint("broadcast" if few else "merge")


def prefix_matches(source_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """(source_term, term) for dictionary terms that extend a query word.

    Every dictionary term is exploded into its proper prefixes, so this is an equi-join. The prefixes are not
    shuffled while the query words are few.
    """
    prefixes = terms.where(F.length("term") > 1).select(
        "term",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("term") - 1), lambda n: F.substr("term", F.lit(1), n)
            )
        ).alias("source_term"),
    )
    return prefixes.join(_by_size(source_terms.select("source_term").distinct()), "source_term").select(
        "source_term", "term"
    )


def _edit_limit(c: Column, p: KeywordParams) -> Column:
    return F.least(
        F.lit(p.max_edits), F.floor(F.length(c) * p.fuzzy_share + 0.5).cast("int")
    )


def _letters(c: Column) -> Column:
    """How often each of a to z occurs, up to twice, in unary: an edit changes two of the 52 bits at most."""
    count = lambda letter: F.length(c) - F.length(F.replace(c, F.lit(letter)))
    bits = F.lit(0).cast("long")
    for i in range(26):
        n = count(chr(ord("a") + i))
        bits = bits.bitwiseOR(F.when(n >= 2, 3 << 2 * i).when(n == 1, 1 << 2 * i).otherwise(0).cast("long"))
    return bits


def _segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    base = F.floor(length / (k + 1)).cast("int")
    longer = length % (k + 1)  # the last ``longer`` segments get one character more
    first_long = k + 1 - longer
    start = i * base + F.greatest(F.lit(0), i - first_long) + 1
    size = base + F.when(i >= first_long, 1).otherwise(0)
    return start, size

def _segments(rows: DataFrame) -> DataFrame:
    """One row per segment, with its start and size in a term of ``tlen`` characters."""
    cut = rows.withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("k"))))
    start, size = _segment(F.col("tlen"), F.col("k"), F.col("seg"))
    return cut.withColumns({"start": start, "size": size})


#: What query words and dictionary words meet by.
SPELLING_KEY = ("k", "tlen", "seg", "part")


def spelling_parts(terms: DataFrame, p: KeywordParams = DEFAULT) -> DataFrame:
    """(k, tlen, seg, part, term, t_letters): the segments of dictionary words, see ``fuzzy_matches``. Can be stored."""
    # Limits of the query lengths that a term of length L can answer: those that cover the difference.
    tlen = F.length("term")
    lengths = F.sequence(F.greatest(F.lit(1), tlen - p.max_edits), tlen + p.max_edits)
    limit = lambda n: F.least(F.lit(p.max_edits), F.floor(n * p.fuzzy_share + 0.5).cast("int"))
    reach = F.transform(F.filter(lengths, lambda n: F.abs(tlen - n) <= limit(n)), limit)
    return _segments(
        terms.select("term", tlen.alias("tlen"), _letters(F.col("term")).alias("t_letters"), F.explode(F.array_distinct(F.filter(reach, lambda k: k > 0))).alias("k"))
    ).select("term", "tlen", "t_letters", "k", "seg", F.substr("term", F.col("start"), F.col("size")).alias("part"))


def fuzzy_matches(
    source_terms: DataFrame, terms: DataFrame, p: KeywordParams = DEFAULT, parts: DataFrame | None = None
) -> DataFrame:
    """(source_term, term, distance) within the edit limit of the query word.

    A word is cut into k+1 segments; within k edits at least one of them survives unchanged, moved
    by at most k places (the pigeonhole filter of partition-based similarity joins). Dictionary
    terms, of which there are many, emit only their few segments, once for each limit k that query
    words near their length can have. Query words emit the substrings that could equal one, keyed
    by (limit, term length, segment number, text): an exact equi-join before the distance is computed.
    """

    same = (p.fuzzy_share, p.max_edits) == (DEFAULT.fuzzy_share, DEFAULT.max_edits)
    held = parts if parts is not None and same else spelling_parts(terms, p)
    n = F.length("source_term")
    src = source_terms.select("source_term").distinct()
    src = src.withColumns({"k": _edit_limit(F.col("source_term"), p), "s_letters": _letters(F.col("source_term"))})
    src = src.where(F.col("k") > 0).withColumn("tlen", F.explode(F.sequence(F.greatest(F.lit(1), n - F.col("k")), n + F.col("k"))))
    # Some segment survives with at most as many edits before it as there are segments before it, and
    # likewise after it: it has moved no farther than these allow.
    i, more = F.col("seg"), n - F.col("tlen")
    left, right = F.greatest(-i, more - F.col("k") + i), F.least(i, more + F.col("k") - i)
    places = F.transform(F.when(left <= right, F.sequence(left, right)), lambda d: F.col("start") + d)
    places = F.filter(places, lambda at: at >= 1)
    looked = _segments(src).select(
        "source_term",
        "s_letters",
        "tlen",
        "k",
        "seg",
        "size",
        F.explode(F.array_distinct(F.transform(places, lambda at: F.substr("source_term", at, F.col("size"))))).alias("part"),
    ).where(F.length("part") == F.col("size")).drop("size")

    apart = F.bit_count(F.col("s_letters").bitwiseXOR(F.col("t_letters")))
    return (
        looked.join(held, list(SPELLING_KEY))
        .where((F.col("source_term") != F.col("term")) & (apart <= 2 * F.col("k")))
        .select("source_term", "term", "k")
        .distinct()
        .select("source_term", "term", F.levenshtein("source_term", "term", p.max_edits).alias("distance"), "k")
        .where((F.col("distance") >= 0) & (F.col("distance") <= F.col("k")))
        .select("source_term", "term", "distance")
    )


def expand_terms(
    terms: DataFrame, vocabulary: DataFrame, p: KeywordParams = DEFAULT
) -> DataFrame:
    """(query_id, source_term, term, weight): the word itself, its extensions, near spellings."""
    best = expand_words(terms.select("source_term").distinct(), vocabulary, p)
    return terms.join(best, "source_term").select(
        "query_id", "source_term", "term", (F.col("w") * F.col("n")).alias("weight")
    )


def expand_words(
    src: DataFrame, vocabulary: DataFrame, p: KeywordParams = DEFAULT, parts: DataFrame | None = None
) -> DataFrame:
    """(source_term, term, w) for each word of ``src``. A term reached both ways counts as an extension."""
    n = F.length("source_term")
    exact = src.select(
        "source_term", F.col("source_term").alias("term"), F.lit(1.0).alias("w"), F.lit(0).alias("o")
    )
    prefix = prefix_matches(src, vocabulary).select(
        "source_term",
        "term",
        (
            F.lit(p.prefix_weight)
            * F.length("term")
            / (F.length("term") + 0.3 * (F.length("term") - n))
        ).alias("w"),
        F.lit(1).alias("o"),
    )
    fuzzy = fuzzy_matches(src, vocabulary, p, parts).select(
        "source_term",
        "term",
        (
            F.lit(p.fuzzy_weight) * F.length("term") / (F.length("term") + F.col("distance"))
        ).alias("w"),
        F.lit(2).alias("o"),
    )
    return (
        exact.unionByName(prefix)
        .unionByName(fuzzy)
        .groupBy("source_term", "term")
        .agg(F.min_by("w", "o").alias("w"))
    )


# --- scoring -----------------------------------------------------------------------------


def document_boost(
    created_at: Column, flags: Column, as_of: Column, session_asked: Column
) -> Column:
    age = (
        F.when(created_at >= as_of, FRESH_BOOST)
        .when(created_at >= days_before(as_of, 7), WEEK_BOOST)
        .when(created_at < days_before(as_of, 30), OLD_BOOST)
        .otherwise(1.0)
    )
    demoted = (flags.bitwiseAND(IS_SESSION) != 0) & ~session_asked
    session = F.when(demoted, SESSION_BOOST).otherwise(1.0)
    digest = F.when(flags.bitwiseAND(IS_DIGEST) != 0, DIGEST_BOOST).otherwise(1.0)
    return age * session * digest


def _lookup(stats: DataFrame) -> Column:
    """The field table, three rows, as one scalar map: field to (n_notes, avg_len)."""
    entry = F.struct("field", F.struct("n_notes", "avg_len").alias("v"))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def score_notes(
    index: KeywordIndex, expanded: DataFrame, p: KeywordParams = DEFAULT, exact: bool = False
) -> DataFrame:
    """(query_id, path, raw_score, created_at, flags): every note that matches a term.

    With ``exact`` terms a query word meets a note in one posting at most, so one aggregate both
    sums the parts and counts the words. Otherwise the parts of a word are summed first.
    """
    stats = _lookup(index.field_stats)
    # A word of many notes is spread over ``salts`` join keys on both sides. Each note has few
    # distinct words, so words that occur in a share s of the notes number at most the mean note
    # length / s: a list short enough to broadcast, whatever the size of the corpus.
    in_notes = F.greatest(*[F.col(f"df_{f}") for f in FIELD_BOOSTS])
    is_hot = in_notes > p.hot_share * F.element_at(stats, "content")["n_notes"]
    spread = F.sequence(F.lit(0), F.lit(p.salts - 1))
    q = (
        expanded.join(index.dictionary, "term")
        .withColumn("salts", F.when(is_hot, spread).otherwise(F.array(F.lit(0))))
        .withColumn("salt", F.explode("salts"))
    )
    hot = index.dictionary.where(is_hot).select("term", F.lit(True).alias("hot"))
    slot = F.pmod(F.xxhash64("path"), F.lit(p.salts)).cast("int")
    posts = index.postings.join(F.broadcast(hot), "term", "left").withColumn(
        "salt", F.when(F.col("hot"), slot).otherwise(0)
    )
    part = F.lit(0.0)
    for f, boost in p.boosts.items():
        n_notes = F.element_at(stats, f)["n_notes"].cast("double")
        avg_len = F.element_at(stats, f)["avg_len"]
        df, tf = F.col(f"df_{f}"), F.col(f"tf_{f}").cast("double")
        idf = F.log(1 + (n_notes - df + 0.5) / (df + 0.5))
        norm = p.k1 * (1 - p.b + p.b * F.col(f"len_{f}") / avg_len)
        hit = float(boost) * idf * (p.delta + tf * (p.k1 + 1) / (tf + norm))
        part = part + F.when(F.col(f"tf_{f}") > 0, hit).otherwise(0.0)
    matched = posts.join(q, ["term", "salt"]).select(
        "query_id",
        "path",
        "source_term",
        "created_at",
        "flags",
        (F.col("weight") * part).alias("part"),
    )
    facts = [F.max(c).alias(c) for c in ("created_at", "flags")]
    if not exact:
        matched = matched.groupBy("query_id", "path", "source_term").agg(
            F.sum("part").alias("part"), *facts
        )
    score = F.sum("part")
    if p.coverage:
        score = score * F.count(F.lit(1))
    return matched.groupBy("query_id", "path").agg(score.alias("raw_score"), *facts)


def top_k(scored: DataFrame, k: int | Column, by: str = "score") -> DataFrame:
    """Best ``k`` per query. Spark keeps k rows per query and task before it shuffles."""
    w = Window.partitionBy("query_id").orderBy(F.col(by).desc(), "path")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(
    index: KeywordIndex,
    queries: DataFrame,
    as_of: str,
    limit: int = 10,
    expand: bool = True,
    params: KeywordParams = DEFAULT,
    tags: tuple[str, ...] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """(query_id, path, score, rank): ranked notes for many queries at once.

    ``queries``: query_id, query, and optionally ``tags`` (any-of) and ``folder`` per row. Filters
    act on the matches; document frequencies stay those of the whole corpus. A stored index (see
    ``blockmax``) is searched where it lies.
    """
    if not isinstance(index, KeywordIndex):
        return index.search(queries, as_of, limit, expand, params, tags, folder)
    terms = query_terms(queries)
    if expand:
        expanded = expand_terms(terms, index.dictionary.select("term"), params)
    else:
        expanded = exact_terms(terms)

    # Filters that hold for all queries prune postings before anything is scored.
    posts = index.postings
    asked = F.lit(bool(tags) and text.SESSION_TAG in tags)
    if tags and set(tags) == set(text.ROUTABLE_TAGS):
        posts = posts.where(F.col("flags").bitwiseAND(IS_ROUTABLE) != 0)
    elif tags:
        wanted = F.array(*[F.lit(t.lower()) for t in tags])
        tagged = index.docs.where(F.arrays_overlap(F.transform("tags", F.lower), wanted))
        posts = posts.join(tagged.select("path"), "path", "left_semi")
    if folder:
        base = folder.rstrip("/")
        posts = posts.where((F.col("path") == base) | F.startswith("path", F.lit(base + "/")))
    scored = score_notes(replace(index, postings=posts), expanded, params, exact=not expand)

    per_row = [c for c in ("tags", "folder") if c in queries.columns]
    if per_row:
        opts = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in per_row])
        scored = scored.join(opts, "query_id")
        if "tags" in per_row:
            scored = scored.join(index.docs, "path")
            lowered = F.transform("q_tags", F.lower)
            scored = scored.where(
                F.col("q_tags").isNull()
                | (F.size("q_tags") == 0)
                | F.arrays_overlap(F.transform("tags", F.lower), lowered)
            )
            asked = asked | F.coalesce(F.array_contains(lowered, text.SESSION_TAG), F.lit(False))
        if "folder" in per_row:
            base = F.rtrim(F.col("q_folder"), F.lit("/"))
            scored = scored.where(
                F.col("q_folder").isNull()
                | (F.col("path") == base)
                | F.startswith(F.col("path"), F.concat(base, F.lit("/")))
            )
    boosted = scored.select(
        "query_id",
        "path",
        F.round(
            F.col("raw_score")
            * document_boost(F.col("created_at"), F.col("flags"), clock(as_of), asked),
            SCORE_DIGITS,
        ).alias("score"),
    )
    return top_k(boosted, limit)


def with_snippets(hits: DataFrame, notes: DataFrame, queries: DataFrame) -> DataFrame:
    """Titles, tags and snippets for the survivors only: bodies are joined after the cut."""
    return (
        hits.join(notes.select("path", "title", "tags", "content"), "path")
        .join(queries.select("query_id", "query"), "query_id")
        .select(
            *hits.columns,
            "title",
            "tags",
            text.snippet("content", "tags", "query").alias("snippet"),
        )
    )
