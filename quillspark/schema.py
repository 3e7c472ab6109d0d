"""Table shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

FORMAT_VERSION = 1

EDIT = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

# Known frontmatter keys. Lists accept a YAML list or comma-separated text.
SCALAR_KEYS = (
    "title created updated last_reviewed reviewed date status target_brief confidence "
    "generated_by source provenance project session_id cwd applied kind period"
).split()
LIST_KEYS = "tags keywords aliases sources sessions".split()

FRONTMATTER = T.StructType(
    [T.StructField(k, T.StringType()) for k in SCALAR_KEYS]
    + [T.StructField(k, T.ArrayType(T.StringType())) for k in LIST_KEYS]
    + [T.StructField("edits", T.ArrayType(EDIT))]
)

NOTES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("size", T.LongType()),
        T.StructField("malformed", T.BooleanType()),
        T.StructField("content", T.StringType()),
        T.StructField("fm", FRONTMATTER),
    ]
)

EVENT_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)
