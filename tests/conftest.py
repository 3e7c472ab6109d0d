import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from quillspark.session import local_session  # noqa: E402
from quillspark.sources import notes as note_source  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    yield s


@pytest.fixture(scope="session")
def vault(spark):
    """Build a note table from {path: raw text} or {path: (raw, modified_at)}."""

    def build(files, modified="2026-06-01 00:00:00"):
        rows = []
        for path, raw in files.items():
            at = modified
            if isinstance(raw, tuple):
                raw, at = raw
            rows.append((path, at, len(raw.encode()), raw))
        df = spark.createDataFrame(rows, "path string, modified_at string, size long, raw string")
        return note_source.parse_notes(df.withColumn("modified_at", F.col("modified_at").cast("timestamp")))

    return build


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression over named string columns."""

    def run(expr, **cols):
        df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
        return df.select(expr.alias("x")).first()["x"]

    return run


def note(title=None, tags=(), body="", **fm):
    """File text with frontmatter."""
    lines = []
    if title is not None:
        lines.append(f"title: {title}")
    if tags:
        lines.append("tags:")
        lines += [f"  - {t}" for t in tags]
    for k, v in fm.items():
        if isinstance(v, (list, tuple)):
            lines.append(f"{k}:")
            lines += [f"  - {x}" for x in v]
        else:
            lines.append(f"{k}: {v}")
    return "---\n" + "\n".join(lines) + "\n---\n" + body
