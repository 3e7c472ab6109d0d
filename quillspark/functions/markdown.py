"""Markdown structure as column expressions: frontmatter, fences, sections, links, edits."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EDIT
from .base import ColumnOrName, col, let, strip
from .text import slug

FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(?:(.*?)\r?\n)??---[ \t]*(?:\r?\n|\z)(.*)\z"
EDITS_TYPE = "array<struct<section:string,action:string,content:string>>"


# --- frontmatter ------------------------------------------------------------------


def has_frontmatter(raw: ColumnOrName) -> Column:
    return F.rlike(col(raw), F.lit(FRONTMATTER))


def frontmatter_block(raw: ColumnOrName) -> Column:
    return F.regexp_extract(col(raw), FRONTMATTER, 1)


def note_body(raw: ColumnOrName) -> Column:
    return F.when(has_frontmatter(raw), F.regexp_extract(col(raw), FRONTMATTER, 2)).otherwise(
        col(raw)
    )


def _unquote(c: Column) -> Column:
    single = F.regexp_replace(F.regexp_extract(c, r"\A'(.*)'\z", 1), "''", "'")
    double = F.regexp_replace(F.regexp_extract(c, r'\A"(.*)"\z', 1), r'\\"', '"')
    return (
        F.when(F.rlike(c, F.lit(r"\A'.*'\z")), single)
        .when(F.rlike(c, F.lit(r'\A".*"\z')), double)
        .otherwise(F.regexp_replace(c, r"\s+#.*\z", ""))
    )


def yaml_scalar(block: ColumnOrName, key: str) -> Column:
    """Top-level scalar of a YAML block; null when absent, empty, or a list."""
    raw = F.regexp_extract(col(block), rf"(?m)^{key}:[ \t]*(.*?)[ \t\r]*$", 1)
    value = _unquote(raw)
    return F.when(F.rlike(raw, F.lit(r"\A(?:\[.*|~|null)?\z")), F.lit(None)).otherwise(value)


def yaml_list(block: ColumnOrName, key: str) -> Column:
    """Top-level list (``- item`` lines, ``[a, b]``) or comma-separated scalar; null when absent."""
    b = col(block)
    inline = F.regexp_extract(b, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t\r]*$", 1)
    dashed = F.regexp_extract(b, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|\z))+)", 1)
    comma = yaml_scalar(b, key)
    parts = (
        F.when(inline != "", F.split(inline, ","))
        .when(dashed != "", F.regexp_extract_all(dashed, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t\r]*$"), F.lit(1)))
        .when(comma.isNotNull(), F.split(comma, ","))
    )
    return F.filter(F.transform(parts, lambda p: _unquote(strip(p))), lambda p: p != "")


@F.pandas_udf(T.ArrayType(EDIT))
def _nested_edits(blocks: pd.Series) -> pd.Series:
    def one(block: str | None):
        if not block:
            return None
        try:
            items = (yaml.safe_load(block) or {}).get("edits")
        except (yaml.YAMLError, AttributeError):
            return None
        if not isinstance(items, list):
            return None
        text = lambda v: v if isinstance(v, str) else None
        return [
            {k: text(e.get(k)) for k in ("section", "action", "content")}
            for e in items
            if isinstance(e, dict)
        ]

    return blocks.map(one)


def yaml_edits(block: ColumnOrName) -> Column:
    """The one nested field. Rows without it reach the Arrow stage as nulls."""
    b = col(block)
    return _nested_edits(F.when(F.rlike(b, F.lit(r"(?m)^edits:")), b))


def valid_edits(edits: ColumnOrName) -> Column:
    return F.filter(
        F.coalesce(col(edits), F.array().cast(EDITS_TYPE)),
        lambda e: e["section"].isNotNull()
        & e["content"].isNotNull()
        & F.coalesce(e["action"].isin("replace", "append"), F.lit(False)),
    )


# --- titles and tags ----------------------------------------------------------------


def note_title(fm_title: ColumnOrName, body: ColumnOrName, path: ColumnOrName) -> Column:
    """Frontmatter title, else first H1, else file name."""
    h1 = strip(F.regexp_extract(col(body), r"(?m)^#\s+(.+)$", 1))
    return F.coalesce(F.nullif(strip(fm_title), F.lit("")), F.nullif(h1, F.lit("")), slug(path))


def note_tags(fm_tags: ColumnOrName, body: ColumnOrName) -> Column:
    """Frontmatter tags and inline ``#tags``: lower-case, unique, sorted."""
    inline = F.regexp_extract_all(col(body), F.lit(r"(?:^|\s)#([a-zA-Z][\w/-]*)"), F.lit(1))
    declared = F.coalesce(col(fm_tags), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.transform(F.concat(declared, inline), F.lower)))


# --- fences -------------------------------------------------------------------------

_SPAN = "array<struct<a:int,b:int>>"


def _fence_spans(lines: Column) -> Column:
    """Line ranges inside fences: a fold over the fence lines only, which are few."""
    fences = F.filter(
        F.transform(
            lines,
            lambda ln, i: F.struct(
                i.alias("i"), F.regexp_extract(ln, r"^\s{0,3}(`{3,}|~{3,})", 1).alias("f")
            ),
        ),
        lambda x: x["f"] != "",
    )
    start = F.struct(
        F.lit(-1).alias("open"), F.lit("").alias("fence"), F.array().cast(_SPAN).alias("spans")
    )

    def step(acc: Column, x: Column) -> Column:
        closes = (
            (acc["open"] >= 0)
            & (F.substring(x["f"], 1, 1) == F.substring(acc["fence"], 1, 1))
            & (F.length(x["f"]) >= F.length(acc["fence"]))
        )
        opens = acc["open"] < 0
        return F.struct(
            F.when(opens, x["i"]).when(closes, F.lit(-1)).otherwise(acc["open"]).alias("open"),
            F.when(opens, x["f"]).when(closes, F.lit("")).otherwise(acc["fence"]).alias("fence"),
            F.when(
                closes,
                F.array_append(
                    acc["spans"], F.struct(acc["open"].alias("a"), x["i"].alias("b"))
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            acc["open"] >= 0,
            F.array_append(
                acc["spans"], F.struct(acc["open"].alias("a"), (F.size(lines) - 1).alias("b"))
            ),
        ).otherwise(acc["spans"])

    return F.aggregate(fences, start, step, finish)


def strip_code_blocks(content: ColumnOrName) -> Column:
    """Blank fenced blocks, keeping the number of lines. Notes without a fence pass through."""
    c = col(content)

    def blank(lines: Column) -> Column:
        return let(
            _fence_spans(lines),
            lambda spans: F.transform(
                lines,
                lambda ln, i: F.when(
                    F.exists(spans, lambda s: (i >= s["a"]) & (i <= s["b"])), F.lit("")
                ).otherwise(ln),
            ),
        )

    fenced = F.contains(c, F.lit("```")) | F.contains(c, F.lit("~~~"))
    return F.when(fenced, F.array_join(let(F.split(c, "\n"), blank), "\n")).otherwise(c)


# --- sections -----------------------------------------------------------------------


def section_items(content: ColumnOrName, heading: str) -> Column:
    """Bullets under ``## heading``; headings inside fences do not count."""
    literal = "".join("\\" + ch if ch in r".*+?^${}()|[]\\" else ch for ch in heading)
    body = F.regexp_extract(
        strip_code_blocks(content), rf"(?s)(?:\A|\n)## {literal}[ \t]*\n(.*?)(?=\n## |\z)", 1
    )
    return F.filter(
        F.transform(
            F.split(strip(body), "\n"), lambda ln: strip(F.regexp_replace(ln, r"^-\s*", ""))
        ),
        lambda ln: ln != "",
    )


def section_chunks(title: ColumnOrName, content: ColumnOrName) -> Column:
    """One struct(heading, text) per ``## `` section, the title in front of every text."""
    t = col(title)

    def build(lines: Column) -> Column:
        heads = F.filter(
            F.transform(
                lines, lambda ln, i: F.when(F.rlike(ln, F.lit(r"^##\s+\S")), i).otherwise(-1)
            ),
            lambda i: i >= 0,
        )
        return let(heads, lambda h: sections(lines, h))

    def sections(lines: Column, heads: Column) -> Column:
        # Section k runs from just after heading k-1 up to heading k.
        starts = F.concat(F.array(F.lit(-1)), heads)
        ends = F.concat(heads, F.array(F.size(lines)))
        bounds = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
        return F.transform(bounds, lambda b: one(lines, b))

    def one(lines: Column, b: Column) -> Column:
        heading = F.when(b["s"] < 0, F.lit("")).otherwise(
            strip(F.regexp_extract(F.get(lines, b["s"]), r"^##\s+(.+?)\s*$", 1))
        )
        body = strip(
            F.array_join(
                F.filter(
                    F.slice(lines, b["s"] + 2, b["e"] - b["s"] - 1),
                    lambda ln: ~F.rlike(ln, F.lit(r"^#\s")),
                ),
                "\n",
            )
        )
        return F.struct(heading.alias("heading"), body.alias("body"))

    kept = F.filter(
        let(F.split(col(content), "\n"), build), lambda s: (s["heading"] != "") | (s["body"] != "")
    )
    texts = F.transform(
        kept,
        lambda s: F.struct(
            s["heading"].alias("heading"),
            strip(
                F.array_join(
                    F.filter(F.array(t, s["heading"], s["body"]), lambda p: p != ""), "\n"
                )
            ).alias("text"),
        ),
    )
    return F.filter(texts, lambda s: s["text"] != "")


# --- links --------------------------------------------------------------------------


def wikilink_targets(content: ColumnOrName) -> Column:
    """Bare link targets in order, aliases and headings cut, code ignored."""
    plain = F.regexp_replace(strip_code_blocks(content), r"`[^`\n]*`", "")
    raw = F.regexp_extract_all(plain, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    targets = F.transform(raw, lambda r: strip(F.regexp_extract(r, r"\A([^|#]*)", 1)))
    return F.filter(targets, lambda x: (x != "") & ~F.startswith(x, F.lit("...")))


def link_key(target: ColumnOrName) -> Column:
    """Form in which link targets, paths, aliases and titles are compared."""
    return F.lower(F.replace(F.regexp_replace(col(target), r"(?i)\.md\z", ""), F.lit("\\"), F.lit("/")))


# --- section edits --------------------------------------------------------------------


def apply_edits(body: ColumnOrName, edits: ColumnOrName) -> Column:
    """Apply edits in order. Result: struct(body, changed, error).

    ``replace`` swaps the text of a section, ``append`` adds before its end. A section
    runs to the next heading of its own level or above. Appending to a missing section
    creates it; replacing a missing one sets ``error`` and leaves the note as it was.
    """
    start = F.struct(
        F.split(col(body), "\n").alias("lines"),
        F.array().cast("array<string>").alias("changed"),
        F.lit(None).cast("string").alias("error"),
    )

    def position(flags: Column) -> Column:
        return F.array_position(flags, F.lit(True)).cast("int")

    def last_full(lines: Column, upto: Column) -> Column:
        """One-based index of the last non-blank line among the first ``upto`` lines, else 0."""
        flags = F.reverse(F.transform(F.slice(lines, F.lit(1), upto), lambda ln: strip(ln) != ""))
        hit = position(flags)
        return F.when(hit == 0, F.lit(0)).otherwise(upto - hit + 1)

    def created(lines: Column, e: Column) -> Column:
        keep = last_full(lines, F.size(lines))
        return F.concat(
            F.slice(lines, F.lit(1), keep),
            F.array(F.lit(""), F.concat(F.lit("## "), e["section"]), F.lit("")),
            F.split(e["content"], "\n"),
        )

    def edited(lines: Column, e: Column, at: Column) -> Column:
        """``at``: one-based index of the heading line."""
        level = F.length(F.regexp_extract(F.get(lines, at - 1), r"^(#{1,6})\s+", 1))
        closing = position(
            F.transform(
                F.slice(lines, at + 1, F.size(lines)),
                lambda ln: F.length(F.regexp_extract(ln, r"^(#{1,6})\s+", 1)).between(1, level),
            )
        )
        # Lines up to and including ``stop`` belong to the section.
        stop = F.when(closing == 0, F.size(lines)).otherwise(at + closing - 1)
        return let(stop, lambda s: spliced(lines, e, at, s))

    def spliced(lines: Column, e: Column, at: Column, stop: Column) -> Column:
        tail = F.slice(lines, stop + 1, F.size(lines))
        new = F.split(e["content"], "\n")
        gap = F.when(stop < F.size(lines), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        insert = F.greatest(last_full(lines, stop), at)
        return F.when(
            e["action"] == "replace",
            F.concat(F.slice(lines, F.lit(1), at), new, gap, tail),
        ).otherwise(
            F.concat(
                F.slice(lines, F.lit(1), insert),
                new,
                F.slice(lines, insert + 1, F.size(lines)),
            )
        )

    def step(acc: Column, e: Column) -> Column:
        lines = acc["lines"]
        wanted = F.lower(strip(e["section"]))
        found = position(
            F.transform(
                lines,
                lambda ln: F.lower(strip(F.regexp_extract(ln, r"^#{1,6}\s+(.+?)\s*$", 1)))
                == F.when(wanted == "", F.lit("\u0000")).otherwise(wanted),
            )
        )
        return let(found, lambda at: outcome(acc, lines, e, at))

    def outcome(acc: Column, lines: Column, e: Column, at: Column) -> Column:
        missing = (at == 0) & (e["action"] == "replace")
        error = F.when(
            missing,
            F.concat(F.lit('Cannot replace missing section "'), e["section"], F.lit('"')),
        )
        done = acc["error"].isNotNull() | missing
        return F.struct(
            F.when(done, lines)
            .when(at == 0, created(lines, e))
            .otherwise(edited(lines, e, at))
            .alias("lines"),
            F.when(done, acc["changed"])
            .otherwise(F.array_append(acc["changed"], e["section"]))
            .alias("changed"),
            F.coalesce(acc["error"], error).alias("error"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            F.when(acc["error"].isNull(), F.array_join(acc["lines"], "\n"))
            .otherwise(col(body))
            .alias("body"),
            F.when(acc["error"].isNull(), acc["changed"])
            .otherwise(F.array().cast("array<string>"))
            .alias("changed"),
            acc["error"].alias("error"),
        )

    return F.aggregate(col(edits), start, step, finish)


# --- rendering -----------------------------------------------------------------------


def yaml_quote(c: ColumnOrName) -> Column:
    return F.concat(F.lit("'"), F.replace(col(c), F.lit("'"), F.lit("''")), F.lit("'"))


def render_note(body: ColumnOrName, scalars: dict[str, Column], lists: dict[str, Column]) -> Column:
    """Frontmatter and body back to text. Fields that are null or empty are left out."""
    scalar_lines = [
        F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), yaml_quote(v))) for k, v in scalars.items()
    ]
    list_lines = [
        F.when(
            F.size(F.coalesce(v, F.array().cast("array<string>"))) > 0,
            F.concat(
                F.lit(f"{k}:\n"),
                F.array_join(
                    F.transform(v, lambda x: F.concat(F.lit("  - "), yaml_quote(x))), "\n"
                ),
            ),
        )
        for k, v in lists.items()
    ]
    block = F.concat_ws("\n", *scalar_lines, *list_lines)
    return F.when(block == "", col(body)).otherwise(
        F.concat(F.lit("---\n"), block, F.lit("\n---\n"), col(body))
    )
