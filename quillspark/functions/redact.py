"""Secret redaction: an ordered list of patterns over whole texts."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ColumnOrName, ascii_boundary, col

# Rule name, pattern, replacement, in the order they are applied.
RULES = (
    ("neon_api", r"\bnapi_[A-Za-z0-9]{20,}", "napi_[REDACTED]"),
    ("neon_password", r"\bnpg_[A-Za-z0-9]{8,}", "npg_[REDACTED]"),
    ("github_pat", r"\bgithub_pat_[A-Za-z0-9_]{20,}", "github_pat_[REDACTED]"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}", "gh?_[REDACTED]"),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "xox?-[REDACTED]"),
    ("sk_key", r"\bsk-[A-Za-z0-9_-]{20,}", "sk-[REDACTED]"),
    ("akia", r"\bAKIA[0-9A-Z]{16}\b", "AKIA[REDACTED]"),
    ("asia", r"\bASIA[0-9A-Z]{16}\b", "ASIA[REDACTED]"),
    ("jwt_three_part", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+", "[REDACTED_JWT]"),
    ("jwt_two_part", r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{5,}", "[REDACTED_JWT]"),
    ("jwt_blob", r"\beyJ[A-Za-z0-9_+/=-]{37,}", "[REDACTED_JWT]"),
    ("url_password", r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@", "$1[REDACTED]@"),
    (
        "private_key",
        r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
        "[REDACTED_PRIVATE_KEY]",
    ),
)
# Names that hold a credential, and how a value follows.
NAMED_VALUE = (
    r"(?i)\b([A-Za-z_][A-Za-z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL)S?)"
    r"""(["']?\s*[:=]\s*)("[^"\n]*"|'[^'\n]*'|[^\s"';,)]+)"""
)
# Also names that are nothing but the word itself (``token = ...``); off by default.
NAMED_VALUE_STRICT = NAMED_VALUE.replace("[A-Za-z_][A-Za-z0-9_]*(?:", "[A-Za-z0-9_]*(?:")
# What cannot be a credential, namely collections, short values, documentation stand-ins.
PLACEHOLDER = (
    r"""["']?\s*(?:[\[{][^M]*|[^M]{0,7}|"""
    r"""(?:\.{3}|<.*>|x{3,}|your[-_ ]|my[-_ ]|some[-_ ]|changeme|example|placeholder|redacted|\$\{)[^M]*|"""
    r"""\$[A-Z_]+)\s*["']?"""
)

# Noncharacters that bracket a candidate between the two passes of the last rule.
_OPEN, _MID, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"
_EXEMPT = f"(?i){_OPEN}([^{_OPEN}{_MID}]*){_MID}({PLACEHOLDER.replace('M', _CLOSE)}){_CLOSE}"
_REST = f"{_OPEN}([^{_OPEN}{_MID}]*){_MID}[^{_CLOSE}]*{_CLOSE}"

RULE_NAMES = tuple(name for name, _, _ in RULES) + ("named_value",)


def _mark_named(text: Column, strict: bool) -> Column:
    pattern = ascii_boundary(NAMED_VALUE_STRICT if strict else NAMED_VALUE)
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$1$2{_MID}$3{_CLOSE}")
    return F.regexp_replace(marked, _EXEMPT, "$1$2")


# What a text must hold for a rule to match: found much faster than the rule itself.
SIGNS = {
    "neon_api": ("napi_",),
    "neon_password": ("npg_",),
    "github_pat": ("github_pat_",),
    "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "slack_token": ("xox",),
    "sk_key": ("sk-",),
    "akia": ("AKIA",),
    "asia": ("ASIA",),
    "jwt_three_part": ("eyJ",),
    "jwt_two_part": ("eyJ",),
    "jwt_blob": ("eyJ",),
    "url_password": ("://",),
    "private_key": ("-----BEGIN ",),
}
_NAME_SIGN = r"""(?i)(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|CREDENTIAL)S?["']?\s*[:=]"""


def _may_hold(t: Column, name: str) -> Column:
    return functools.reduce(operator.or_, (F.contains(t, F.lit(sign)) for sign in SIGNS[name]))


def _may_name(t: Column) -> Column:
    return F.rlike(t, F.lit(_NAME_SIGN)) | F.contains(t, F.lit(_OPEN))


def _where(c: Column, may: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` where it ``may`` do anything. ``c`` is written once, so rules can follow each other."""
    return F.transform(F.array(c), lambda t: F.when(may(t), change(t)).otherwise(t))[0]


def redact_secrets(text: ColumnOrName, strict: bool = False) -> Column:
    """Text with credentials cut. Vendor patterns run first, so their label survives."""
    # A text that holds the marks of the last rule already would confuse it.
    out = F.regexp_replace(col(text), f"[{_OPEN}{_MID}{_CLOSE}]", "\ufffd")
    for name, rule, replacement in RULES:
        cut = functools.partial(F.regexp_replace, pattern=ascii_boundary(rule), replacement=replacement)
        out = _where(out, functools.partial(_may_hold, name=name), cut)
    return _where(out, _may_name, lambda t: F.regexp_replace(_mark_named(t, strict), _REST, "$1[REDACTED]"))


def redaction_counts(df: DataFrame, text: str, strict: bool = False) -> DataFrame:
    """Add ``redacted`` and ``hits``: array<struct<rule,hits>> with the rules that fired.

    One column per step keeps every intermediate text computed once; only texts that a rule hits are changed by it.
    """
    step = df.withColumn("_t", F.col(text))
    t = F.col("_t")
    for name, rule, replacement in RULES:
        pattern, n = ascii_boundary(rule), f"_n_{name}"
        step = step.withColumn(n, F.when(_may_hold(t, name), F.regexp_count(t, F.lit(pattern))).otherwise(0))
        step = step.withColumn("_t", F.when(F.col(n) > 0, F.regexp_replace(t, pattern, replacement)).otherwise(t))
    marked = F.contains(t, F.lit(_OPEN))
    step = step.withColumn("_t", F.when(_may_name(t), _mark_named(t, strict)).otherwise(t))
    step = step.withColumn("_n_named_value", F.when(marked, F.regexp_count(t, F.lit(_REST))).otherwise(0))
    step = step.withColumn("_t", F.when(F.col("_n_named_value") > 0, F.regexp_replace(t, _REST, "$1[REDACTED]")).otherwise(t))
    hits = F.filter(
        F.array(
            *[
                F.struct(F.lit(n).alias("rule"), F.col(f"_n_{n}").alias("hits"))
                for n in RULE_NAMES
            ]
        ),
        lambda h: h["hits"] > 0,
    )
    return step.select(*df.columns, F.col("_t").alias("redacted"), hits.alias("hits"))


def redaction_totals(counted: DataFrame) -> DataFrame:
    """(rule, n_rows, n_hits) over the output of ``redaction_counts``; rules without hits left out."""
    return (
        counted.select(F.explode_outer("hits").alias("h"))
        .where(F.col("h").isNotNull())
        .groupBy(F.col("h.rule").alias("rule"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("h.hits").alias("n_hits"))
    )
