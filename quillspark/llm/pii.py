"""Personal data in whole texts: plain identifiers, and disguised ones found after an offset-preserving normalisation.

Plain spans follow fixed patterns, leftmost and non-overlapping per kind: email, IP address, card number (12 to 19 digits that pass the
Luhn check), phone number (9 to 15 digits after a plus sign).

Disguised spans. Transducers rewrite the text into a plain one and remember, for each character written, the span of source characters it
came from: look-alike letters and digits (compatibility forms, Cyrillic and Greek look-alikes) become ASCII, invisible characters vanish,
"at" and "dot" in brackets or as words between address parts become ``@`` and ``.``, runs of spelled digits (English, German, French, Spanish)
become digits: four or more, or fewer that stand among figures with the same separators as a number's. The same patterns then run over the rewritten text, and the spans are mapped back. A span is added if it covers source
characters that no span of its kind covers yet; plain spans always stay.

Only texts with a trace of a disguise are rewritten; the traces are necessary for a rewrite to change anything. Of other characters than ASCII
the trace is that the rewrite changes them.

Defined results: a null text is empty and has no spans. Every row has its own result, also where doc_id repeats or is null. Offsets are code
points, ends exclusive. Very long texts, runs without a space and texts of very many spans take time in proportion; a rewritten
text holds 16 bytes of offsets per character. Spans of different kinds may overlap; masking joins those that do. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import bounded_batches, pick, texts

KINDS = ("email", "ip", "card", "phone")

#: Patterns of plain identifiers. Fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The patterns for addresses read a run again from each of its characters. These read it once, with the same matches.
_HOST = re.compile("@" + EMAIL.pattern.partition("@")[2])
_IP_FROM_START = re.compile("(?<![0-9])" + IP.pattern)
_NO_NAME = re.compile(r"[^A-Za-z0-9._%+-]")

#: Letters that look like Latin ones. Fixed values.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "։": ":", "∙": ".", "․": ".", "。": ".", "·": ".", "•": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
#: Characters that are not seen. Fixed values.
INVISIBLE = "­͏᠎​‌‍⁠⁡⁢⁣⁤﻿"
#: Digits in words. Fixed values.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
}
_NUMBER = "|".join(sorted(SPELLED, key=lambda w: (-len(w), w)))
#: Words for the signs, in the four languages. Fixed values.
_AT, _DOT, _PLUS = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto", "plus|más"
_BRACKETED_AT = re.compile(rf"[ \t]*(?:[(\[{{<]\s*(?:{_AT}|@)\s*[)\]}}>]|_(?:{_AT})_)[ \t]*", re.I)
_BRACKETED_DOT = re.compile(rf"[ \t]*(?:[(\[{{<]\s*(?:{_DOT}|\.)\s*[)\]}}>]|_(?:{_DOT})_)[ \t]*", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_PART = r"[A-Za-z0-9._%+-]+"
#: Ends of addresses that are taken from bare words: common ones that are no common words. Fixed values.
_ENDS = "com|org|net|edu|gov|mil|int|info|biz|name|io|ai|dev|app|xyz|eu|de|fr|es|uk|us|ca|nl|ch|pl|ru|jp|cn|br|au|se|dk|fi|cz|pt|ie|nz|za|kr|mx|tv|test|example|invalid|localhost"
# Bare words count only in the whole shape "name at host dot end".
_WORDS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<name>{_PART}(?:[ ](?:{_DOT})[ ]{_PART})?)(?P<at>[ ](?:{_AT})[ ])(?P<host>{_LABEL}(?:(?:[ ](?:{_DOT})[ ]|\.){_LABEL})*)"
    rf"(?P<dot>[ ](?:{_DOT})[ ])(?P<end>{_ENDS})(?![A-Za-z0-9])",
    re.I,
)
_SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9])[ ]?@[ ]?(?=[A-Za-z0-9])")
_WORD_DOT = re.compile(rf"[ ](?:{_DOT})[ ]", re.I)
_RUN = re.compile(
    rf"(?<![^\W_])(?:(?:{_PLUS})[ ,-]+)?(?:{_NUMBER}|[0-9]+)(?:(?:[ ,.-]+|[ ](?:{_DOT}|dash|hyphen)[ ])(?:{_NUMBER}|[0-9]+))+(?![^\W_])", re.I
)
_RUN_TOKEN = re.compile(rf"(?P<plus>{_PLUS})[ ,-]+|(?P<dot>[ ](?:{_DOT})[ ])|(?P<dash>[ ](?:dash|hyphen)[ ])|(?P<word>{_NUMBER})|(?P<digits>[0-9]+)|(?P<gap>[ ,.-]+)", re.I)
# A number of a few digit words among figures: separated by spaces and dashes, or by dots as an address; no part of a decimal number.
_ONE = rf"(?:{_NUMBER}|[0-9]+)"
_AMONG_FIGURES = re.compile(
    rf"(?<![^\W_])(?<![A-Za-z0-9][.,])(?:(?:{_PLUS})[ -]+)?{_ONE}(?:(?:(?:[ -]+|[ ](?:dash|hyphen)[ ]){_ONE})+|(?:\.{_ONE})+)(?![^\W_])(?![.,][A-Za-z0-9])", re.I
)
_SPELLED_WORD = re.compile(rf"(?<![^\W_])(?:{_NUMBER})(?![^\W_])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``EMAIL``: each sign with the name before it, back to the last match at most, and the host after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            start = _name_start(text, done, at)
            if start < at:
                yield start, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def _name_start(text: str, least: int, end: int) -> int:
    """Where the name that reaches ``end`` begins; looked for backwards in steps that double."""
    width = 64
    while True:
        low = max(least, end - width)
        breaks = [m.end() for m in _NO_NAME.finditer(text, low, end)]
        if breaks or low == least:
            return breaks[-1] if breaks else least
        width *= 2


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, in the order of the kinds."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", *span) for span in emails(text)]
    if "." in text:
        # Leading zeros don't make a part larger.
        out += [("ip", *m.span()) for m in _IP_FROM_START.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Rewritten:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, starts: array, ends: array):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Rewritten:
        return cls(text, array("q", range(len(text))), array("q", range(1, len(text) + 1)))

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Spans ``(start, end, new)``, in order and apart: all characters of ``new`` stand for the whole span."""
        if not edits:
            return self
        text, starts, ends, at = [], array("q"), array("q"), 0
        for start, end, new in edits:
            text.append(self.text[at:start])
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            if new:
                text.append(new)
                a, b = self.source(start, end)
                starts += array("q", [a]) * len(new)
                ends += array("q", [b]) * len(new)
            at = end
        text.append(self.text[at:])
        return Rewritten("".join(text), starts + self.starts[at:], ends + self.ends[at:])


@functools.lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    """One character as ASCII where it is a form or look-alike of ASCII, else itself."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() and plain.strip() else c


def fold_characters(r: Rewritten) -> Rewritten:
    return r.replaced([(i, i + 1, new) for i, c in enumerate(r.text) if c >= "\x80" and (new := _folded(c)) != c])


def fold_signs(r: Rewritten) -> Rewritten:
    """Disguised at and dot signs of addresses."""
    r = r.replaced([(*m.span(), "@") for m in _BRACKETED_AT.finditer(r.text)])
    r = r.replaced([(*m.span(), ".") for m in _BRACKETED_DOT.finditer(r.text)])
    edits = []
    for m in _WORDS.finditer(r.text):
        edits += [(m.start("name") + d.start(), m.start("name") + d.end(), ".") for d in _WORD_DOT.finditer(m["name"])]
        edits.append((*m.span("at"), "@"))
        edits += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in _WORD_DOT.finditer(m["host"])]
        edits.append((*m.span("dot"), "."))
    r = r.replaced(edits)
    r = r.replaced([(*m.span(), "@") for m in _SPACED_AT.finditer(r.text) if m[0] != "@"])
    # "name@host dot end", once a bracketed or spaced sign is a plain one.
    mixed = re.compile(rf"(?<=@)({_LABEL}(?:\.{_LABEL})*)([ ](?:{_DOT})[ ]|[ ]\.[ ]?)(?=(?:{_LABEL}[ ](?:{_DOT})[ ])*(?:{_ENDS})(?![A-Za-z0-9]))", re.I)
    while edits := [(*m.span(2), ".") for m in mixed.finditer(r.text)]:
        r = r.replaced(edits)
    return r


def fold_digits(r: Rewritten) -> Rewritten:
    """Runs of spelled digits become digits; a gap between them becomes nothing, a dot word a dot."""
    edits = []
    for run in _RUN.finditer(r.text):
        words = len(_SPELLED_WORD.findall(run[0]))
        # Three digit words in a row are prose; an address in words has its dots, other numbers have figures.
        if words >= 4 or (words and _WORD_DOT.search(run[0])):
            spans = [run.span()]
        elif words and _FIGURE.search(run[0]):
            spans = [m.span() for m in _AMONG_FIGURES.finditer(r.text, *run.span()) if _FIGURE.search(m[0]) and _SPELLED_WORD.search(m[0])]
        else:
            continue
        for span in spans:
            for m in _RUN_TOKEN.finditer(r.text, *span):
                new = {"plus": "+", "dot": ".", "dash": "-", "gap": "." if m[0].strip() == "." and " " not in m[0] else ""}.get(m.lastgroup)
                edits.append((*m.span(), SPELLED[_plain_case(m[0])] if m.lastgroup == "word" else m[0] if new is None else new))
    return r.replaced(edits)


_FIGURE = re.compile("[0-9]")


def _plain_case(word: str) -> str:
    """Lower case as the patterns see it: they take the dotted capital I and the dotless i for an i."""
    return word.replace("İ", "i").replace("ı", "i").lower()


# A rewrite can add a span only where one of these is found: a look-alike or another form of a character, a sign in brackets or as a
# word, a sign with a space, or digit words in a row. Case is folded for words alone: some look-alikes are case variants.
_SIGN_TRACE = re.compile(
    rf"[(\[{{<_]\s*(?:{_AT}|{_DOT}|@|\.)\s*[)\]}}>_]|[ ](?:{_DOT})[ ]|[ ]@|@[ ]|@[A-Za-z0-9.-]+[ ]\.", re.I
)
#: Bytes of ASCII letters lower-cased, figures, other ASCII as spaces: what is left of a text is its words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_ACCENTS = str.maketrans("üÜéÉáÁİı", "uUeEaAii")


class _Kinds(dict):
    """Of words: 1 for digit words and dashes, 2 for figures, else 0."""

    def __missing__(self, word: bytes) -> int:
        return 2 * word.isdigit()


_RUN_WORDS = _Kinds({w.translate(_ACCENTS).encode(): 1 for w in (*SPELLED, "dash", "hyphen")})


def _digit_words(text: str) -> bool:
    """Whether four digit words stand in a row, digits and punctuation left aside, or one stands beside figures."""
    data = text if text.isascii() else text.translate(_ACCENTS)
    kinds = bytes(map(_RUN_WORDS.__getitem__, data.encode("ascii", "replace").translate(_LETTERS).split()))
    return b"\1\2" in kinds or b"\2\1" in kinds or b"\1\1\1\1" in kinds


def disguised(text: str) -> bool:
    return bool(
        (not text.isascii() and any(c >= "\x80" and _folded(c) != c for c in set(text))) or _SIGN_TRACE.search(text) or _digit_words(text)
    )


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and those that the rewritten text adds."""
    plain = plain_spans(text)
    return plain, added_spans(text, plain) if disguised(text) else []


def added_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    folded = fold_signs(fold_characters(Rewritten.of(text)))
    added: list[tuple[str, int, int]] = []
    # Spans of a kind lie apart, so the last one that begins no later is the only one that can cover another.
    known = {kind: [(s, e) for k, s, e in plain if k == kind] for kind in KINDS}
    for kind, start, end in plain_spans(folded.text):
        a, b = folded.source(start, end)
        before = bisect_right(known[kind], a, key=lambda span: span[0])
        if not before or known[kind][before - 1][1] < b:
            added.append((kind, a, b))
    spelled = fold_digits(folded)
    if spelled is not folded:
        # Digit words next to an identifier that is found already are words.
        taken = sorted((s, e) for _, s, e in [*plain, *added])
        reach = list(accumulate((e for _, e in taken), max))
        for kind, start, end in plain_spans(spelled.text):
            a, b = spelled.source(start, end)
            before = bisect_left(taken, b, key=lambda span: span[0])
            if not before or reach[before - 1] <= a:
                added.append((kind, a, b))
    return added


def listed(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes the kind of its first one, as ``<EMAIL>``."""
    out, at = [], 0
    for kind, start, end in sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, str] | None = None) -> DataFrame:
    """Per row: ``doc_id``, the carried columns, counts and digest of plain spans, ``spans`` (all), ``n_added``, ``masked`` text."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text, **(carry or {}))
    names = ["doc_id", *(carry or {})]
    made = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "masked"]
    schema = rows.select(*names).schema
    for name in made:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")

    def one(text: str) -> tuple:
        plain, added = all_spans(text)
        counts = [sum(k == kind for k, _, _ in plain) for kind in KINDS]
        digest = hashlib.sha256(listed(plain).encode()).hexdigest()
        return *counts, digest, listed(plain + added), len(set(added)), masked(text, plain + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(t) for t in texts(batch["text"])]
            columns = zip(*got, strict=True) if got else [[] for _ in made]
            kinds = [pa.int64() if n.startswith("n_") else pa.string() for n in made]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=[*names, *made],
            )

    return rows.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return find(docs).drop("masked")
