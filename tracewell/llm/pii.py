"""Personal data, plain and disguised, with spans in the source text.

Plain identifiers are matched in the text itself.  Then transducers rewrite what disguises use - homoglyphs and
zero-width characters, spelled digits, bracketed or spoken "at" and "dot" - and keep, for every piece of the rewritten
text, the source piece it stands for.  Identifiers found in the rewritten text are mapped back piece by piece; one that
overlaps a plain one of its kind is left out, unless it covers it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, spans_key, table, texts, trimmed

#: The kinds, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
_RUN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "α": "a", "ι": "i", "ο": "o", "ρ": "p", "ν": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
#: Characters without width.
UNSEEN = "­​‌‍⁠﻿"
#: Spoken digits.
SPOKEN = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def either(words: Iterable[str]) -> str:
    """Words in either case of ASCII letters."""
    return "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in words)


_WORD, _DOT, _AT = either(SPOKEN), either(["dot"]), either(["at"])
_SPOKEN_RUN = re.compile(rf"\b(?:{either(['plus'])}[\s-]+)?(?:{_WORD})(?:(?:[\s,-]+{_DOT})?[\s,-]+(?:{_WORD}))*\b")
_SPOKEN_WORD = re.compile(rf"(?:[\s,-]*)\b({_WORD}|{either(['plus', 'dot'])})\b")
_DIGIT_WORDS = frozenset(SPOKEN)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
#: Identifiers have four digits at least, so a shorter run that stands beside no digit is part of none.
SPOKEN_DIGITS = 4
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\s,().-]{0,8}\Z"), re.compile(r"[\s,().-]{0,8}[0-9]")
#: Last labels of a spoken domain beside those of two letters, and the words of two letters that are none.
LAST_LABELS = "com org net edu gov info biz name pro xyz online site shop club top app dev io de fr es it uk eu ch nl co us ai example test invalid"
SHORT_WORDS = "ad ah am an as at ax be by do eh er et ex go ha he hi if in is la le me my no of oh ok on or ox pa so to tu um un up us we wo ye yo zu"
#: Words before "dot" that make it the thing, and words before "at" that make it a place.
DETERMINERS = "the a an this that his her its their our your my each every one first last next any some no"
PLACED = "us me him her them it you is are was were be been look looks see find found online available more out only here work works worked buy shop visit read store stay meet sold held seen call order join us page site website home arrive stop sit live learn"
_LABEL = "[A-Za-z0-9-]+"
_SPOKEN_DOT = rf"(?:\s+{_DOT}\s+|\s*[\[({{<]\s*{_DOT}\s*[\])}}>]\s*)"
_LAST = rf"(?:(?:{either(LAST_LABELS.split())})|(?!(?:{either(SHORT_WORDS.split())})\b)[A-Za-z]{{2}})\b"
_NAME = rf"(?!(?:{either(DETERMINERS.split())})\b){_LABEL}"
_AT_SPOKEN = re.compile(rf"(?<=[A-Za-z0-9])\s+{_AT}\s+(?=(?:{_NAME}{_SPOKEN_DOT})+{_LAST})")
_AT_BEFORE_DOMAIN = re.compile(rf"(?<=[A-Za-z0-9])\s+{_AT}\s+(?=(?:{_LABEL}\.)+{_LAST}(?!\.[A-Za-z]))")
_LAST_WORD = re.compile(r"[A-Za-z0-9]+\Z")
_DOT_SPOKEN = re.compile(rf"(?<=[A-Za-z0-9])\s+{_DOT}\s+(?=[A-Za-z0-9])")
_AT_CLOSED, _DOT_CLOSED = (re.compile(rf"[\[({{<]\s*{w}\s*[\])}}>]\s*") for w in (_AT, _DOT))


@cache
def homoglyphs() -> tuple[dict[str, str], re.Pattern]:
    """Characters that compatibility forms or looks reduce to one ASCII character, or to none, and a pattern for those of
    the basic plane: with others in it, the pattern would be tried character by character."""
    table: dict[str, str] = {}
    for c in map(chr, range(0x80, 0x1FC00)):
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in "@.+-_%()"):
            table[c] = plain
        elif unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.decimal(c))
    table |= LOOKALIKES | dict.fromkeys(UNSEEN, "")
    return table, re.compile("[" + "".join(re.escape(c) for c in sorted(table) if c <= "\uffff") + "]")


class Rewritten:
    """Text with pieces replaced; ``source(a, b)`` is the span of the original that ``a..b`` stands for."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]) -> None:
        parts, self.at, self.src, self.end, at, done = [], [], [], [], 0, 0

        def piece(new: str, a: int, b: int, same: bool) -> None:
            nonlocal at
            if new:
                parts.append(new)
                self.at.append(at)
                self.src.append(a)
                self.end.append(-1 if same else b)
                at += len(new)

        for a, b, new in sorted(changes):
            if a < done:
                continue
            piece(text[done:a], done, a, True)
            piece(new, a, b, False)
            done = b
        piece(text[done:], done, len(text), True)
        self.text = "".join(parts)

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Start, end and whether any replaced piece is within."""
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        start = self.src[i] if self.end[i] >= 0 else self.src[i] + a - self.at[i]
        end = self.end[j] if self.end[j] >= 0 else self.src[j] + b - self.at[j]
        return start, end, j > i or self.end[i] >= 0


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's base: leftmost non-overlapping matches of each kind that pass its check.

    Each takes time in proportion to the text: mail addresses are found from their ``@`` backwards, numbers from the
    starts of digit runs.
    """
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in _RUN:
                a -= 1
            if a < m.start():
                found["email"].append((a, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found["phone"].append(m.span())
    return found


def closed(pattern: re.Pattern, text: str, new: str) -> list[tuple[int, int, str]]:
    """Bracketed words with the white space around them."""
    changes, done = [], 0
    for m in pattern.finditer(text):
        a = m.start()
        while a > done and text[a - 1].isspace():
            a -= 1
        done = m.end()
        changes.append((a, done, new))
    return changes


def spoken_digits(text: str) -> list[tuple[int, int, str]]:
    changes = []
    for m in _SPOKEN_RUN.finditer(text):
        words = list(_SPOKEN_WORD.finditer(text, m.start(), m.end()))
        few = sum(w[1].lower() in SPOKEN for w in words) < SPOKEN_DIGITS
        if few and not _DIGIT_AFTER.match(text, m.end()) and not _DIGIT_BEFORE.search(text[max(0, m.start() - 9) : m.start()]):
            continue
        for w in words:
            a = w.start(1) if w is words[0] else w.start()
            changes.append((a, w.end(), {"plus": "+", "dot": "."}.get(w[1].lower()) or SPOKEN[w[1].lower()]))
    return changes


def named(text: str, at: int) -> bool:
    """Whether the word that ends at ``at`` may be a mailbox: not one that "at" follows to tell a place, as in "sold at example.com"."""
    word = _LAST_WORD.search(text[max(0, at - 64) : at])[0].lower()
    return word not in PLACED.split() and not word.endswith(("ed", "ing"))


def disguises(text: str) -> list[tuple[int, int, str]]:
    """What the transducers would replace: (start, end, replacement), not overlapping within a kind of disguise.

    A transducer is run where the text holds what none of its matches is without: the inner words of a run of spoken
    digits stand between separators, and a spoken "at" or "dot" needs the letters of "dot".
    """
    changes: list[tuple[int, int, str]] = []
    if not text.isascii():
        table, glyph = homoglyphs()
        changes += [(m.start(), m.end(), table[m[0]]) for m in glyph.finditer(text)]
        if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text):
            changes += [(m.start(), m.end(), table[m[0]]) for m in _BEYOND.finditer(text) if m[0] in table]
    low = text.lower()
    if not _DIGIT_WORDS.isdisjoint(low.replace(",", " ").replace("-", " ").split()):
        changes += spoken_digits(text)
    at, dots = closed(_AT_CLOSED, text, "@"), "dot" in low
    if "at" in low:
        at += [(m.start(), m.end(), "@") for m in _AT_SPOKEN.finditer(text)] if dots else []
        at += [(m.start(), m.end(), "@") for m in _AT_BEFORE_DOMAIN.finditer(text) if named(text, m.start())]
    if dots and (at or "@" in text):
        at += closed(_DOT_CLOSED, text, ".") + [(m.start(), m.end(), ".") for m in _DOT_SPOKEN.finditer(text)]
    return changes + at


def detect(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans; both by kind as listed, then start."""
    base = plain(text)
    both = {k: list(v) for k, v in base.items()}
    if changes := disguises(text):
        new = Rewritten(text, changes)
        for kind, spans in plain(new.text).items():
            for a, b in spans:
                start, end, changed = new.source(a, b)
                if changed and all(y <= start or end <= x or start <= x and y <= end for x, y in base[kind]):
                    both[kind].append((start, end))
    flat = lambda d: [(k, a, b) for k in KINDS for a, b in sorted(d[k])]
    return flat(base), flat(both)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by ``<KIND>``; of spans that overlap, the first and longest names the kind and all are covered."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= done:
            continue
        if a < done:
            done = b
            continue
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row; null text is empty and has none.

    Null and repeated ids stay as they are; columns other than ``doc_id`` and ``text`` are not read.  Texts of any length
    are searched whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = rows_of(batch, "doc_id", "text")
            found = [detect(t) for t in text]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(spans_key(base).encode()).hexdigest() for base, _ in found]
            yield pa.record_batch([pa.array(ids, pa.int64()), *counts, pa.array(sha, pa.string()), pa.array([spans_key(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns with ``text`` redacted; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            text = [None if t is None else redact(t, detect(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(trimmed(run), docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
