"""Token counts that follow edits: a segment tree of pre-token segments per document, kept as a row of a table.

A leaf is about ``LEAF`` characters, cut where white space follows a character that is none: no pre-token crosses such
a place, and whether it is one depends on the two characters beside it alone.  An edit therefore needs only its own
leaves and one neighbour on either side encoded again; the sums on the way to the root follow.

``build_trees`` encodes every text once.  What it gives can be written and read again; ``apply_edits`` takes leaves and
sums as they are stored, encodes what edits touch, and gives trees to store in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, rows_of, table, texts, trimmed, written
from .tokenizing import BYTE_BPE, WHITE, ChunkEncoder, encoder

LEAF = 512
_CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
EDITS = "array<struct<at:int,n_deleted:int,inserted:string>>"
TREES = f"doc_id long, leaves array<string>, tokens array<int>, chars array<int>, edits {EDITS}"
EDITED = "doc_id long, leaves array<string>, tokens array<int>, chars array<int>, n_tokens long, n_tokens_edited long, n_edits long, n_chars_encoded long"
COUNTS = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_chars_encoded"]


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class CountTree:
    """Sums of characters and tokens over the leaves of one text, in a binary heap layout."""

    def __init__(self, leaves: list[str], counts: list[int]) -> None:
        self.width = 1
        while self.width < len(leaves):
            self.width *= 2
        self.leaves = leaves + [""] * (self.width - len(leaves))
        pad = [0] * (self.width - len(leaves))
        self.tokens = [0] * self.width + counts + pad
        self.chars = [0] * self.width + [len(x) for x in leaves] + pad
        for i in range(self.width - 1, 0, -1):
            self._sum(i)
        self.encoded = 0

    @classmethod
    def stored(cls, leaves: list[str], tokens: list[int], chars: list[int]) -> CountTree:
        """A tree as it was stored; nothing is encoded or summed."""
        tree = cls.__new__(cls)
        tree.width, tree.leaves, tree.tokens, tree.chars, tree.encoded = len(leaves), leaves, tokens, chars, 0
        return tree

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def put(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.width
        self.tokens[i], self.chars[i] = count, len(text)
        while i > 1:
            i //= 2
            self._sum(i)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last that has any, for the end) and its first character's place."""
        i, before = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.width, before

    def edit(self, enc: ChunkEncoder, at: int, n_deleted: int, inserted: str) -> None:
        """Replace ``n_deleted`` characters from ``at`` on; both are brought within the text."""
        total = self.chars[1]
        at = max(0, min(at, total))
        n_deleted = max(0, min(n_deleted, total - at))
        first, before = self.find(at)
        last, _ = self.find(at + max(0, n_deleted - 1))
        lo, hi = first - 1, last + 1
        while lo > 0 and not self.leaves[lo]:
            lo -= 1
        while hi < self.width - 1 and not self.leaves[hi]:
            hi += 1
        lo, hi = max(lo, 0), min(hi, self.width - 1)
        start = before - sum(len(self.leaves[i]) for i in range(lo, first))
        region = "".join(self.leaves[lo : hi + 1])
        region = region[: at - start] + inserted + region[at - start + n_deleted :]
        parts = leaves_of(region)
        room = hi - lo + 1
        counts = [len(b) // 4 for b in enc.encode(parts)]
        self.encoded += len(region)
        if len(parts) > room:
            self._grow(lo, hi, parts, counts)
            return
        for i in range(room):
            self.put(lo + i, parts[i] if i < len(parts) else "", counts[i] if i < len(parts) else 0)

    def _grow(self, lo: int, hi: int, parts: list[str], counts: list[int]) -> None:
        """Leaves ``lo`` to ``hi`` become more of them: others keep their sums, empty ones are left out, and the tree is as wide as it then needs.

        Leaves are split by the characters that come in, so this happens once for ``LEAF`` of them at most; nothing is encoded.
        """
        own = [(x, n) for i, (x, n) in enumerate(zip(self.leaves, self.tokens[self.width :], strict=True)) if x and not lo <= i <= hi]
        before = sum(1 for x in self.leaves[:lo] if x)
        own[before:before] = list(zip(parts, counts, strict=True))
        encoded = self.encoded
        self.__init__([x for x, _ in own], [n for _, n in own])
        self.encoded = encoded

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def build(enc: ChunkEncoder, text: str) -> CountTree:
    leaves = leaves_of(text)
    return CountTree(leaves, [len(b) // 4 for b in enc.encode(leaves)])


def _tree_columns(ids: list, trees: list[CountTree]) -> list[pa.Array]:
    sums = pa.list_(pa.int32())
    return [pa.array(ids, pa.int64()), pa.array([t.leaves for t in trees], pa.list_(pa.string())), pa.array([t.tokens for t in trees], sums), pa.array([t.chars for t in trees], sums)]


def build_trees(docs: DataFrame, tokenizer: tuple[str, bool] = BYTE_BPE) -> DataFrame:
    """A tree for each row of ``doc_id, text`` and perhaps ``edits``, which are carried along.

    Null text is empty: one empty leaf.  Texts without white space are one leaf.  Null and repeated ids stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*tokenizer)
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                ids, text = rows_of(part, "doc_id", "text")
                leaves = [leaves_of(t) for t in text]
                counts = iter([len(b) // 4 for b in enc.encode([x for own in leaves for x in own])])
                trees = [CountTree(own, [next(counts) for _ in own]) for own in leaves]
                yield pa.record_batch([*_tree_columns(ids, trees), part.column(part.schema.get_field_index("edits"))], ["doc_id", "leaves", "tokens", "chars", "edits"])

    edits = F.col("edits") if "edits" in docs.columns else F.lit(None)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), edits.cast(EDITS).alias("edits"))
    return own.mapInArrow(trimmed(run), TREES)


def apply_edits(trees: DataFrame, tokenizer: tuple[str, bool] = BYTE_BPE) -> DataFrame:
    """Trees after their ``edits``, with ``n_tokens`` before, ``n_tokens_edited`` after, ``n_edits`` and ``n_chars_encoded``.

    edits: array of ``(at, n_deleted, inserted)`` in code points, each applied to the text the ones before it left.  Null
    edits are none, null fields of an edit are 0 or empty.  Each row of the input has one row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*tokenizer)
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                ids, leaves, tokens, chars, edits = rows_of(part, "doc_id", "leaves", "tokens", "chars", "edits")
                own = [CountTree.stored(*t) for t in zip(leaves, tokens, chars, strict=True)]
                before = [t.count for t in own]
                for tree, changes in zip(own, edits, strict=True):
                    for e in changes or []:
                        tree.edit(enc, e["at"] or 0, e["n_deleted"] or 0, e["inserted"] or "")
                told = [before, [t.count for t in own], [len(c or []) for c in edits], [t.encoded for t in own]]
                yield pa.record_batch([*_tree_columns(ids, own), *[pa.array(c, pa.int64()) for c in told]], ["doc_id", "leaves", "tokens", "chars", *COUNTS[1:]])

    return trees.select("doc_id", "leaves", "tokens", "chars", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(trimmed(run), EDITED)


def count_with_edits(docs: DataFrame, tokenizer: tuple[str, bool] = BYTE_BPE) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, n_edits, n_chars_encoded`` for rows of ``doc_id, text, edits``, by way of stored trees."""
    trees = written(build_trees(docs, tokenizer), "count-trees")
    out = written(apply_edits(trees, tokenizer).select(*COUNTS), "token-counts")
    discard(docs.sparkSession, trees)
    return out


def with_edits(docs: DataFrame) -> DataFrame:
    """Three edits for each document, fixed by its id and length: a deletion, an insertion inside a word and a replacement."""
    own = texts(docs).withColumn("n", F.length("text")).withColumn("h", F.xxhash64("doc_id"))
    at = lambda k: F.pmod(F.shiftrightunsigned("h", k), F.col("n") + 1).cast("int")
    edit = lambda a, d, s: F.struct(a.alias("at"), F.lit(d).alias("n_deleted"), s.alias("inserted"))
    return own.select("doc_id", "text", F.array(edit(at(0), 12, F.lit("")), edit(at(7), 0, F.lit("in ser")), edit(at(14), 40, F.expr("substring(text, 1, 30)"))).alias("edits"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(with_edits(table(spark, sf_dir, "documents")))
