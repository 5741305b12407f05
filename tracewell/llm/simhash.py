"""SimHash near duplicates by BK-trees over shards of fingerprints, down to connected groups.

1. A text's fingerprint is the bitwise majority over the XXH64 hashes of its three-word shingles.
2. Fingerprints are cut into ``k`` blocks.  Two that differ in at most ``RADIUS`` bits agree on ``k - RADIUS`` blocks at
   least, so each goes to a shard for every choice of so many blocks, and no pair is missed.  ``k`` grows with the number
   of different fingerprints, so that shards stay small.
3. A task grows the BK-trees of its shards (a child hangs on the edge of its Hamming distance to the parent) and searches
   them with the shards' own fingerprints, following only edges within the radius of the distance.  A branch whose nodes
   are all in the searching fingerprint's component is left out, as links inside a component change nothing.
4. A shard of more than ``TREE`` fingerprints has several trees.  Each is joined with the fingerprints of the shard's other
   trees; the trees are broadcast as long as all of them are counted to be within ``MOST_TREE_BYTES``, else dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, rows_of, table, texts, trimmed, written
from .components import components

WORDS, SEED, RADIUS = 3, 42, 3
#: Nodes of a tree, and bytes of all trees that are broadcast.
TREE, MOST_TREE_BYTES = 4096, 64 << 20
#: Fingerprints a task holds at a time, and visits of nodes it plans for at once.
HELD, VISITS = 1 << 17, 1 << 21
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20
DOCS = 1024
_SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]").search


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of all runs of ``WORDS`` words, joined by spaces."""
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - WORDS + 1].tolist()
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(start, end[WORDS - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(raw: bytes) -> int:
    """A bit is set if it is set in over half the hashes; a text of fewer words has one hash, of all its words, or none."""
    set_, n, carried, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(raw) or (at == 0 and not raw):
        end = len(raw)
        if end - at > PIECE:
            space = _NEXT_SPACE(raw, at + PIECE)
            end = space.end() if space else end
        words = carried + raw[at:end].translate(_SMALL).split()
        at = max(end, 1)
        if len(words) < WORDS:
            carried = words
            continue
        hashes = _hashes(words)
        n += len(hashes)
        set_ += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        carried = words[1 - WORDS :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * set_ > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``; the bits of ``fp`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
            raw = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            fp = np.array([fingerprint(t.as_py()) for t in raw], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("doc_id")), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(trimmed(run), "doc_id long, fp long")


def masks(distinct: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that make a shard: for ``k`` blocks, all choices of ``k - radius``.

    ``k`` is the least number of blocks that gives each of so many spread fingerprints a shard of some 64 at most.
    """
    k = radius + 1
    while k < 2 * radius + 2 and distinct >> (64 * (k - radius) // k) > 64:
        k += 1
    cuts = [64 * i // k for i in range(k + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(some) for some in combinations(blocks, k - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """BK-trees over different fingerprints ``fp`` of trees ``root_of``: ``root_of[i]`` is the first member of i's tree."""

    def __init__(self, fp: np.ndarray, root_of: np.ndarray):
        self.fp, self.root_of = fp, root_of
        parent, edge = np.full(len(fp), -1, np.int64), np.zeros(len(fp), np.int64)
        left = np.flatnonzero(root_of != np.arange(len(fp)))
        at = root_of[left]
        self.levels = []
        while len(left):
            d = np.bitwise_count(fp[left] ^ fp[at]).astype(np.int64)
            _, first, same = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            parent[left[first]], edge[left[first]] = at[first], d[first]
            self.levels.append(left[first])
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], left[first][same[rest]]
        self.parent = parent
        below = np.flatnonzero(parent >= 0)
        key = parent[below] * 65 + edge[below]
        order = np.argsort(key)
        self.key, self.child = key[order], below[order]

    def span(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest label in the branch below each node."""
        low, high = label.copy(), label.copy()
        for nodes in reversed(self.levels):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return low, high

    def near(self, fp: np.ndarray, root: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """``query, node`` of all pairs within the radius, apart from those in branches that are in the query's component."""
        query, node, found = np.arange(len(fp)), root, []
        while len(query):
            open_ = (low[node] != label[query]) | (high[node] != label[query])
            query, node = query[open_], node[open_]
            d = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            found.append((query[hit], node[hit]))
            a = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 1))
            b = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            n = b - a
            query = np.repeat(query, n)
            node = self.child[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels, each the least member of its component, after more links."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def linked(forest: Forest, fp: np.ndarray, root: np.ndarray, me: np.ndarray, label: np.ndarray, radius: int) -> np.ndarray:
    """Labels after searching ``fp`` in the trees of ``root``; ``me``: where queries stand among the labels, nodes first."""
    n = len(forest.fp)
    size = np.bincount(forest.root_of, minlength=n)[root]
    rank = np.arange(len(fp)) - np.searchsorted(root, root)
    order = np.lexsort((root, np.minimum(rank, 1 << 30)))  # first of each tree first: they join most of a dense one
    cuts, total = [0], 0
    for i, s in enumerate(size[order].tolist()):
        if total and total + s > VISITS:
            cuts.append(i)
            total = 0
        total += s
    low, high = forest.span(label[:n])
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        some = order[a:b]
        query, node = forest.near(fp[some], root[some], label[me[some]], low, high, radius)
        u = me[some[query]]
        apart = label[u] != label[node]
        if apart.any():
            label = join(label, u[apart], node[apart])
            low, high = forest.span(label[:n])
    return label


LINKS = "a long, b long, c int, v long, sub int, fps binary, labels binary"


def _links(fp: np.ndarray, label: np.ndarray) -> list:
    """Every fingerprint that is not the first of its component, with that first one."""
    own = np.flatnonzero(label != np.arange(len(fp)))
    return [pa.array(fp[label[own]].view(np.int64)), pa.array(fp[own].view(np.int64))]


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """Links inside the shards and parts of ``c, v, sub, several, fp``, and, where a shard has several, what each part holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            c, v, sub, several, fp = (np.concatenate([h[i] for h in held]) for i in range(5))
            fresh = np.ones(len(c), bool)
            fresh[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (sub[1:] != sub[:-1])
            start = np.flatnonzero(fresh)
            end = len(c) if last else int(start[-1])  # the last part may go on
            held, size = [(c[end:], v[end:], sub[end:], several[end:], fp[end:])], len(c) - end
            if not end:
                return
            c, v, sub, several, fp = (x[:end] for x in (c, v, sub, several, fp))
            start = start[start < end]
            root_of = np.repeat(start, np.diff([*start, end]))
            label = linked(Forest(fp, root_of), fp, root_of, np.arange(end), np.arange(end), radius)
            links = _links(fp, label)
            k = len(links[0])
            yield pa.record_batch([*links, *(pa.nulls(k, t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names)
            many = [(s, e) for s, e in zip(start, [*start[1:], end], strict=True) if several[s]]
            for s, e in many:
                row = [None, None, int(c[s]), int(v[s]), int(sub[s]), fp[s:e].tobytes(), (label[s:e] - s).astype(np.int32).tobytes()]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("c", "v", "sub", "several", "fp")]
            columns[4] = columns[4].view(np.uint64)
            held.append(tuple(columns))
            size += batch.num_rows
            if size >= HELD:
                yield from close(False)
        if size:
            yield from close(True)

    names = ["a", "b", "c", "v", "sub", "fps", "labels"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return shards.mapInArrow(trimmed(run), LINKS)


def tree_links(pairs: DataFrame, radius: int) -> DataFrame:
    """Links between the fingerprints ``fps`` of one part of a shard and the tree of another, ``tree``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            tree, below, fps, labels = (r[0] for r in rows_of(batch, "tree", "below", "fps", "labels"))
            nodes, own = np.frombuffer(tree, np.uint64), np.frombuffer(fps, np.uint64)
            n, both = len(nodes), np.concatenate([nodes, own])
            label = np.concatenate([np.frombuffer(below, np.int32), np.frombuffer(labels, np.int32) + n]).astype(np.int64)
            zero = np.zeros(n, np.int64)
            before = label.copy()
            label = linked(Forest(nodes, zero), own, np.zeros(len(own), np.int64), np.arange(n, len(both)), label, radius)
            moved = np.flatnonzero((label != before) & (before == np.arange(len(both))))  # components that were joined, by their first
            yield pa.record_batch([pa.array(both[label[moved]].view(np.int64)), pa.array(both[moved].view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(trimmed(run), "a long, b long")


def links_of(fps: DataFrame, distinct: int, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that join the same components as all pairs of ``fp``, which differ, within the radius."""
    spark = fps.sparkSession
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for c, m in enumerate(masks(distinct, radius))])
    each = fps.select("fp", F.explode(keys).alias("k")).select("k.c", "k.v", "fp")
    hot = written(each.groupBy("c", "v").agg(F.count("*").alias("n")).where(F.col("n") > TREE), "hot-shards")
    one = F.lit(1).cast("long")
    parts = F.ceil(F.coalesce(F.col("n"), one) / F.lit(TREE // 2))  # half full on the average, as a hash fills them unevenly
    sized = each.withColumn("n", one) if hot.isEmpty() else each.join(hot, ["c", "v"], "left")
    dealt = sized.select("c", "v", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("sub"), (parts > 1).alias("several"), "fp")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "c", "v", "sub").sortWithinPartitions("c", "v", "sub", "fp")
    found = written(shard_links(dealt, radius), "shard-links")
    links = found.where("a IS NOT NULL").select("a", "b")
    trees = found.where("fps IS NOT NULL").select("c", "v", F.col("sub").alias("tree_sub"), F.col("fps").alias("tree"), F.col("labels").alias("below"))
    told = trees.agg(F.sum(F.length("tree") + F.length("below")).alias("n")).first()
    if told.n:
        trees = F.broadcast(trees) if told.n <= MOST_TREE_BYTES else trees
        pairs = found.where("fps IS NOT NULL").select("c", "v", "sub", "fps", "labels").repartition(tasks, "c", "v", "sub").join(trees, ["c", "v"]).where("sub < tree_sub")
        links = links.unionByName(tree_links(pairs, radius))
    out = written(links.distinct(), "links")
    discard(spark, hot, found)
    return out


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Null and empty texts, and those without words, have the fingerprint zero, which is linked like any other.  Texts of any
    length count whole.  Rows that repeat, and rows of equal fingerprints, are linked; null ids have no part in the smallest
    id of a component, and one of null ids alone has none.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs), "fingerprints")
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    text = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    links = links_of(each.select("fp"), each.count())
    labels = components(links.select(text("a").alias("a"), text("b").alias("b")))
    named = each.select(text("fp").alias("fingerprint"), "doc_id").join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.withColumn("label", F.coalesce("label", "fingerprint"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = named.join(least, "label").select("fingerprint", "component_id")
    out = written(prints.select("doc_id", text("fp").alias("fingerprint")).join(placed, "fingerprint").select("doc_id", "fingerprint", "component_id"), "simhash-groups")
    discard(spark, prints, each, links, labels)
    return out


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
