"""Exact n-gram Jaccard join by grouped prefixes, down to connected groups of documents.

1. One pass over the texts counts shingles in ``2**SKETCH`` buckets over all documents.
2. A second pass orders each set by (bucket count, hash) and takes its prefix: ``n - ceil(0.8 n) + 1`` shingles.  Any
   order all sets share finds every pair of similarity 0.8; this one puts what many documents hold last, so that common
   passages and lines are in a prefix only where little else is.  Documents of one size and prefix are a group, documents
   of one set a node of it.  A group posts its prefix once per task; postings travel as packed arrays, split by shingle.
3. Groups with a common shingle, sizes within 0.8, and the shingle at places that leave room for enough others, are
   candidates.  A run of groups that share a shingle is paired off in full up to ``RUN``; in a longer run each meets one
   pivot first.
4. Pairs of groups are expanded to pairs of their nodes, and the nodes of one group paired, where that gives at most
   ``RUN * RUN`` pairs.  Larger ones are runs of nodes, like the long runs of step 3, whose groups are expanded too.
5. Candidates are verified on whole sets.
6. What these links leave of a long run in different components is paired in later rounds: with a pivot, then, for what is
   still apart, all of it.  Links inside a component are not looked for, as they change no component; those found join
   components, not nodes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, release, rows_of, table, texts, trimmed, written
from .components import components
from .shingling import set_hash, shingle_sets
from .tokenizing import forget

SKETCH, SLICES = 20, 64
RUN = 24
#: Rounds of pivots before everything left in a long run is paired.
ROUNDS = 3
#: Parts that the members of a hot shingle are dealt out in.
SALTS = 16
#: Postings a task gathers before it hands them on, and parts they are split into per shuffle partition.
FLUSH, PARTS = 1 << 18, 4
#: Members of a long run compared at a time, and in one task.
TILE, BLOCK = 128, 2048
#: Names of nodes, of about 30 bytes, that are sent to every executor at most.
FEW = 100_000
#: Pairs whose whole sets are compared at once, as a pass over briefs would cost more than it spares.
AT_ONCE = 4096
#: Documents a task turns into sets at a time.
DOCS = 1024


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The least shared shingles of linked sets of these sizes: 100 i >= 80 (na + nb - i)."""
    return -(-80 * (na.astype(np.int64) + nb) // 180)


def prefix_length(n: int) -> int:
    return n - -(-8 * n // 10) + 1


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()  # workers are used again: one may still hold an earlier operator's chunks
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            yield batch.slice(at, DOCS)


def sets_pass(docs: DataFrame) -> DataFrame:
    """Slices of each task's bucket counts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH, np.uint32)
        for batch in slices(batches):
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")))
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype(np.uint32)
        width = len(counts) // SLICES
        packed = [zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(SLICES)]
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], ["n", "counts"])

    return docs.select("text").mapInArrow(trimmed(run), "n int, counts binary")


def bucket_counts(first: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts: 4 MB whatever the input."""
    width = (1 << SKETCH) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*rows_of(batch, "n", "counts"), strict=True):
                own = total.setdefault(i, np.zeros(width, np.uint32))
                own += np.frombuffer(zlib.decompress(packed), np.uint32)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], ["n", "counts"])

    slices = first.repartition(SLICES, "n").mapInArrow(add, "n int, counts binary").collect()
    out = np.zeros(1 << SKETCH, np.uint32)
    for r in slices:
        out[r.n * width : (r.n + 1) * width] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
    return out


def planes(x: np.ndarray) -> bytes:
    """First bytes of 32-bit numbers, then second ones and so on: of small numbers most are zeros in a row, which shuffles and tables store in little room."""
    return x.view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def postings(docs: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """Rows of ``part, payload``: shingle, prefix hash, set size and place in the order of every prefix entry, as four arrays
    one after another; and, with no payload and parts below zero in turn, ``doc_id, n, g, h`` of every document: size and
    hashes of prefix and set."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heat = shared.value
        held: list[tuple[np.ndarray, int, int]] = []
        seen: set[tuple[int, int]] = set()
        size = rows = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(t) for t, _, _ in held]
            token = np.concatenate([t for t, _, _ in held])
            node = np.repeat(np.array([h for _, h, _ in held], np.int64), lengths)
            n = np.repeat(np.array([n for _, _, n in held], np.int32), lengths)
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            part = (token % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            token, node, n, place = token[order], node[order], n[order], place[order]
            keys, at = np.unique(part[order], return_index=True)
            ends = [*at[1:], len(token)]
            payload = [token[a:b].tobytes() + node[a:b].tobytes() + planes(n[a:b]) + planes(place[a:b]) for a, b in zip(at, ends, strict=True)]
            k = len(keys)
            return pa.record_batch([pa.array(keys, pa.int64()), pa.array(payload, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)

        for batch in slices(batches):
            own = []
            for s in shingle_sets(batch.column(batch.schema.get_field_index("text"))):
                if not len(s):
                    own.append((0, 0, 0))
                    continue
                order = np.lexsort((s, heat[(s >> np.uint64(64 - SKETCH)).astype(np.int64)]))[: prefix_length(len(s))]
                prefix = s[order]
                key = (len(s), set_hash(np.sort(prefix)))
                own.append((*key, set_hash(s)))
                if key in seen:
                    continue
                if len(seen) < 1 << 16:
                    seen.add(key)
                held.append((prefix, key[1], key[0]))
                size += len(order)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
            if own:
                n, g, h = zip(*own, strict=True)
                turn = -1 - np.arange(rows, rows + len(own)) % parts
                rows += len(own)
                yield pa.record_batch([pa.array(turn, pa.int64()), pa.nulls(len(own), pa.binary()), batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int32()), pa.array(g, pa.int64()), pa.array(h, pa.int64())], names)
        if held:
            yield flush()

    names = ["part", "payload", "doc_id", "n", "g", "h"]
    return docs.mapInArrow(trimmed(run), "part long, payload binary, doc_id long, n int, g long, h long")


#: The kind of rows that stand for documents among candidates.
DOC = -1
PAIRS = "kind int, token long, na int, ha long, nb int, hb long"


def _rows(kind: int, token: np.ndarray, na: np.ndarray, ha: np.ndarray, nb: np.ndarray, hb: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(na), kind, np.int32)), pa.array(token.view(np.int64)), pa.array(na.astype(np.int32)), pa.array(ha), pa.array(nb.astype(np.int32)), pa.array(hb)], ["kind", "token", "na", "ha", "nb", "hb"])


def _unique(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows that differ."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return [c[fresh] for c in columns]


def may_link(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes, with a shingle at these places of their orders, can be a pair to find by that shingle.

    Sets that share ``k = needed(na, nb)`` or more have a common shingle within the first ``na - k + 1`` and ``nb - k + 1``
    of their orders, so a pair is lost by none of the places it is turned down at.
    """
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    k = needed(na, nb)
    return (pa_ <= na - k) & (pb <= nb - k) & (10 * np.minimum(na, nb) >= 8 * np.maximum(na, nb))


def pair_up(token: np.ndarray, h: np.ndarray, n: np.ndarray, place: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Candidates (kind 0) of all runs of one part, and the members of long runs (kind 1, with the place for ``nb``)."""
    token, n, h, place = _unique(token, n, h, place)
    same = token[1:] == token[:-1]
    if not same.any():
        return
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    length = np.diff(np.concatenate([start, [len(token)]]))
    keep = np.repeat(length > 1, length)
    token, n, h, place, length = token[keep], n[keep], h[keep], place[keep], length[length > 1]
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    size, first = np.repeat(length, length), np.repeat(start, length)
    short = np.flatnonzero(size <= most)
    found = []
    for d in range(1, most):
        a = short[short - first[short] + d < size[short]]
        if not len(a):
            break
        found.append((a, a + d))
    long = np.flatnonzero(size > most)
    if len(long):
        pivot = long.copy()
        for s, m in zip(start[length > most], length[length > most], strict=True):
            own = slice(np.searchsorted(long, s), np.searchsorted(long, s + m))
            pivot[own] = s + np.searchsorted(n[s : s + m], -(-8 * n[s : s + m].astype(np.int64) // 10))
        apart = pivot != long
        found.append((pivot[apart], long[apart]))
        yield _rows(1, token[long], n[long], h[long], place[long], h[long])
    a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    fits = may_link(n[a], place[a], n[b], place[b])
    a, b = a[fits], b[fits]
    if len(a):
        na, ha, nb, hb = _unique(n[a], h[a], n[b], h[b])
        yield _rows(0, np.zeros(len(na), np.uint64), na, ha, nb, hb)


def candidates(posted: DataFrame) -> DataFrame:
    """Pairs of groups and long runs, and a row of kind ``DOC`` for each document: its id as token, size, and hashes of prefix and set."""
    most = RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            cut = [(len(p) // 24, p) for p in held]
            token = np.concatenate([np.frombuffer(p, np.uint64, k) for k, p in cut])
            node = np.concatenate([np.frombuffer(p, np.int64, k, 8 * k) for k, p in cut])
            n, place = (np.concatenate([of_planes(p[w * k : (w + 4) * k]) for k, p in cut]) for w in (16, 20))
            yield from pair_up(token, node, n, place, most)

        for batch in batches:
            known = batch.filter(pc.less(batch.column("part"), 0))
            if known.num_rows:
                doc_id, n, g, h = (known.column(c) for c in ("doc_id", "n", "g", "h"))
                yield pa.record_batch([pa.repeat(pa.scalar(DOC, pa.int32()), len(n)), doc_id, n, g, n, h], ["kind", "token", "na", "ha", "nb", "hb"])
            for key, payload in zip(*rows_of(batch.filter(pc.greater_equal(batch.column("part"), 0)), "part", "payload"), strict=True):
                if key != part and held:
                    yield from close()
                    held = []
                part = key
                held.append(payload)
        if held:
            yield from close()

    return posted.mapInArrow(trimmed(run), PAIRS)


def node(n: str, h: str):
    return F.concat_ws(":", F.lpad(F.col(n).cast("string"), 10, "0"), F.col(h).cast("string"))


def shared(x: bytes, y: bytes, kind: type) -> int:
    """Size of the multiset intersection of two sorted arrays."""
    x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
    if len(x) > len(y):
        x, y = y, x
    if kind is np.uint64:
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return int((y[at] == x).sum())
    a, na = np.unique(x, return_counts=True)
    b, nb = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum())


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``a, b``, those whose sets link.  sets: ``node, brief, members``.

    ``brief`` has two bytes of each member: what two of them share is never less than what the sets share, so most pairs
    that do not link are told by a quarter of the bytes.  Whole sets decide on the others.
    """

    def check(column: str, kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width = np.dtype(kind).itemsize
            for batch in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
                out = []
                for a, b, x, y in zip(*rows_of(batch, "a", "b", "x", "y"), strict=True):
                    both = shared(x, y, kind)
                    if 100 * both >= 80 * ((len(x) + len(y)) // width - both):
                        out.append((a, b))
                yield pa.record_batch([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], ["a", "b"])

        def step(rows: DataFrame) -> DataFrame:
            sets = those_of(rows, column)
            left = rows.join(sets.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
            return left.join(sets.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a string, b string")

        return step

    def those_of(rows: DataFrame, column: str) -> DataFrame:
        """The sets that the pairs name; so far as these are few, the others are passed over where they lie."""
        names = rows.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        names = F.broadcast(names) if 2 * rows.count() <= FEW or names.count() <= FEW else names
        return sets.select("node", column).join(names, "node", "left_semi")

    at_once = pairs.count() <= AT_ONCE
    likely = pairs if at_once else written(check("brief", np.uint16)(pairs), "likely")
    links = written(check("members", np.uint64)(likely), "links")
    if not at_once:
        discard(pairs.sparkSession, likely)
    release(pairs.sparkSession)
    return links


def _spots(text: str, bits: int) -> tuple[int, int]:
    h = zlib.crc32(text.encode())
    return h % bits, (h * 0x9E3779B1 + zlib.adler32(text.encode())) % bits


def filter_bits(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter over ``doc_id``, and over ``doc_id`` with ``node``, of ``wanted``: 16 bits a row, from 128 KB to 16 MB whatever their number.

    What passes it wrongly is carried along and never used, so its fill affects cost alone.
    """
    size = min(1 << 27, max(1 << 20, 1 << (16 * wanted.count()).bit_length()))
    width = size // 8 // SLICES

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for doc_id, key in zip(*rows_of(batch, "doc_id", "node"), strict=True):
                bits[list(_spots(f"d{doc_id}", size) + _spots(f"{key}/{doc_id}", size))] = True
        packed = np.packbits(bits)
        yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(packed[i * width : (i + 1) * width].tobytes(), 1) for i in range(SLICES)], pa.binary())], ["n", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*rows_of(batch, "n", "bits"), strict=True):
                total[i] = total.get(i, np.zeros(width, np.uint8)) | np.frombuffer(zlib.decompress(packed), np.uint8)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], ["n", "bits"])

    out = np.zeros(size // 8, np.uint8)
    for r in wanted.mapInArrow(own, "n int, bits binary").repartition(SLICES, "n").mapInArrow(merge, "n int, bits binary").collect():
        out[r.n * width : (r.n + 1) * width] = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, brief, members`` for the nodes of ``wanted``: ``doc_id, node``, one document each, and perhaps a few others."""
    shared_bits = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared_bits.value, set()
        has = lambda text: all(bits[at >> 3] >> (7 - (at & 7)) & 1 for at in _spots(text, 8 * len(bits)))
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            some = [has(f"d{i}") for i in ids]
            batch = batch.filter(pa.array(some, pa.bool_()))
            out = []
            for doc_id, s in zip([i for i, x in zip(ids, some, strict=True) if x], shingle_sets(batch.column(batch.schema.get_field_index("text"))), strict=True):
                key = f"{len(s):010d}:{set_hash(s)}"
                if len(s) and key not in seen and has(f"{key}/{doc_id}"):
                    seen.add(key)
                    out.append((key, np.sort(s.astype(np.uint16)).tobytes(), s.tobytes()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["node", "brief", "members"])

    found = written(docs.mapInArrow(trimmed(run), "node string, brief binary, members binary"), "members")
    told = found.groupBy("node").count().agg(F.sum("count").alias("n"), F.count("*").alias("d"), F.max("count").alias("most")).first()
    if not told.n or told.most <= 4 and told.n <= 1.05 * told.d:
        return found  # a few nodes twice: their pairs are verified twice and count once
    once = written(found.dropDuplicates(["node"]), "members")
    discard(docs.sparkSession, found)
    return once


def runs(batches: Iterator[pa.RecordBatch], keys: int, *names: str) -> Iterator[list[tuple]]:
    """Rows that agree in the first ``keys`` columns, of rows sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*rows_of(batch, *names), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def incidence(briefs: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """How often each text has each value of the sorted array ``of``."""
    flat = np.concatenate(briefs)
    row = np.repeat(np.arange(len(briefs)), [len(x) for x in briefs])
    at = np.minimum(np.searchsorted(of, flat), len(of) - 1)
    own = of[at] == flat
    out = np.zeros((len(briefs), len(of)), np.float32)
    np.add.at(out, (row[own], at[own]), 1)
    return out


def tile_pairs(n: np.ndarray, place: np.ndarray, label: np.ndarray, block: np.ndarray, briefs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one run, in ascending order of ``n``, that may link: sizes, places, labels, blocks, and what their briefs share.

    A product of counts is never less than the smaller one, so the product of two tiles bounds all overlaps at once.
    """
    mixed = (block != block[0]).any()  # two blocks of one run: pairs inside a block are compared elsewhere
    for p in range(0, len(n), TILE):
        for q in range(p, len(n), TILE):
            if 10 * int(n[min(p + TILE, len(n)) - 1]) < 8 * int(n[q]):
                break
            a, b = np.arange(p, min(p + TILE, len(n))), np.arange(q, min(q + TILE, len(n)))
            i, j = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
            fits = (label[i] != label[j]) & (i < j) & may_link(n[i], place[i], n[j], place[j])
            if mixed:
                fits &= block[i] != block[j]
            if not fits.any():
                continue
            left, right = [briefs[x] for x in a], [briefs[x] for x in b]
            common = np.intersect1d(np.concatenate(left), np.concatenate(right))
            if not len(common):
                continue
            i, j = i[fits], j[fits]
            both = (incidence(left, common) @ incidence(right, common).T)[i - p, j - q].astype(np.int64)
            likely = both >= needed(n[i], n[j])
            if likely.any():
                yield i[likely], j[likely]


def all_pairs(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """From the same members, all pairs of different labels that sizes, places and briefs do not rule out.

    A run is compared inside a task, in tiles, so pairs that do not link are never rows.  A run of more than ``BLOCK``
    members is dealt out as pairs of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, 3, "token", "x", "y", "n", "h", "place", "label", "block", "brief"):
            _, x, y, n, h, place, label, block, brief = zip(*held, strict=True)
            n, h, place, block = (np.array(c, np.int64) for c in (n, h, place, block))
            if x[0] != y[0] and (block == block[0]).all():
                continue
            codes = np.unique(np.array(label), return_inverse=True)[1]
            texts_ = [np.frombuffer(t, np.uint16) for t in brief]
            for i, j in tile_pairs(n, place, codes, block, texts_):
                yield _rows(0, np.zeros(len(i), np.uint64), n[i], h[i], n[j], h[j])

    rows = apart.join(sets.select("node", "brief"), "node")
    many = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod("h", many).cast("int")).withColumn("z", F.explode(F.sequence(F.lit(0), many - 1)))
    rows = rows.withColumns({"x": F.least("block", "z"), "y": F.greatest("block", "z")})
    parts = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("token", "x", "y", "n", "h", "place", "label", "block", "brief").repartition(parts, "token", "x", "y").sortWithinPartitions("token", "x", "y", "n", "h")
    return dealt.mapInArrow(trimmed(run), PAIRS)


def expanded(found: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of nodes, and members ``token, n, h, place, node`` of long runs, from candidates among groups.

    groups: ``g, n, h, node``, a row for each node, with ``size``, the number of nodes of its group.
    """
    gpairs = found.where("kind = 0").select(node("na", "ha").alias("ga"), node("nb", "hb").alias("gb")).select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct()
    left, right = (groups.select(F.col("g").alias(f"g{x}"), F.col("node").alias(x)) for x in "ab")
    sizes = groups.groupBy("g").agg(F.max("size").alias("size")).where("size > 1")
    told = gpairs.join(sizes.select(F.col("g").alias("ga"), F.col("size").alias("sa")), "ga", "left").join(sizes.select(F.col("g").alias("gb"), F.col("size").alias("sb")), "gb", "left")
    told = written(told.select("ga", "gb", (F.coalesce("sa", F.lit(1)) * F.coalesce("sb", F.lit(1))).alias("product")), "group-pairs")
    few = told.where(F.col("product") <= RUN * RUN)
    pairs = few.join(left, "ga").join(right, "gb").select("a", "b")
    several = groups.where("size > 1")
    inside = several.where(F.col("size") <= RUN)
    pairs = pairs.unionByName(inside.select("g", F.col("node").alias("a")).join(inside.select("g", F.col("node").alias("b")), "g").where("a < b").select("a", "b"))
    member = lambda rows, token, place: rows.select(token.alias("token"), "n", "h", place.alias("place"), "node")
    first = F.lit(0)  # a place that rules nothing out
    whole = member(several.where(F.col("size") > RUN), F.xxhash64("g"), first)
    both = told.where(F.col("product") > RUN * RUN).select(F.explode(F.array("ga", "gb")).alias("g"), F.xxhash64("ga", "gb").alias("token"))
    both = member(both.join(groups, "g"), F.col("token"), first)
    runs_ = found.where("kind = 1").select("token", node("na", "ha").alias("g"), F.col("nb").alias("place"))
    long = member(runs_.join(groups, "g"), F.col("token"), F.col("place"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), written(long.unionByName(whole).unionByName(both), "run-members")


def apart_of(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Members of runs that are in several components, with the run's length ``m`` and one of them, ``pivot``.

    Runs are summed up before they are dealt out, and meet their members again in ``SALTS`` parts.
    """
    told = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    pivot = F.min_by(F.struct("n", "place", "node", "label"), F.xxhash64("node", F.lit(turn)))
    split = told.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), pivot.alias("pivot")).where("lo <> hi").select("token", "m", "pivot")
    split = split.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return told.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(split, ["token", "salt"]).select("token", "m", "pivot", "n", "h", "place", "node", "label")


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` between their components, which alone are joined: what they join keeps its members."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    told = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(told)
    onto = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    onto = F.broadcast(onto) if onto.count() <= FEW else onto
    moved = labels.join(onto, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    out = written(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
    discard(links.sparkSession, joined, labels)
    return out


def pivot_pairs(apart: DataFrame) -> DataFrame:
    """Pairs of each member with its run's pivot, if they may link and are in different components."""
    na, nb = F.col("n").cast("long"), F.col("pivot.n").cast("long")
    k = F.ceil(80 * (na + nb) / 180)
    fits = (F.col("label") != F.col("pivot.label")) & (F.col("place") <= na - k) & (F.col("pivot.place") <= nb - k) & (10 * F.least(na, nb) >= 8 * F.greatest(na, nb))
    return apart.where(fits).select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Null and empty texts have no shingles and are linked with nothing: their component is their own id.  Rows with equal
    sets are linked whatever their ids; null ids have no part in the smallest id of a component.  Sets are told apart by
    their size and a 64-bit hash, shingles by 64-bit hashes.  Texts of any length
    are hashed whole, piece by piece.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = texts(docs)
    first = written(sets_pass(own), "counts")
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = bucket_counts(first)
    discard(spark, first)
    release(spark)
    found = written(candidates(postings(own, counts, parts).repartition(parts // PARTS, "part").sortWithinPartitions("part")), "candidates")  # postings are in their shuffle alone
    release(spark)
    ids = written(found.where(F.col("kind") == DOC).select(F.col("token").alias("doc_id"), F.col("na").alias("n"), node("na", "hb").alias("node"), node("na", "ha").alias("g"), F.col("hb").alias("h")), "ids")
    each = written(ids.where("n > 0").groupBy("node", "g", "n", "h").agg(F.min("doc_id").alias("doc_id")), "nodes")
    sizes = each.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    nodes = written(each.join(sizes, "g", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long"))), "groups")
    discard(spark, each)
    pairs, members = expanded(found, nodes)
    todo = written(pairs, "pairs")
    discard(spark, found)
    wanted = todo.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    release(spark)
    sets = sets_of(own, nodes.select("node", "doc_id").join(wanted, "node"))
    links = verify(todo, sets)
    labels = components(links)
    left, before = members, None  # members of the runs that are still apart: what is joined never comes apart again
    for turn in range(ROUNDS + 1):
        apart = written(apart_of(left, labels, turn), "apart")
        if before is not None:
            discard(spark, before)
        left, before = apart.drop("m", "label", "pivot"), apart
        if apart.isEmpty():
            break
        if turn == ROUNDS:
            every = all_pairs(apart, sets).where("kind = 0").select(node("na", "ha").alias("a"), node("nb", "hb").alias("b"))
            todo = written(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        else:
            todo = written(pivot_pairs(apart), "pairs")
        more = verify(todo, sets)
        if not more.isEmpty():
            labels = with_links(labels, more)
        discard(spark, todo, more)
        release(spark)
    linked = nodes.join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = nodes.join(labels, "node", "left").join(linked, "label", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = ids.join(placed, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = written(out, "near-duplicates")
    discard(spark, ids, nodes, members, sets, links, labels)
    return out


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """Every pair of texts that shares a shingle, and the closure of links."""
    big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{big}', '{small}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT r, w[i:i + 4] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5) UNION ALL SELECT r, w FROM t WHERE len(w) BETWEEN 1 AND 4),
    n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    c AS (SELECT r, r AS m FROM t UNION SELECT l.b, c.m FROM c JOIN l ON c.r = l.a),
    g AS (SELECT c.r, min(o.doc_id) AS component_id FROM c JOIN t o ON o.r = c.m GROUP BY 1)
    SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.component_id FROM t JOIN g USING (r) LEFT JOIN n USING (r)"""
