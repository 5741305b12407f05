"""Vector codes by exact integer Lloyd rounds over heaps.

A component ``x`` is the integer ``floor(256 x)``; a vector is cut into ``PARTS`` equal parts, each with a codebook of up to
``ENTRIES`` entries that starts as that part of the vectors with the smallest ids.

1. Vectors are held in written blocks of ``BLOCK`` vectors.  A block has, for each part position and entry, a heap of the
   parts assigned to the entry, keyed by slack: the distance to the second-nearest entry (lower bound) minus that to the
   own one (upper bound), plus what the entry had drifted by then.
2. When entries move, the slack of a part of entry ``a`` shrinks by the drift of ``a`` plus the greatest drift of another
   entry at most.  The sum of these over all rounds is the entry's cumulative drift.  A round pops the parts whose key it has
   reached, compares them with all entries, and pushes them onto the heap of their new entry; no other part is looked at.
   Bounds are rounded so that a part that is not popped has one nearest entry, the one it is assigned to.
3. A task sends the sums of the parts that changed their entry, so a round shuffles an array for each task whatever the input,
   and codebooks of ``ENTRIES`` integers a dimension are all that is broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, rows_of, table, trimmed, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
BLOCK = 4096
#: Components at or beyond this, as 64-bit sums of squares could not hold their distances.
TOO_LARGE = 1 << 18
_MARGIN = 1e-12

STATE = "vec_ids array<long>, labels array<int>, vectors binary, codes binary, keys binary, rows binary, sizes binary, sums array<long>, popped long"
_NAMES = ["vec_ids", "labels", "vectors", "codes", "keys", "rows", "sizes", "sums", "popped"]
_TYPES = [pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.int64()]


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of ``n`` parts to all entries, exact."""
    out = np.zeros((len(parts), len(book)), np.int64)
    for d in range(parts.shape[1]):
        gap = parts[:, d, None].astype(np.int64) - book[None, :, d]
        out += gap * gap
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, of equally near ones the first, and a slack that is never too large."""
    square = distances(parts, book)
    code = square.argmin(axis=1)
    rows = np.arange(len(parts))
    upper = np.sqrt(square[rows, code].astype(np.float64))
    if len(book) == 1:
        return code, np.full(len(parts), np.inf)
    square[rows, code] = np.iinfo(np.int64).max
    lower = np.sqrt(square.min(axis=1).astype(np.float64))
    return code, lower - upper - _MARGIN * (lower + upper)


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry, how much the slack of its parts shrinks at most: its own way and the longest way of another."""
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + _MARGIN)
    if len(way) == 1:
        return way
    top = np.argsort(way)[-2:]
    other = np.where(np.arange(len(way)) == top[1], way[top[0]], way[top[1]])
    return (way + other) * (1 + _MARGIN)


def _sums(parts: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """Sums of the parts of each entry, and their number behind them."""
    out = np.zeros((entries, parts.shape[1] + 1), np.int64)
    np.add.at(out, codes, np.column_stack([parts.astype(np.int64), np.ones(len(parts), np.int64)]))
    return out


def _row(values: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)


def _packed(heaps: list[list[list[tuple[float, int]]]]) -> list[bytes]:
    """Keys, rows and sizes of the heaps of all parts and entries, one heap after another in heap order."""
    flat = [heap for part in heaps for heap in part]
    keys = np.array([k for heap in flat for k, _ in heap], np.float64)
    rows = np.array([i for heap in flat for _, i in heap], np.int32)
    return [keys.tobytes(), rows.tobytes(), np.array([len(heap) for heap in flat], np.int32).tobytes()]


def start(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of all vectors of ``vec_id, label, embedding``, assigned by comparing them with all entries, and a row of sums for each task."""
    n_parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, entries, width + 1), np.int64)
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            ids, labels = rows_of(batch, "vec_id", "label")
            flat = batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
            vectors = np.floor(flat * SCALE).astype(np.int32).reshape(len(ids), n_parts, width)
            codes, heaps = np.zeros((len(ids), n_parts), np.uint8), []
            for p in range(n_parts):
                code, slack = nearest(vectors[:, p], books[p])
                codes[:, p] = code
                total[p] += _sums(vectors[:, p], code, entries)
                own: list[list[tuple[float, int]]] = [[] for _ in range(entries)]
                for i, (c, s) in enumerate(zip(code.tolist(), slack.tolist(), strict=True)):
                    own[c].append((s, i))
                for heap in own:
                    heapq.heapify(heap)
                heaps.append(own)
            yield _row([ids, labels, vectors.tobytes(), codes.tobytes(), *_packed(heaps), None, len(ids) * n_parts])
        yield _row([None] * 7 + [total.ravel().tolist(), None])

    return kept.select("vec_id", "label", "embedding").mapInArrow(trimmed(run), STATE)


def again(blocks: DataFrame, books: np.ndarray, drifted: np.ndarray) -> DataFrame:
    """The blocks after a move of the entries to ``books``; ``drifted``: each entry's cumulative drift.  Sums are of changes."""
    n_parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, entries, width + 1), np.int64)
        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            ids, labels, vectors, codes, keys, rows, sizes = (c[0] for c in rows_of(batch, *_NAMES[:7]))
            vectors_ = np.frombuffer(vectors, np.int32).reshape(len(ids), n_parts, width)
            codes_ = np.frombuffer(codes, np.uint8).reshape(len(ids), n_parts).copy()
            pairs = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(rows, np.int32).tolist(), strict=True))
            ends = np.cumsum(np.frombuffer(sizes, np.int32)).reshape(n_parts, entries)
            heaps, popped = [], 0
            for p in range(n_parts):
                own = [pairs[end - size : end] for end, size in zip(ends[p].tolist(), np.frombuffer(sizes, np.int32)[p * entries : (p + 1) * entries].tolist(), strict=True)]
                violated: list[int] = []
                for heap, far in zip(own, drifted[p].tolist(), strict=True):
                    while heap and heap[0][0] - far <= _MARGIN * (abs(heap[0][0]) + far):
                        violated.append(heapq.heappop(heap)[1])
                heaps.append(own)
                if not violated:
                    continue
                popped += len(violated)
                some = np.array(violated)
                old = codes_[some, p].astype(np.int64)
                code, slack = nearest(vectors_[some, p], books[p])
                codes_[some, p] = code
                for i, c, s in zip(violated, code.tolist(), (slack + drifted[p][code]).tolist(), strict=True):
                    heapq.heappush(own[c], (s, i))
                moved = code != old
                total[p] += _sums(vectors_[some[moved], p], code[moved], entries) - _sums(vectors_[some[moved], p], old[moved], entries)
            yield _row([ids, labels, vectors, codes_.tobytes(), *_packed(heaps), None, popped])
        yield _row([None] * 7 + [total.ravel().tolist(), None])

    return blocks.mapInArrow(trimmed(run), STATE)


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector."""
    n_parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            ids, labels, vectors, codes = (c[0] for c in rows_of(batch, *_NAMES[:4]))
            vectors_ = np.frombuffer(vectors, np.int32).reshape(len(ids), n_parts, width).astype(np.int64)
            codes_ = np.frombuffer(codes, np.uint8).reshape(len(ids), n_parts)
            gap = vectors_ - books[np.arange(n_parts)[None, :], codes_]
            digits = codes.hex()
            code = [digits[2 * n_parts * i : 2 * n_parts * (i + 1)] for i in range(len(ids))]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(code, pa.string()), pa.array((gap * gap).sum(axis=(1, 2)))], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(trimmed(run), "vec_id long, label int, code string, error long")


def moved_entries(sums: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Entries at the floored means of their parts; those without parts stay."""
    n = sums[..., -1:]
    return np.where(n > 0, sums[..., :-1] // np.maximum(n, 1), books)


def totals(blocks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The tasks' sums, added up by place: one number for each entry's dimension, and its number of parts."""
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in blocks.where("sums IS NOT NULL").select(F.posexplode("sums").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).collect():
        out[r.place] = r.x
    return out.reshape(shape)


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all are finite and not too large."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE)), F.lit(False))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of each kept row of ``vec_id, embedding, label``, and the codebooks.

    Rows go whose vector is null or empty, has null or non-finite components or one of 2**18 or more (squared distances
    of such would not fit a long), or another number of components than the first kept one, the smallest id whose number
    ``parts`` divides.  Equal ids start codebooks in the order of their vectors and are all coded; a null id comes last.
    With fewer vectors than ``entries`` codebooks are shorter.  Without any there are no rows and no entries.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    rows = rows.where(usable(F.col("embedding")) & (F.size("embedding") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = rows.orderBy(*order).select(F.size("embedding").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, label int, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    kept = rows.where(F.size("embedding") == first.n)
    some = np.array([r.embedding for r in kept.orderBy(*order).select("embedding").limit(entries).collect()])
    books = np.floor(some * SCALE).astype(np.int64).reshape(len(some), parts, -1).transpose(1, 0, 2)
    drifted = np.zeros(books.shape[:2])
    blocks = written(start(kept, books), "vector-blocks")
    sums = totals(blocks, (*books.shape[:2], books.shape[2] + 1))
    for _ in range(rounds):
        new = moved_entries(sums, books)
        drifted += np.array([drift(a, b) for a, b in zip(books, new, strict=True)])
        books = new
        after = written(again(blocks.where("vec_ids IS NOT NULL"), books, drifted), "vector-blocks")
        sums += totals(after, sums.shape)
        discard(vectors.sparkSession, blocks)
        blocks = after
    out = written(coded(blocks.where("vec_ids IS NOT NULL"), books), "vector-codes")
    discard(vectors.sparkSession, blocks)
    return out, books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels, nulls together; summed up before labels are dealt out."""
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """Every part with every entry, round by round."""
    assign = lambda book: f"SELECT v, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.v, x.p, c.e, list_sum(list_transform(list_zip(x.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN {book} c USING (p)) GROUP BY v, p"
    def update(n: int) -> str:
        return f"""
    a{n} AS ({assign(f"c{n}")}),
    m{n} AS (SELECT p, e, k, CAST(sum(y) AS HUGEINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(w) AS y, unnest(range(len(w))) AS k FROM a{n} JOIN x USING (v, p)) GROUP BY p, e, k),
    u{n} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS w FROM m{n} GROUP BY p, e),
    c{n + 1} AS (SELECT c.p, c.e, coalesce(u.w, c.w) AS w FROM c{n} c LEFT JOIN u{n} u USING (p, e)),"""
    return f"""
    WITH k0 AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {TOO_LARGE})) = 0),
    k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, f) AS v FROM k0 WHERE len(f) = (SELECT len(f) FROM k0 ORDER BY vec_id NULLS LAST, f LIMIT 1)),
    i AS (SELECT v, list_transform(f, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS w FROM k),
    x AS (SELECT v, p, w[p * (len(w) // {PARTS}) + 1:(p + 1) * (len(w) // {PARTS})] AS w FROM i, range({PARTS}) r(p)),
    c0 AS (SELECT p, v - 1 AS e, w FROM x WHERE v <= {ENTRIES}),{"".join(update(n) for n in range(ROUNDS))}
    a AS ({assign(f"c{ROUNDS}")}),
    o AS (SELECT v, string_agg(substr('0123456789abcdef', CAST(e // 16 AS INT) + 1, 1) || substr('0123456789abcdef', CAST(e % 16 AS INT) + 1, 1), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY v),
    s AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s.h AS codebooks_sha256 FROM k JOIN o USING (v), s"""
