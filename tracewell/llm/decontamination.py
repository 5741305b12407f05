"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame expressions only.

Words are lower-cased runs of letters and digits.  An item of ``k`` five-word shingles (an item of fewer words is one
shingle) is compared with windows of ``k`` shingles of a document:

1. A document is kept when some shingle of it is one of the items'; nothing else can be similar to an item.  Hashes of
   shingles stay in one array per document, so this is a projection and a filter.
2. Windows are fingerprinted where they hold 0.8 ``k`` shingles of an item: 63 bits, each the majority over the window's
   shingle occurrences (weight: how often a shingle occurs).  Places of shared shingles give the starts of such windows
   directly, so two that lie far apart bring in nothing between them.
3. Fingerprints meet those of the items they share shingles with in 21 blocks of 3 bits.  Two that differ in at most
   ``RADIUS`` = 20 bits agree on a block, so none within the radius is missed.  A radius this wide makes blocks alone a poor
   index (two random fingerprints agree on 2.6 of 21), so the item is part of the key: a window meets each item at most
   21 times, and no window meets items it shares too little with.
4. What is within the radius is verified: shared over joint shingle weight is 0.8 or more.

At similarity 0.8 fingerprints of 63 bits differ in 9.5 bits on average (deviation 3), so the radius leaves out about
one borderline window in several thousand; at 0.9, none to speak of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

SHINGLE, RADIUS, LEAST, BASE = 5, 20, 8, 10
_LANES = 1 | 1 << 21 | 1 << 42
RESULT = "doc_id long, item_id long, similarity double, start_word long, n_shingles long"
#: Item shingles up to this number are looked up in a set; more are joined.
MOST_IN_SET = 50_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(g: int, name: str = "words") -> Column:
    """64-bit hashes of every run of ``g`` words."""
    at = lambda i: F.xxhash64(*[F.get(name, i + j) for j in range(g)])
    return F.when(F.size(name) >= g, F.transform(F.sequence(F.lit(0), F.size(name) - g), at)).otherwise(F.array().cast("array<bigint>"))


def _sums(h: str) -> list[Column]:
    """21 sums of three lanes each: how many hashes have each of 63 bits."""
    return [F.sum(F.shiftrightunsigned(h, c).bitwiseAND(F.lit(_LANES))).alias(f"s{c}") for c in range(21)]


def _fingerprint(k: str) -> Column:
    more = (F.lit((1 << 20) - 1) - F.floor(F.col(k) / 2)) * F.lit(_LANES)
    out = F.lit(0).cast("long")
    for c in range(21):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"s{c}") + more, 20).bitwiseAND(F.lit(_LANES)), c))
    return out


def _blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("b"), F.shiftrightunsigned(fp, 3 * b).bitwiseAND(F.lit(7)).alias("v")) for b in range(21)])


def _shared(a: str, b: str) -> Column:
    """Size of the multiset intersection of two arrays."""
    both = F.array_intersect(a, b)
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x))))


def _starts() -> Column:
    """Starts of all windows of ``k`` that hold ``least`` of the ascending places ``p``; a window ends at the text's end at the latest.

    A window holds ``least`` places where it begins after ``p[i + least - 1] - k`` and not after ``p[i]``; after ``p[i - 1]``,
    as earlier ones belong to the place before.
    """
    ranges = F.transform(
        F.sequence(F.lit(0), F.size("p") - F.col("least")),
        lambda i: F.struct(F.greatest(F.get("p", i + F.col("least") - 1) - F.col("k") + 1, F.coalesce(F.get("p", i - 1) + 1, F.lit(0)), F.lit(0)).alias("lo"), F.get("p", i).alias("hi")),
    )
    held = F.filter(ranges, lambda x: x["lo"] <= x["hi"])
    clipped = F.transform(held, lambda x: F.sequence(F.least(x["lo"], F.col("last")), F.least(x["hi"], F.col("last"))))
    return F.array_distinct(F.flatten(clipped))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_shingles``: for each document row and item its best window of 0.8 or more.

    docs: ``doc_id, text``; items: ``item_id, text``.  Null and empty texts match nothing.  Of equally similar windows the
    first counts.  A row that repeats another is reported as often as it is there.  Items that repeat are reported each.
    Texts of any length are compared whole; empty tables give no rows.
    """
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    own = own.withColumn("g", F.least(F.size("words"), F.lit(SHINGLE)))
    out = spark.createDataFrame([], RESULT)
    for g in sorted(r.g for r in own.select("g").distinct().collect()):
        out = out.unionByName(_by_shingle(docs, own.where(F.col("g") == g), g))
    return out


def _by_shingle(docs: DataFrame, own: DataFrame, g: int) -> DataFrame:
    own = own.withColumn("want", shingles(g)).select("item_id", "want", F.size("want").alias("k"), F.monotonically_increasing_id().alias("n"))
    own = written(own, "items")
    each = own.select("n", "k", F.explode("want").alias("h"))
    hashes = each.select("h").distinct()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("r"), words(F.col("text")).alias("words"))
    read = read.withColumn("have", shingles(g)).select("doc_id", "r", "have")  # the row number keeps the filter below from being computed word by word before this
    few = [r.h for r in hashes.limit(MOST_IN_SET + 1).collect()]
    if len(few) <= MOST_IN_SET:
        read = read.where(F.expr(f"exists(have, x -> x IN ({', '.join(f'{h}L' if h > -(1 << 63) else '(-9223372036854775807L - 1L)' for h in few)}))"))
    else:
        numbered = written(read, "all-shingles")
        met = numbered.select("r", F.explode("have").alias("h")).join(hashes, "h", "left_semi").select("r").distinct()
        read = numbered.join(met, "r", "left_semi")
    read = written(read, "shingled")

    hits = read.select("r", F.posexplode("have").alias("p", "h")).join(each.distinct(), "h")
    spans = hits.groupBy("r", "n", "k").agg(F.sort_array(F.collect_list("p")).alias("p")).withColumn("least", F.ceil(F.col("k") * LEAST / BASE).cast("int")).where(F.size("p") >= F.col("least"))
    windows = read.join(spans, "r").withColumn("last", F.greatest(F.size("have") - F.col("k"), F.lit(0)))
    windows = windows.select("r", "n", "k", F.explode(_starts()).alias("s"), "have").select("r", "n", "k", "s", F.expr("slice(have, s + 1, k)").alias("w"))
    windows = written(windows, "windows")

    prints = windows.select("r", "n", "s", F.size("w").alias("kw"), F.explode("w").alias("h")).groupBy("r", "n", "s", "kw").agg(*_sums("h")).select("r", "n", "s", _fingerprint("kw").alias("fp"))
    marks = each.groupBy("n", "k").agg(*_sums("h")).select("n", _fingerprint("k").alias("mark"))
    left = prints.select("r", "n", "s", "fp", F.explode(_blocks(F.col("fp"))).alias("x")).select("r", "n", "s", "fp", "x.*")
    right = marks.select("n", "mark", F.explode(_blocks(F.col("mark"))).alias("x")).select("n", "mark", "x.*")
    near = left.join(right, ["n", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("mark"))) <= RADIUS)
    near = near.select("r", "n", "s").distinct()

    checked = near.join(windows, ["r", "n", "s"]).join(own.select("n", "item_id", "want"), "n").withColumn("both", _shared("w", "want"))
    checked = checked.withColumn("joint", F.size("w") + F.size("want") - F.col("both")).where(F.col("both") * BASE >= F.col("joint") * LEAST)
    best = checked.groupBy("r", "n", "item_id", "k").agg(F.max(F.struct((F.col("both") / F.col("joint")).alias("sim"), (-F.col("s")).alias("s"))).alias("b"))
    found = best.join(read.select("r", "doc_id"), "r").select("doc_id", "item_id", F.col("b.sim").alias("similarity"), (-F.col("b.s")).cast("long").alias("start_word"), F.col("k").cast("long").alias("n_shingles"))
    found = written(found, "contaminated")
    discard(docs.sparkSession, own, read, windows)
    return found


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """Every window of every document that shares a shingle with an item, by counting; items of five words or more."""
    w = lambda t, i: f"SELECT {i}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {t}"
    return f"""
    WITH d AS ({w("documents", "row_number() OVER () AS r, doc_id")}), i AS ({w("benchmark", "item_id")}),
    ds AS (SELECT r, doc_id, unnest(range(0, len(w) - 4)) AS p, w FROM d WHERE len(w) >= 5),
    dh AS (SELECT r, doc_id, p, w[p + 1:p + 5] AS h FROM ds),
    bs AS (SELECT item_id, len(w) - 4 AS k, unnest(range(0, len(w) - 4)) AS q, w FROM i WHERE len(w) >= 5),
    bh AS (SELECT item_id, k, q, w[q + 1:q + 5] AS h FROM bs),
    m AS (SELECT DISTINCT r, p, item_id, k FROM dh JOIN bh USING (h)),
    n AS (SELECT r, len(w) - 4 AS n FROM d),
    c AS (SELECT DISTINCT r, item_id, k, n, greatest(0, least(unnest(range(p - k + 1, p + 1)), n - k)) AS s FROM m JOIN n USING (r)),
    x AS (SELECT c.r, c.item_id, c.k, c.s, least(c.k, c.n) AS kw, dh.h, count(*) AS nw FROM c JOIN dh ON dh.r = c.r AND dh.p BETWEEN c.s AND c.s + c.k - 1 GROUP BY ALL),
    b AS (SELECT item_id, h, count(*) AS ni FROM bh GROUP BY ALL),
    y AS (SELECT x.r, x.item_id, x.k, x.s, x.kw, sum(least(nw, ni)) AS joint FROM x JOIN b ON x.item_id = b.item_id AND x.h = b.h GROUP BY ALL),
    z AS (SELECT r, item_id, k, s, joint / (kw + k - joint) AS sim FROM y WHERE 10 * joint >= 8 * (kw + k - joint)),
    o AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY sim DESC, s) AS o FROM z)
    SELECT d.doc_id, o.item_id, CAST(o.sim AS DOUBLE) AS similarity, CAST(o.s AS BIGINT) AS start_word, CAST(o.k AS BIGINT) AS n_shingles FROM o JOIN d USING (r) WHERE o.o = 1"""
