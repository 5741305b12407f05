"""Importance resampling towards a target distribution, over a table of word positions; DataFrame expressions only.

1. Words of every text become rows of a position table by ``posexplode``; for orders above one, a window over the places of
   a document puts ``lead()`` words behind each.  A window holds ``CHUNK`` places and those that follow them at most, so a
   long document is several windows.
2. Features are hashed into buckets, counted over all documents and over all target texts.  Both counts have a row for a
   bucket at most, which bounds the table of gains that is broadcast.
3. Gains are joined to the features and summed for each document.  A document's rows lie together, so they are summed up
   before they are dealt out.
4. Weights get Gumbel noise from a hash of the document's id, and the highest scores are drawn: rows are sorted over all
   partitions and numbered within them, after the number of rows in the partitions before.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written

ORDERS, BUCKETS, SEED, LEAST_WORDS, PERCENT = (1, 1), 10_000, 2024, 20, 10
#: Places of a window, for orders above one.
CHUNK = 8192
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), BIG, SMALL), NO_WORD), lambda w: w != "")


def positions(rows: DataFrame) -> DataFrame:
    """``r, doc_id, n_words, pos, word`` of ``r, doc_id, text``; a text without words has one row with no place."""
    split = rows.select("r", "doc_id", words(F.col("text")).alias("words"))
    return split.select("r", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))


def features(places: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    """``r, doc_id, n_words, bucket`` for each run of ``orders[0]`` to ``orders[1]`` words, and a null bucket where none begins."""
    low, high = orders
    bucket = lambda gram: (F.crc32(gram) % buckets).cast("int").alias("bucket")
    if high == 1:
        return places.select("r", "doc_id", "n_words", bucket(F.col("word")))
    own = F.floor(F.col("pos") / CHUNK)
    reach = F.when((own > 0) & (F.col("pos") % CHUNK < high - 1), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = places.withColumns({"own": own, "chunk": F.explode(reach)})
    after = Window.partitionBy("r", "chunk").orderBy("pos")
    dealt = dealt.withColumns({f"next{k}": F.lead("word", k).over(after) for k in range(1, high)}).where(F.col("own").eqNullSafe(F.col("chunk")))
    run, grams = F.col("word"), []
    for k in range(1, high + 1):
        run = run if k == 1 else F.concat(run, F.lit(" "), F.col(f"next{k - 1}"))
        grams += [run] if k >= low else []
    each = F.explode_outer(F.filter(F.array(*grams), lambda g: g.isNotNull()))
    return dealt.select("r", "doc_id", "n_words", each.alias("gram")).select("r", "doc_id", "n_words", bucket(F.col("gram")))


def gains(rows: DataFrame, target: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    """``bucket, gain`` of every bucket that a document has: a thousand times the logarithm of the smoothed ratio, floored."""
    counted = lambda x, name: features(positions(x), orders, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))
    both = written(counted(rows, "s").join(counted(target, "t"), "bucket", "full"), "counts")
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    of = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double") + 1
    ratio = of("t") * F.lit(float((total.s or 0) + buckets)) / (of("s") * F.lit(float((total.t or 0) + buckets)))
    out = written(both.where("s IS NOT NULL").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), "gains")
    discard(rows.sparkSession, both)
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel variate, floored, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (``r, doc_id, score, wanted``) with ``rank``: 1, 2, ... for the drawn rows."""
    spark = scored.sparkSession
    order = [F.col("wanted").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("r")]
    dealt = written(scored.orderBy(*order).withColumn("part", F.spark_partition_id()), "by-score")
    in_part = sorted((x.part, x["count"]) for x in dealt.where("wanted").groupBy("part").count().collect())  # a row for each partition
    drawn = sum(n for _, n in in_part) * percent // 100
    before = list(accumulate((n for _, n in in_part), initial=0))
    some = [(part, start) for (part, _), start in zip(in_part, before, strict=False) if start < drawn]
    last = some[-1][0] if some else -1
    starts = spark.createDataFrame(some, "part int, start long")
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    first = dealt.where(F.col("part") <= last).join(F.broadcast(starts), "part").withColumn("rank", place.cast("long"))
    first = first.withColumn("rank", F.when(F.col("wanted") & (F.col("rank") <= drawn), F.col("rank"))).drop("start")
    return first.unionByName(dealt.where(F.col("part") > last).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs`` (``doc_id, text``); target: ``text``.

    Null and empty texts have no features, weight 0 and no rank; texts of any length count whole.  Equal scores rank by id,
    rows that repeat an id in the order of the table; a null id ranks after others and is hashed as no text.  Without
    target texts, or with an empty one, all counts of the target are zero.  An empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = target.select(F.monotonically_increasing_id().alias("r"), F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(rows, wanted, orders, buckets)
    found = features(positions(rows), orders, buckets).join(F.broadcast(gain), "bucket", "left")
    summed = found.groupBy("r", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("gain"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0).cast("long")
    summed = summed.select("r", "doc_id", "n_features", weight.alias("weight"), (F.col("n_words") >= least_words).alias("wanted"))
    scored = written(summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    out = written(ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank"), "resampled")
    discard(spark, gain, scored)
    return out


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """CRC-32 by its table of 256 remainders, made from the polynomial, once for each different word."""
    word = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{BIG}', '{SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
    WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) x(i))),
    d AS (SELECT row_number() OVER () AS r, doc_id, {word} AS w FROM documents),
    dw AS (SELECT r, unnest(w) AS word FROM d),
    bw AS (SELECT unnest({word}) AS word FROM benchmark),
    voc AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
    raw AS (SELECT word, hex(encode(word)) AS x FROM voc),
    num AS (SELECT word, list_transform(range(len(x) // 2), lambda i: CAST(instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17 AS BIGINT)) AS b FROM raw),
    hashed AS (SELECT word, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[CAST(xor(c, v) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % {BUCKETS} AS bucket FROM num, steps),
    df AS (SELECT r, bucket FROM dw JOIN hashed USING (word)),
    s AS (SELECT bucket, count(*) AS s FROM df GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
    n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
    g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS}) / ((s + 1)::DOUBLE * (tt + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
    f AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM df JOIN g USING (bucket) GROUP BY r),
    w AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(f.n, 0) AS n_features, CASE WHEN f.n > 0 THEN (gain - ((gain % f.n) + f.n) % f.n) // f.n ELSE 0 END AS weight,
                 substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM d LEFT JOIN f USING (r)),
    u AS (SELECT *, list_reduce(list_transform(range(8), lambda i: CAST(instr('0123456789abcdef', h[i + 1]) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS v FROM w),
    x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((v + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score FROM u),
    o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x WHERE n_words >= {LEAST_WORDS}),
    k AS (SELECT count(*) * {PERCENT} // 100 AS k FROM o)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(o.rank AS BIGINT) AS rank
    FROM x LEFT JOIN (SELECT o.* FROM o, k WHERE rank <= k) o USING (r)"""
