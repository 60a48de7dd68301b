"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's
target over its size. Documents are put in order of size, then of a hash of the id;
the running sum of expected copies plus one random offset for each source emits a
document once for each whole number it crosses. As neighbours are of almost equal
size, the words taken come within one document of the target.

The running position in a source is a sum of three counts, none of which needs the
rows of a source together: documents of smaller sizes, documents of the same size in
earlier hash buckets, and the place within one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
SEED = "mix-1"
#: Copies of a row that are made from one array.
REPEATED = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) for each source of rows (source, source_size).

    Sources by code point, null last, take the weights in turn. A target stops at
    ``cap`` times its source's size; what is cut is shared again by weight. In order
    of cap over weight, what is left over the weights left grows while sources are cut
    and falls from the first that isn't, so its maximum is the share of one weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    one = F.array(*(F.lit(float(w)) for w in weights))
    w = sizes.withColumn("w", one[(F.row_number().over(order) - 1) % len(weights)]).withColumn("top", F.col("source_size") * F.lit(cap))
    by = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = w.select("source", "source_size", "w", "top", (F.sum("source_size").over(Window.partitionBy()) * F.lit(budget)).alias("all"), F.sum("w").over(Window.partitionBy()).alias("all_w"), F.coalesce(F.sum("top").over(before), F.lit(0.0)).alias("cut"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("cut_w"))
    rest = rest.withColumn("rate", (F.col("all") - F.col("cut")) / (F.col("all_w") - F.col("cut_w")))
    level = F.max("rate").over(Window.partitionBy())
    return rest.select("source", "source_size", F.least(level * F.col("w"), F.col("top")).alias("target"))


def word_count(text: str):
    """Number of words of a text column, 0 for null."""
    words = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """One row (id, source, size, source_size, target, copies) for each row of ``docs``, and its column ``carry`` if given.

    A null source is a source of its own. Null and empty texts have size 0 and, like
    all rows of a source without words, add nothing whatever their copies. Repeated
    ids are separate documents, in order of what they carry. The same input and seed give the same result,
    but for rows of one id, source and size that carry nothing or the same, which take their copies in any order.
    Sources are few: their totals are put in order in one task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), (F.col(carry) if carry else F.lit(None).cast("string")).alias("carried"))
    rows = save(rows, "sizes")  # words are counted once
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    # Rows without an id are dealt by what they carry, else they would share a bucket.
    more = F.when(F.col("id").isNull(), F.substring(F.md5(F.col("carried").cast("string").cast("binary")), 1, 2)) if carry else F.lit(None).cast("string")
    rows = rows.withColumn("key", key).withColumn("bucket", F.concat(F.substring("key", 1, 2), F.coalesce(more, F.lit(""))))
    per_size = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    per_bucket = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = per_size.select("source", "size", F.coalesce(F.sum("n").over(earlier("source").orderBy("size")), F.lit(0)).alias("smaller"))
    buckets = per_bucket.select("source", "size", "bucket", F.coalesce(F.sum("n").over(earlier("source", "size").orderBy("bucket")), F.lit(0)).alias("before"))
    totals = per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, budget, cap)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # Named sides for joins that treat null sources as equal.
    s = sizes.alias("s").join(targets.withColumn("offset", start).alias("t"), F.expr("s.source <=> t.source")).select("s.source", "s.size", "s.smaller", "t.source_size", "t.target", "t.offset")
    b = buckets.alias("b").join(s.alias("s"), F.expr("b.source <=> s.source and b.size = s.size")).select("b.source", "b.size", "b.bucket", "b.before", "s.smaller", "s.source_size", "s.target", "s.offset")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("key", "id", "carried")))
    out = placed.alias("r").join(b.alias("b"), F.expr("r.source <=> b.source and r.size = b.size and r.bucket = b.bucket"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    out = out.select("r.id", "r.source", "r.size", "r.carried", "b.source_size", F.coalesce("b.target", F.lit(0.0)).alias("target"), share.alias("share"), (F.col("b.smaller") + F.col("b.before") + F.col("r.place")).alias("at"), "b.offset")
    crossed = F.floor(F.col("at") * F.col("share") + F.col("offset")) - F.floor((F.col("at") - 1) * F.col("share") + F.col("offset"))
    named = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.least(crossed, F.ceil("share")).cast("long").alias("copies")]
    return out.select(*named, *([F.col("carried").alias(carry)] if carry else []))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with all its columns.

    Rows that are equal in every column count together, so a large group of them is
    one row with a number of copies, which are made ``REPEATED`` at a time. Map columns are compared as JSON.
    Rows in any layout give the same result, also where ids repeat or are null.
    """
    key, n, lot = fresh(docs, "row_key", "row_copies", "row_lot")
    values = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    keyed = docs.withColumn(key, F.to_json(F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.xxhash64(*values).alias("h"), F.xxhash64(F.lit(1), *values).alias("g")), {"ignoreNullFields": "false"}))
    taken = copies(keyed, id_col=id_col, text_col=text_col, source_col=source_col, carry=key, **options).groupBy(key).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    each = keyed.dropDuplicates([key]).join(taken, key)
    lots = each.withColumn(lot, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / REPEATED).cast("int"))))
    held = F.least(F.lit(REPEATED), F.col(n) - F.col(lot) * REPEATED).cast("int")
    return lots.withColumn(n, F.explode(F.array_repeat(F.lit(1), held))).select(*docs.columns)


def mix_report(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS top FROM totals),
summed AS (
  SELECT *, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS all_, sum(w) OVER () AS all_w,
         coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
         coalesce(sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut_w
  FROM weighed),
rated AS (SELECT *, (all_ - cut) / (all_w - cut_w) AS rate FROM summed),
targets AS (SELECT source, source_size, least(max(rate) OVER () * w, top) AS target FROM rated),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE CAST(1 AS DOUBLE) END AS share,
         row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.k, r.doc_id) AS pos,
         CAST(CAST('0x' || substr(md5('mix-1' || coalesce(r.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS offset_
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(floor(pos * share + offset_) - floor((pos - 1) * share + offset_), ceil(share)) AS BIGINT) AS taken
FROM placed
"""
