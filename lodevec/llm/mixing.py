"""Operator 8, mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` times
all words; a target stops at `most` times its source's size and the excess is reshared by weight
until none is above. Of each source the mix takes `upto` words, its target rounded. Blocks: each
source's documents, shuffled by a seeded hash, are one stream of words; a second epoch follows the
first. The first upto words of it are cut into blocks of BLOCK words, the last of which may be
shorter. Schedule: with N blocks in all, sources lie side by side on the points 0 to N - 1, each
with as many as it has blocks (the cumulative weights). Slots visit the points in van der Corput
order (slot i's point is i with its bits reversed; points beyond N are passed over), so that every
stretch of slots draws from each source in proportion, and no source, however small, is drawn too
often or never. A slot's rank within its source names the block that it takes.

Scale: only (doc_id, source, size, hash) is shuffled, never texts. A source's stream is cut by
leading hash digits into 4096 buckets whose sums make the offsets, so that a source with a third of
all rows is spread over as many tasks; rows equal in all that counts are one row with a number of
copies until the end. Points find their source by an equi-join on a piece of the point range, and
slots are ranked in chunks of CHUNK slots with the counts of the chunks before.

Cases: null text has size 0; a document or source of size 0 is taken 0 times; null doc_id and
repeated rows are ordinary rows (equal rows follow one another in the stream, so which of them gets
a remainder is open, but the multiset of rows isn't); other columns are ignored by `mix` and kept
by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.common import partitions, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, BLOCK, SEED = 1.5, 2.0, 256, "mix-1"
PIECES, CHUNK, MANY, PART_WORDS = 4096, 1 << 16, 100_000, 20_000_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = SEED, more: tuple[Column, ...] = ()) -> DataFrame:
    """Rows (doc_id, source, size, h) and more columns of docs: h orders a source's stream."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), h.alias("h"), *more)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, target): one per source.

    Resharing settles at target = min(most * size, x * weight) for one x; sources sorted by
    cap / weight show it in one pass. The table has a row per source, so its windows are small.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("x", (total - capped) / rest)
    fits = F.min(F.when(F.col("x") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("x").alias("x")))).over(Window.partitionBy())
    return s.withColumn("x", fits["x"]).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("x") * F.col("w")), F.col("cap")).alias("target"))


def plan(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per source: source, source_size, target, upto, and its first point and number of points (= blocks)."""
    upto = F.floor(F.col("target") + 0.5).cast("bigint")
    n = F.expr(f"(upto + {block - 1}) div {block}")
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return goal.withColumn("upto", upto).withColumn("n_points", n).withColumn("first_point", F.coalesce(F.sum("n_points").over(before), F.lit(0)))


def reverse_bits(i: Column, bits: int) -> Column:
    """The lowest `bits` bits of a long (32 at most a half) in reverse order."""

    def half(x: Column) -> Column:  # 32 bits
        for by, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
            m = F.lit(mask).cast("bigint")
            x = F.shiftright(x, by).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), by))
        return x

    low, high = i.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftright(i, 32)
    if bits <= 32:
        return F.shiftright(half(low), 32 - bits)
    return F.shiftright(F.shiftleft(half(low), 31).bitwiseOR(F.shiftright(half(high), 1)), 63 - bits)


def schedule(plan: DataFrame) -> DataFrame:
    """Rows (slot, source, rank): which source each slot draws from, and its how-manyth draw that is.

    plan is a staged table: a row per source, whose size Spark knows before it broadcasts it.
    """
    spark = plan.sparkSession
    n = int(plan.agg(F.coalesce(F.sum("n_points"), F.lit(0)).alias("n")).first()["n"])
    bits = max(1, (n - 1).bit_length()) if n else 1
    slots = spark.range(0, 1 << bits if n else 0, 1, max(1, min(10_000, n // 1_000_000))).withColumn("point", reverse_bits(F.col("id"), bits)).where(F.col("point") < n)
    width = max(1, -(-n // PIECES))
    piece = lambda c: F.expr(f"{c} div {width}")
    of = plan.where("n_points > 0").select("source", "first_point", (F.col("first_point") + F.col("n_points")).alias("end_point"))
    of = of.withColumn("piece", F.explode(F.sequence(piece("first_point"), piece("(end_point - 1)"))))
    drawn = slots.withColumn("piece", piece("point")).join(of, "piece").where("point >= first_point AND point < end_point")
    drawn = drawn.select(F.col("id").alias("slot"), "source", F.expr(f"id div {CHUNK}").alias("chunk"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    drawn = drawn.withColumn("row", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    return drawn.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select("slot", "source", (F.col("ahead") + F.col("row")).alias("rank"))


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """sized with source_size, target, off (the document's first word in its source's stream), upto (words the
    mix takes of the stream) and taken; and the plan of its sources."""
    own = sized.columns
    sized = stage(sized.groupBy(*own).agg(F.count("*").alias("copies")), "sizes")  # rows still equal are interchangeable
    goal = stage(plan(targets(sized.withColumn("size", F.col("size") * F.col("copies")), weights, share, most), block), "targets")
    b = F.substring("h", 1, 3)
    sums = sized.groupBy("source", b.alias("b")).agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s2"), F.col("b").alias("b2"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    of = sums.join(goal.select(F.col("source").alias("s"), "source_size", "target", "upto"), F.col("s2").eqNullSafe(F.col("s"))).drop("s")
    order = ["h", F.col("doc_id").asc_nulls_first(), "size", *(c for c in own if c not in ("h", "doc_id", "size", "source"))]
    within = Window.partitionBy("source", "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = sized.withColumn("b", b).withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    d = d.join(of, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))).withColumn("first", F.col("ahead") + F.col("inner"))
    # copies in two steps, so that no list grows with their number
    d = d.withColumn("many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {MANY}"))))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(MANY).cast("long"), F.col("copies") - F.col("many") * MANY) - 1)))
    d = d.withColumn("off", F.col("first") + (F.col("many") * MANY + F.col("copy")) * F.col("size"))
    rest = F.col("upto") % F.col("source_size")
    taken = F.col("size") * F.expr("upto div source_size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("off")))
    taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("bigint")
    return d.withColumn("taken", taken).select(*own, "source_size", "target", "off", "upto", "taken"), goal


def epochs(mixed: DataFrame) -> DataFrame:
    """mixed with a row per epoch that takes words of the document: at is its first word in the whole stream."""
    parts = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(upto + source_size - 1) div source_size") - 1)))
    return parts.withColumn("at", F.col("off") + F.col("epoch") * F.col("source_size")).where("at < upto")


def slotted(parts: DataFrame, goal: DataFrame, rank: Column) -> DataFrame:
    """parts (source, ...) with the slot of their source's block of that rank."""
    s = schedule(goal).select("slot", F.col("source").alias("__s"), F.col("rank").alias("__r"))
    return parts.withColumn("__rank", rank).join(s, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__rank") == F.col("__r"))).drop("__rank", "__s", "__r")


def blocks(mixed: DataFrame, goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: rows (slot, source, doc_id, start, length), the words of a document that each slot takes."""
    parts = epochs(mixed.select("doc_id", "source", "size", "off", "source_size", "upto", "taken"))
    parts = parts.withColumn("rank", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(least(at + size, upto) - 1) div {block}"))))
    lo, hi = F.greatest("at", F.col("rank") * block), F.least(F.col("at") + F.col("size"), F.col("upto"), (F.col("rank") + 1) * block)
    parts = parts.select("doc_id", "source", "rank", (lo - F.col("at")).alias("start"), (hi - lo).alias("length"))
    return slotted(parts, goal, F.col("rank")).select("slot", "source", "doc_id", "start", "length")


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", count: str = "n_chars", block: int = BLOCK, **how) -> DataFrame:
    """docs after the mix, same columns, in the schedule's order: each document at the slot of its first block, once
    an epoch; of the one document per source where the last epoch ends, its first words. `count`, if there, is made anew."""
    row = lambda seed: F.xxhash64(F.col(key), F.col(source), F.col(text), F.isnull(key), F.isnull(source), F.isnull(text), F.lit(seed))
    m, goal = mix(sizes(docs, text, key, source, more=(row(0).alias("__a"), row(1).alias("__b"))), block=block, **how)
    m = slotted(epochs(m).withColumn("__take", F.least("size", F.col("upto") - F.col("at"))), goal, F.expr(f"at div {block}"))
    m = m.select("__a", "__b", "off", F.col("slot").alias("__slot"), F.col("at").alias("__at"), F.when(F.col("__take") < F.col("size"), F.col("__take")).alias("__head"))
    # equal rows of docs are interchangeable here but for columns that don't count: the j-th of them goes with the j-th in the stream
    same = ["__a", "__b", F.col("__j")]
    nth = lambda *by: F.when(F.col("__n") > 1, F.row_number().over(Window.partitionBy("__a", "__b").orderBy(*by))).otherwise(1)
    many = docs.select(row(0).alias("__a"), row(1).alias("__b")).groupBy("__a", "__b").count().where("count > 1").select("__a", "__b")
    many = stage(many, "repeated")  # texts that don't repeat need no number
    m = m.join(many.withColumn("__n", F.lit(2)), ["__a", "__b"], "left")
    first = m.where("__n IS NULL").withColumn("__j", F.lit(1))
    again = m.where("__n IS NOT NULL").withColumn("__j", F.dense_rank().over(Window.partitionBy("__a", "__b").orderBy("off")))
    d = docs.withColumns({"__a": row(0), "__b": row(1)})
    one = d.join(many, ["__a", "__b"], "left_anti").withColumn("__j", F.lit(1))
    several = d.join(many, ["__a", "__b"]).withColumn("__j", F.row_number().over(Window.partitionBy("__a", "__b").orderBy("__a")))
    d = one.unionByName(several).join(first.unionByName(again).drop("__n"), ["__a", "__b", "__j"])
    ends = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    d = d.withColumn(text, F.when(F.col("__head").isNull(), F.col(text)).otherwise(F.array_join(F.slice(ends, 1, F.col("__head").cast("int")), "")))
    if count in docs.columns:
        d = d.withColumn(count, F.length(text).cast(docs.schema[count].dataType))
    return in_slot_order(d, goal, block).select(*docs.columns)


def in_slot_order(d: DataFrame, goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with __slot and __at, partitions in slot order and sorted within: equal stretches of slots, so no sample is needed."""
    n = int(goal.agg(F.coalesce(F.sum("n_points"), F.lit(1)).alias("n")).first()["n"])
    slots = 1 << max(1, (n - 1).bit_length())
    parts = max(partitions(d.sparkSession), -(-n * block // PART_WORDS))
    part = F.least(F.lit(parts - 1), F.floor(F.col("__slot") / F.lit(slots / parts))).cast("int")
    return d.repartitionById(parts, part).sortWithinPartitions("__slot", "__at")


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m, goal = mix(sizes(docs))
    taken = slotted(m.where("taken > 0"), goal, F.expr(f"off div {BLOCK}")).unionByName(m.where("taken = 0").withColumn("slot", F.lit(None).cast("long")))
    return taken.select("doc_id", "size", "source_size", "target", "taken", F.col("slot").alias("first_slot"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h
  FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s
),
x AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER p, 0)) AS x
  FROM w WINDOW p AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
g AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT x FROM x WHERE x * w <= cap ORDER BY cap / w, encode(source) NULLS LAST LIMIT 1) * w), cap) AS target FROM x
),
u AS (SELECT *, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) AS upto FROM g),
t AS (
  SELECT *, CAST(coalesce(sum((upto + 255) // 256) OVER (ORDER BY encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_point, (upto + 255) // 256 AS n_points FROM u
),
b AS (SELECT greatest(1, CAST(ceil(log2(greatest(2, sum(n_points)))) AS INTEGER)) AS bits, sum(n_points) AS n FROM t),
i AS (SELECT unnest(generate_series(0, CAST((1::BIGINT << (SELECT bits FROM b)) - 1 AS BIGINT))) AS slot),
p AS (SELECT slot, CAST(list_sum(list_transform(generate_series(0, b.bits - 1), lambda k: ((slot >> k) & 1) << (b.bits - 1 - k))) AS BIGINT) AS point, b.n FROM i, b),
c AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM p JOIN t ON point >= first_point AND point < first_point + n_points AND point < n
),
o AS (
  SELECT d.*, t.source_size, t.target, t.upto, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
),
r AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(size * (upto // source_size) + greatest(0, least(size, upto % source_size - off)) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS taken FROM o
)
SELECT doc_id, size, source_size, target, taken, c.slot AS first_slot
FROM r LEFT JOIN c ON c.source IS NOT DISTINCT FROM r.source AND c.rank = off // 256 AND taken > 0
"""
