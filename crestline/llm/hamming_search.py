"""Exact top-k search over binary codes: incremental multi-index hashing.

A code of `bits` bits is cut into m segments of 16 bits, or log2(codes) where that is more; an index
has a row for each segment of each distinct code. A query looks up all values within
radius s of its segments, one segment after another and s growing from 0. A code that
has not come up after the first j segments at radius s differs in more than s bits in
those and more than s - 1 in the others, so in at least j * (s + 1) + (m - j) * s bits:
the kth verified distance is final as soon as it is not above that bound less one. A
round here takes all segments at one radius, and only queries that are not final go on
to the next.

Rows with one code are one code with its smallest ids (no more can be among the
nearest, ties going to the smaller id), so copies, even a third of all rows, cost
nothing; queries with one code are answered once. Lookups are equi-joins on (segment,
value), where Spark can split what is skewed. Of a query's candidates each task keeps
the best alone (a ranked window, which Spark limits before its shuffle and sorts with
spilling), so no query's candidates are ever gathered. A pair comes up once for each
segment at most; the window keeps m times as many rows as wanted, and only those are
told apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_unique, table, written


def sign_code(vector: Column, bits: int = 64) -> Column:
    """The signs of a vector's first `bits` components as one integer: bit i is set where component i is above 0."""
    bit = F.transform(F.slice(vector, 1, bits), lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.reverse(bit), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def segment_cuts(bits: int, codes: int) -> list[int]:
    """Where segments begin, and the end: 16 bits a segment, or as many as that number of codes fills if it fills more, up to 32."""
    width = min(max(math.ceil(math.log2(max(codes, 2))), 16), 32)
    m = -(-bits // width)
    return [round(bits * i / m) for i in range(m + 1)]


def segments(code: Column, cuts: list[int]) -> list[Column]:
    return [F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]


def probes(waiting: DataFrame, cuts: list[int], radius: int) -> DataFrame:
    """waiting's columns, query among them, with (segment, value): all values that differ in exactly radius bits from a query's segments."""
    by = waiting.columns
    widths = F.array(*[F.lit(b - a) for a, b in zip(cuts, cuts[1:], strict=False)])
    rows = waiting.select(*by, F.posexplode(F.array(*segments(F.col("query"), cuts))).alias("segment", "value"))
    rows = rows.select(*by, "segment", "value", F.get(widths, F.col("segment")).alias("width"), F.lit(-1).alias("last"))
    for _ in range(radius):
        # one bit more, above those flipped already
        rows = rows.filter("last + 1 < width").select(*by, "segment", "value", "width", F.explode(F.expr("sequence(last + 1, width - 1)")).alias("last"))
        rows = rows.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, last)")))
    return rows.select(*by, "segment", "value")


def nearest(rows: DataFrame, by: list[str], k: int, copies: int) -> DataFrame:
    """Of (*by, code, ids, distance), each up to `copies` times, the k nearest codes of each query, ties to the smaller first id."""
    order = Window.partitionBy(*by).orderBy("distance", F.col("ids")[0], "code")
    few = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k * copies).drop("k")
    best = F.array_sort(F.collect_set(F.struct("distance", "ids", "code")))
    return few.groupBy(*by).agg(F.slice(best, 1, k).alias("best"))


def search(waiting: DataFrame, index: DataFrame, cuts: list[int], most: int) -> DataFrame:
    """(query, best) for waiting (query, want): of each query code the nearest codes with their ids, `want` ids or more.

    With a column own, an id, queries are told apart by it too and ids are without it.
    """
    m, widest = len(cuts) - 1, max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    by = [c for c in waiting.columns if c != "want"]
    best = results = None
    for radius in range(widest + 1):
        # merged, not broadcast: the planner can't see how many rows explode() makes
        hits = probes(waiting.select(*by), cuts, radius).join(index.hint("merge"), ["segment", "value"])
        if "own" in by:
            hits = hits.withColumn("ids", F.filter("ids", lambda i: i != F.col("own"))).filter("size(ids) > 0")
        near = hits.select(*by, "code", "ids", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int").alias("distance"))
        state = nearest(near if best is None else near.unionByName(best), by, most, m + 1)
        # the distance at which there are as many ids as wanted; who has not turned up differs in more than `radius` bits of every segment
        reach = F.aggregate("best", F.struct(F.col("want").cast("long").alias("left"), F.lit(0).alias("at")), lambda acc, b: F.when(acc["left"] > 0, F.struct(
            (acc["left"] - F.size(b["ids"])).cast("long").alias("left"), b["distance"].alias("at"))).otherwise(acc))
        final = (reach["left"] <= 0) & (reach["at"] <= m * (radius + 1) - 1)
        state = written(waiting.join(state, by, "left").select(*by, "want", "best", F.coalesce(final, F.col("want") == 0).alias("final")), "found")
        results = state.filter("final") if results is None else results.unionByName(state.filter("final"))
        waiting = state.filter("not final").select(*by, "want")
        if not waiting.take(1):
            break
        best = state.filter("not final").select(*by, F.explode("best").alias("b")).select(*by, "b.code", "b.ids", "b.distance")
    else:
        results = results.unionByName(state.filter("not final"))
    return results.select(*by, F.expr("flatten(transform(best, b -> transform(b.ids, i -> struct(b.distance, i as id))))").alias("pairs"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64) -> DataFrame:
    """The k nearest codes of each query by Hamming distance, ties to the smaller id.

    codes and queries: (id, code), code a 64-bit integer of which `bits` are used.
    Returns query_id, rank (from 1), id, distance. A row of codes with the query's own
    id is left out. Fewer than k others: all of them. Null codes or ids are left out,
    as queries and as codes; rows that repeat an id and a code count once, an id with
    several codes has a row for each. Empty tables give an empty table. Texts play no
    part here; a code has 64 bits however long what it stands for was. Other columns
    are ignored.

    No query keeps more than k + 1 codes: one whose id has a single code finds that at
    most among its nearest, others leave their own id out of each code they meet.
    """
    known = written(codes.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).dropna().distinct(), "known-codes")
    asked = written(queries.select(F.col("id").cast("long").alias("query_id"), F.col("code").cast("long").alias("query")).dropna().distinct(), "queries")
    most = k + 1
    firsts = known.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("k") <= most)
    ids = written(firsts.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    n_codes, total = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    cuts = segment_cuts(bits, n_codes)
    index = ids.select("code", "ids", F.posexplode(F.array(*segments(F.col("code"), cuts))).alias("segment", "value"))
    index = written(index, "segments", ["segment", "value"])

    def ranked(pairs: DataFrame) -> DataFrame:
        others = F.array_sort(F.filter("pairs", lambda b: b["id"] != F.col("query_id")))
        return pairs.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), "b.id", "b.distance")

    several = known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("query_id"))
    several = written(asked.select("query_id").distinct().join(several, "query_id", "left_semi"), "several")
    if not several.take(1):
        single = asked
    else:
        single = asked.join(several, "query_id", "left_anti")
        listed = ids.select(F.explode("ids").alias("query_id")).join(several, "query_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        own = written(asked.join(several, "query_id", "left_semi").join(listed, "query_id", "left").select(
            F.col("query_id").alias("own"), "query", F.least(F.lit(k), F.lit(total) - F.coalesce("n", F.lit(0))).alias("want")), "own")
        found = search(own, index, cuts, most)
        own = ranked(found.select(F.col("own").alias("query_id"), "pairs"))
    answers = search(single.select("query").distinct().withColumn("want", F.lit(min(most, total))), index, cuts, most)
    rest = ranked(join_unique(single, answers, "query"))
    return rest if single is asked else rest.unionByName(own)


def op1_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    codes = written(codes, "sign-codes")
    found = top_k(codes, codes.filter("id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [x > 0 FOR x IN embedding[1:64]] AS signs FROM embeddings),
c AS (SELECT vec_id, list_sum([(CASE WHEN signs[i] THEN 1 ELSE 0 END)::HUGEINT << (i - 1) FOR i IN range(1, len(signs) + 1)])::HUGEINT AS code FROM v),
d AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d) WHERE rank <= 10
"""
