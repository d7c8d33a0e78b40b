"""Exact top-k inner product search over vector-approximation files.

The approximation file holds one small cell number per component. Scanning
it gives, for a query, bounds of every vector's score. The k-th largest lower
bound so far is a floor no result can be under; vectors whose upper bound lies
below it are never read. The rest are read exactly in order of their upper
bound, batch by batch, until the k-th exact score is above every bound left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

SCAN = "query_no long, vec_no long, upper double, lower double"
LONGEST = 2**63 - 1


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), x as double. Vectors null or with a null or non-finite component are left out."""
    x = F.col(embedding)
    clean = vectors.where(x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    return clean.select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _best(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first k rows of every group; Spark cuts to k inside each task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 20, cells: int = 64, block: int = 32_768, query_block: int = 1024, batch: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id, itself left out.

    ``vectors`` has (vec_id, v array<long>); ``is_query`` selects the queries.
    Equal vectors are searched once: they are folded into one vector with its
    k + 1 smallest ids, which is all a query can want of them, so a vector that
    holds a third of all rows costs one row. Vectors of other lengths score
    with queries of their own length only. The approximation file is cut into
    blocks of ``block`` vectors; each block meets every block of
    ``query_block`` queries through an equi-join on the pair of block numbers,
    and a task holds one such pair. Repeated vec_ids count as separate rows. An
    empty table gives no rows.

    Where the largest components could carry a sum past 64 bits, scores are
    summed and ordered as 38-digit decimals and only shown cut to the range of a
    long. A component counts for 9 * 10^18 over the root of the vector's length at
    most, on either side, so a sum has 38 digits at most. Bounds are doubles;
    where those can round, they are widened by more than they can be off.
    """
    most = F.floor(F.lit(9e18) / F.sqrt(F.greatest(F.size("v"), F.lit(1))))
    bounded = F.transform("v", lambda e: F.greatest(-most, F.least(most, e)))
    source = written(vectors.select("vec_id", bounded.alias("v"), is_query.alias("asks")), "va-source")
    ids = _best(source.where("vec_id is not null").withColumn("key", F.to_json("v")).select("key", "vec_id"), "key", k + 1, "vec_id")
    groups = ids.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 each
    distinct = source.where("vec_id is not null").groupBy(F.to_json("v").alias("key")).agg(F.max("asks").alias("asks"))
    shaped = distinct.join(groups, "key").select(F.from_json("key", "array<long>").alias("v"), "ids", "asks")
    numbered = written(shaped.withColumn("vec_no", F.xxhash64("v").bitwiseXOR(F.element_at("ids", 1))), "va-vectors")
    stats = numbered.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect()  # one row per dimension
    total, asked = numbered.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    if not stats or not asked:
        return source.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    largest = sum(max(abs(r["lo"]), abs(r["hi"])) ** 2 for r in stats)
    wide = largest > LONGEST
    lo, hi = (np.array([r[side] for r in stats], float) for side in ("lo", "hi"))
    biggest = np.maximum(np.abs(lo), np.abs(hi))
    rounding = (len(stats) + 16) * 2.0**-51 if largest >= 2**52 else 0.0  # bounds are exact integers below that
    step = np.maximum(1.0, np.ceil((hi - lo + 1) / cells))
    blocks, query_blocks = -(-total // block), -(-asked // query_block)

    @F.pandas_udf("binary")
    def cell_file(vs: pd.Series) -> pd.Series:
        return vs.map(lambda v: np.clip((np.asarray(v, float) - lo[: len(v)]) // step[: len(v)], 0, cells - 1).astype(np.uint8).tobytes())

    approximation = written(
        numbered.select("vec_no", F.size("v").alias("dims"), cell_file("v").alias("cell"), F.pmod("vec_no", F.lit(blocks)).alias("block")), "va-file"
    )
    asking = numbered.where("asks").select(
        F.col("vec_no").alias("query_no"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_no"), F.lit(query_blocks)).alias("query_block")
    )
    # each pair of blocks is one key: the queries go to every block, in blocks of bounded size
    here = approximation.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    there = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    here = here.withColumn("query_block", F.col("query_block").cast("long")).select("block", "query_block", "vec_no", "dims", "cell")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, rows in left.groupby("dims"):
            wanted = right[right["q"].map(len) == dims]
            if not len(wanted):
                continue
            queries = np.array(wanted["q"].tolist(), np.float64).reshape(len(wanted), dims)
            names = wanted["query_no"].to_numpy()
            cell = np.frombuffer(b"".join(rows["cell"]), np.uint8).reshape(len(rows), dims)
            low = cell * step[:dims] + lo[:dims]
            middle, half = low + (step[:dims] - 1) / 2, (step[:dims] - 1) / 2
            kept = min(k + 1, len(rows))
            for first in range(0, len(queries), 128):
                q = queries[first : first + 128]
                centre, reach = q @ middle.T, (np.abs(q) @ half + rounding * (np.abs(q) @ (biggest[:dims] + step[:dims])))[:, None]
                # within a block all bounds of a query reach equally far, so the centres alone order them
                floor = np.partition(centre, -kept, axis=1)[:, -kept][:, None] - 2 * reach
                a, b = np.nonzero(centre >= floor)
                out.append(pd.DataFrame({
                    "query_no": names[first + a], "vec_no": rows["vec_no"].to_numpy()[b],
                    "upper": np.floor(centre[a, b] + reach[a, 0]),
                    "lower": np.ceil(centre[a, b] - reach[a, 0]),
                }))
        return pd.concat(out) if out else pd.DataFrame({name: pd.Series([], dtype="int64" if kind == "long" else "float64") for name, kind in map(str.split, SCAN.split(", "))})

    bounds = written(here.groupBy("block", "query_block").cogroup(there.groupBy("block", "query_block")).applyInPandas(scan, SCAN), "va-bounds")
    floors = _best(bounds, "query_no", k + 1, F.desc("lower")).groupBy("query_no").agg(
        F.when(F.count(F.lit(1)) > k, F.min("lower")).alias("floor")
    )
    left = written(bounds.join(floors, "query_no").where("floor is null or upper >= floor").select("query_no", "vec_no", "upper"), "va-candidates")
    exact = numbered.select("vec_no", "v", "ids")
    vectors_asked = asking.select("query_no", "q")
    done, factor = None, "decimal(19,0)" if wide else "long"
    while True:
        due = _best(left, "query_no", batch, F.desc("upper"), "vec_no").drop("rank")
        number = "decimal(38,0)" if wide else "long"
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: (a.cast(factor) * b.cast(factor)).cast(number)), F.lit(0).cast(number), lambda s, e: (s + e).cast(number))
        read = due.join(exact, "vec_no").join(vectors_asked, "query_no").select("query_no", "vec_no", score.alias("score"), F.element_at("ids", 1).alias("first"))
        found = _best(read if done is None else done.unionByName(read), "query_no", k + 1, F.desc("score"), "first").drop("rank")
        done = written(found, "va-found")
        worst = done.groupBy("query_no").agg(F.when(F.count(F.lit(1)) > k, F.min("score").cast("double")).alias("worst"))
        rest = left.join(due.select("query_no", "vec_no"), ["query_no", "vec_no"], "left_anti").join(worst, "query_no")
        left = written(rest.where("worst is null or upper >= worst").select("query_no", "vec_no", "upper"), "va-candidates")
        if left.isEmpty():
            break
        batch *= 4
    # back from folded vectors to rows: the asking ids on one side, the ids to return on the other
    per_query = done.join(numbered.select("vec_no", "ids"), "vec_no").select("query_no", "score", F.explode("ids").alias("vec_id"))
    short = _best(per_query, "query_no", k + 1, F.desc("score"), "vec_id").drop("rank").groupBy("query_no").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found")
    )  # at most k + 1 each
    keys = numbered.where("asks").select(F.col("vec_no").alias("query_no"), F.to_json("v").alias("key"))
    askers = source.where("vec_id is not null and asks").select(F.col("vec_id").alias("query_id"), F.to_json("v").alias("key")).join(keys, "key")
    one = F.array_position(F.transform("found", lambda f: f["vec_id"]), F.col("query_id")).cast("int")
    others = F.filter("found", lambda f, i: (i + 1) != one)
    score = -F.col("f.s")
    if wide:
        score = F.greatest(F.lit(-LONGEST - 1).cast("decimal(38,0)"), F.least(F.lit(LONGEST).cast("decimal(38,0)"), score)).cast("long")
    return askers.join(short, "query_no").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), score.alias("score")
    )
