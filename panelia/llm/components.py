"""Connected components of a links table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelia.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches; links are (src, dst).

    Every step needs only a minimum for each id, which Spark combines before the shuffle, and a
    join with it. The minima are stored first: only a join of two tables that are read, not one
    with an aggregate on the same key, can be split by adaptive execution where one id has many
    links. Links end as stars around the smallest id. Rounds grow with the logarithm of the size
    of the components.
    """
    edges = stored(
        links.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        # large star: greater neighbours of u, seen from both ends, move to the least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large.filter("u <> v"), "large-star")
        # small star: u and its smaller neighbours move to the least of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(
            moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star"
        )
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
        ).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
