"""Ranks of all tiles for all queries: no pair is shuffled or written (6 GB failed by disk)."""

from pyspark.sql import functions as F

from pagelight.operators import blocks
from pagelight.operators import ranking as R


def test_modes_are_those_of_ranked_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "RANKED", 8 * 90 * 4)  # blocks of four queries
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 3 * 16)
    rows = [(k % 5 if k % 7 else None, k, [float(k % 4), float(k % 3), 1.0]) for k in range(90)] + [(1, None, [1.0, 0.0, 0.0]), (9, 200, [1.0, 2.0]), (9, 201, None)]
    tiles = spark.createDataFrame(rows, "doc_id long, tile long, vec array<double>").repartition(3)
    queries = tiles.where("tile % 10 = 0").select(F.col("tile").alias("query_id"), "vec")
    out = blocks.modes(queries, tiles, ("vec", "vec"), "doc_id")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    pairs = blocks.group_scores(queries, tiles, ("vec", "vec"), ["doc_id", "tile"], [], None).where("tile is not null").withColumn("score", F.round("score", 9))
    want = R.tile_modes(R.top_k(pairs, None, ties=["tile"]), ["doc_id"])
    tidy = lambda df: sorted(map(repr, df.select("query_id", "doc_id", *[F.round(c, 9) for c in ("max_score", "mean3", "mean5", "rrf")], "hits").collect()))
    assert tidy(out) == tidy(want) and len(tidy(out)) > 50
    assert blocks.modes(queries.union(queries), tiles, ("vec", "vec"), "doc_id") is None
