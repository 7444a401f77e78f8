"""Approximate neighbours: recall against the exact join, hot buckets, empty sides."""

from pyspark.sql import functions as F

from sprintgauge.operators import neighbours
from sprintgauge.plans import retrieval
from sprintgauge.session import ship_package


def _pairs(found):
    return {(r.query_id, r.neighbour_id): r.distance for r in found.collect()}


def test_recall_against_the_exact_join(spark):
    every = retrieval._vectors(ship_package(spark), "/root/testdata/sf0.1")
    asked = every.filter("row_id % 50 = 0")
    exact = _pairs(neighbours.knn_vectors(asked, every, exclude_self=True))
    for size in (256, 64):
        found = _pairs(neighbours.knn_lsh(asked, every, exclude_self=True, bucket_rows=size))
        hit = exact.keys() & found.keys()
        assert all(abs(exact[p] - found[p]) < 1e-8 for p in hit)
        print("recall", size, len(hit) / len(exact))
        assert len(hit) >= 0.9 * len(exact)


def test_one_bucket_of_copies_is_cut_into_blocks(spark):
    rows = ship_package(spark).range(200).select(F.col("id").alias("row_id"), F.array(
        F.lit(1.0), F.when(F.col("id") < 190, 0.0).otherwise(F.col("id") * 1.0)).alias("vec"))
    found = neighbours.knn_lsh(rows.filter("row_id = 7"), rows, 3, True, bucket_rows=16, block_rows=20)
    assert [(r.neighbour_id, r.distance) for r in found.orderBy("rank").collect()] == [
        (0, 0.0), (1, 0.0), (2, 0.0)]


def test_nulls_and_no_candidates(spark):
    rows = ship_package(spark).createDataFrame(
        [(1, [0.0, 1.0]), (2, None), (3, [0.0, 2.0])], "row_id bigint, vec array<double>")
    found = neighbours.knn_lsh(rows, rows, 2, True)
    assert {(r.query_id, r.neighbour_id) for r in found.collect()} == {(1, 3), (3, 1)}
    assert neighbours.knn_lsh(rows, rows.filter("row_id = 2"), 2).count() == 0
