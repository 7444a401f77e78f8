import collections

import pytest
from pyspark.sql import functions as F

from sprintgauge.operators import ranking, splits


def skewed(spark, n=900):
    """Two thirds of the rows in one group."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7))
        .alias("dataset_name"),
        F.concat(F.lit("K-"), F.col("id")).alias("issuekey"), (F.col("id") * 70001).alias("row_ord"))


def brute_rank(rows, order):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row.dataset_name].append(row)
    return {
        (name, row.row_ord): (at, len(members))
        for name, members in groups.items()
        for at, row in enumerate(sorted(members, key=order), 1)
    }


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_ranks_do_not_depend_on_partitions(spark, partitions):
    df = skewed(spark).repartition(partitions)
    ranked = ranking.ordered_rank(df, ["dataset_name"], "row_ord").collect()
    got = {(r.dataset_name, r.row_ord): (r["rank"], r.group_size) for r in ranked}
    assert got == brute_rank(df.collect(), lambda row: row.row_ord)


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_seeded_rank_is_md5_order(spark, partitions):
    from hashlib import md5

    df = skewed(spark).repartition(partitions)
    ranked = ranking.seeded_rank(df, ["dataset_name"], splits.ROW).collect()
    got = {(r.dataset_name, r.row_ord): (r["rank"], r.group_size) for r in ranked}
    key = lambda row: md5(f"42:{row.issuekey}:{row.row_ord}".encode()).hexdigest()
    assert got == brute_rank(df.collect(), key)


@pytest.mark.parametrize("salt_by", [None, ["row_ord"]])
def test_top_k(spark, salt_by):
    got = ranking.top_k(skewed(spark), ["dataset_name"], [F.desc("row_ord")], 3, salt_by=salt_by)
    expected = brute_rank(skewed(spark).collect(), lambda row: -row.row_ord)
    assert {(r.dataset_name, r.row_ord): r["rank"] for r in got.collect()} == {
        key: rank for key, (rank, _) in expected.items() if rank <= 3}


def rows_of(spark, n, name="a"):
    return spark.range(n).select(
        F.lit(name).alias("dataset_name"), F.concat(F.lit("K-"), F.col("id")).alias("issuekey"),
        F.col("id").alias("row_ord"))


def test_fold_sizes(spark):
    folds = splits.kfold_assign(rows_of(spark, 13)).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2}


def test_as_many_rows_as_folds(spark):
    assert sorted(r.fold for r in splits.kfold_assign(rows_of(spark, 5)).collect()) == [1, 2, 3, 4, 5]


def test_fewer_rows_than_folds_is_an_error(spark):
    with pytest.raises(Exception, match="fewer rows than folds"):
        splits.kfold_assign(rows_of(spark, 4)).collect()


def test_hash_folds_are_row_local(spark):
    plan = splits.kfold_assign(rows_of(spark, 1000), mode="hash")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in plan.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 120


def test_holdout_size_is_rounded_up(spark):
    parts = splits.holdout_split(rows_of(spark, 11)).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"holdout": 3, "train": 8}


def test_splits_cover_each_row_once_as_test(spark):
    roles = splits.intra_roles(splits.kfold_assign(rows_of(spark, 23)))
    tested = roles.filter("role = 'test'").groupBy("row_ord").count().collect()
    assert len(tested) == 23 and all(r["count"] == 1 for r in tested)
    assert roles.count() == 23 * 5


def test_cycles_need_enough_projects(spark):
    two = rows_of(spark, 3, "a").unionByName(rows_of(spark, 3, "b"))
    with pytest.raises(Exception, match="at least 3 projects"):
        splits.leave_one_out_roles(two).collect()
    three = two.unionByName(rows_of(spark, 3, "c"))
    with pytest.raises(Exception, match="at least 4 projects"):
        splits.four_way_roles(three).collect()
    roles = {(r.cycle, r.dataset_name): r.role for r in splits.leave_one_out_roles(three).collect()}
    assert roles[(2, "c")] == "test" and roles[(2, "a")] == "validation" and roles[(2, "b")] == "train"
