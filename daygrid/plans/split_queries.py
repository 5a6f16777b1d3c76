"""Queries for splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.operators import running, splits
from daygrid.plans.bindings import FOLDS
from daygrid.plans.registry import query


@query("shuffle_order", "W4", "SELECT id, md5(concat('42-', id)) AS shuffle_key FROM folds", FOLDS)
def shuffle_order(t):
    return splits.shuffled(t.members.select("id"), "id", 42)


@query("stratified_split", "W5", "SELECT id, y, split FROM folds", FOLDS)
def stratified_split(t):
    return splits.stratified_split(t.members.select("id", "y"), "id", "y", 0.3, 42)


@query("stratified_folds", "W6", "SELECT id, y, fold FROM folds", FOLDS)
def stratified_folds(t):
    return splits.stratified_folds(t.members.select("id", "y"), "id", "y", 5, 42)


@query("group_folds", "W8", """
SELECT o_custkey, CAST(ntile(7) OVER (ORDER BY md5(concat('11-', o_custkey))) AS INTEGER) AS fold
FROM (SELECT DISTINCT o_custkey FROM orders) AS d""")
def group_folds(t):
    return splits.group_folds(t.orders, "o_custkey", 7, 11)


@query("folds_for_rows", "W7 A20", """
, firsts AS (SELECT o_custkey, o_orderstatus FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) AS x WHERE r = 1),
f AS (SELECT o_custkey, CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42-', o_custkey))) AS INTEGER) AS fold FROM firsts)
SELECT o_orderkey, o_custkey, fold FROM orders JOIN f USING (o_custkey)""", "none AS (SELECT 1)")
def folds_for_rows(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    folded = splits.folds_for_rows(rows, "o_custkey", "o_orderstatus", "o_orderkey", 5, 42)
    return folded.select("o_orderkey", "o_custkey", "fold")


@query("split_metadata", "S7", """
SELECT count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
       count(*) FILTER (WHERE split = 'train' AND y = 1) AS n_train_pos, count(*) FILTER (WHERE split = 'test' AND y = 1) AS n_test_pos,
       CAST(42 AS INTEGER) AS seed, CAST(0.3 AS DOUBLE) AS test_share FROM folds""", FOLDS, "test_share")
def split_metadata(t):
    split = splits.stratified_split(t.members, "id", "y", 0.3, 42)
    return splits.split_metadata(split, "y", 42, 0.3)


@query("average_ranks", "W9", """
SELECT DISTINCT l_returnflag, l_quantity,
       (rank() OVER o + rank() OVER o + count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / CAST(2 AS DOUBLE) AS avg_rank
FROM lineitem WINDOW o AS (PARTITION BY l_returnflag ORDER BY l_quantity)""", doubles="l_quantity avg_rank")
def average_ranks(t):
    return running.average_ranks(t.lineitem, ["l_returnflag"], "l_quantity").select("l_returnflag", "l_quantity", "avg_rank")


@query("quartiles", "A2 W9", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2,
       quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1""", doubles="q1 q2 q3")
def quartiles(t):
    return running.exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query("fold_sizes", "W6 A3", "SELECT fold, y, count(*) AS n FROM folds GROUP BY 1, 2", FOLDS)
def fold_sizes(t):
    return t.folds.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


@query("folds_with_missing_labels", "W5 W6 W7", """
, m AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 11 = 1 THEN '' ELSE CAST(y AS VARCHAR) END AS label FROM folds),
o AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY label) AS n, CAST(ntile(4) OVER w AS INTEGER) AS fold
      FROM m WINDOW w AS (PARTITION BY label ORDER BY md5(concat('5-', id))))
SELECT id, label, CASE WHEN r <= round(n * CAST(0.25 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split, fold FROM o""", FOLDS)
def folds_with_missing_labels(t):
    text = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 11 == 1, "").otherwise(F.col("y").cast("string"))
    return splits.assign(t.members.select("id", text.alias("label")), "id", "label", test_share=0.25, k=4, seed=5)
