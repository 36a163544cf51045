"""Feature frames, snapshots, ranks of levels."""

from pyspark.sql import functions as F

from ledgerhawk.operators import accounts as acc
from ledgerhawk.operators import frames as fr
from ledgerhawk.sources import snapshots as sn

TXNS = [(1, "a", "b", 10.0, 0, "x"), (2, "a", "c", 25.5, 0, "y"), (3, "b", "c", 7.25, 1, "x"), (4, "c", "a", 100.0, 0, "y"),
        (5, "d", "a", 3.0, 0, "x"), (6, "a", "b", 12.0, 1, "y"), (7, "e", "e", 5.0, 0, "x")]


def txns(spark):
    return spark.createDataFrame(TXNS, "txn_id long, cust_id string, dest_id string, amount double, label int, dataset string").withColumn(
        "ts", F.timestamp_seconds(F.col("txn_id") * 1000)).withColumn("step", F.col("txn_id"))


def test_graph_training_frame_has_84_columns(spark):
    got = fr.graph_training_frame(txns(spark))
    keys = ["txn_id", "cust_id", "dest_id", "label"]
    assert len(got.columns) - len(keys) == 84 and len(set(got.columns)) == 88
    rows = {r["txn_id"]: r for r in got.collect()}
    assert len(rows) == len(TXNS)
    assert rows[1]["cust_count"] == 3 and rows[1]["device_switching_rate"] == 2 / 3
    assert rows[7]["cust_pagerank"] == 0 and rows[7]["dest_degree_centrality"] == 0  # no edge: not in the graph
    assert rows[5]["dest_degree_centrality"] == 1.0 and rows[5]["cust_degree_centrality"] == 1 / 3


def test_frozen_node_table_gives_zero_to_unknown_accounts(spark):
    nodes = spark.createDataFrame([("a", 0.5)], "node string, pagerank double")
    got = {r["txn_id"]: r for r in fr.graph_training_frame(txns(spark), nodes).collect()}
    assert (got[1]["cust_pagerank"], got[1]["dest_pagerank"], got[4]["dest_pagerank"]) == (0.5, 0.0, 0.5)


def test_feature_lists_and_selection(spark):
    assert [len(x) for x in (fr.BEHAVIORAL, fr.FINANCIAL, fr.SECURITY)] == [20, 42, 31]
    df = spark.createDataFrame([(1, 2.0, 3.0)], "txn_id long, step double, amount double")
    assert fr.select_features(df, fr.SECURITY, ["txn_id"]).columns == ["txn_id", "amount", "step"]


def test_session_switching_of_single_and_null(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", None), ("c", None)], "cust_id string, dest_id string")
    got = {r[0]: (r[1], r[2]) for r in acc.session_switching(d).collect()}
    assert got == {"a": (2 / 3, 1 / (1 + 2 / 3)), "b": (0.0, 1.0), "c": (0.0, 1.0)}


def test_label_encode_ranks_over_partitions(spark):
    d = spark.range(3000).select((F.col("id") * 7 % 997).cast("string").alias("v")).union(spark.createDataFrame([(None,)], "v string"))
    got = {r["v"]: r["code"] for r in acc.label_encode(d, "v", "code").distinct().collect()}
    assert got.pop(None) is None
    assert got == {v: i for i, v in enumerate(sorted(got))}


def test_importance_and_evaluation_files(spark, tmp_path):
    imp = spark.createDataFrame([("b", 0.25), ("a, \"q\"", 0.25), ("c", 0.5)], "feature string, importance double")
    sn.write_importance(imp, f"{tmp_path}/imp")
    sn.write_importance(imp, f"{tmp_path}/imp")  # a repeated write replaces
    assert sorted(map(tuple, sn.read_importance(spark, f"{tmp_path}/imp").collect())) == sorted(map(tuple, imp.collect()))
    m = spark.createDataFrame([("x", 0.7), ("y", 0.9), ("z", 0.9)], "model string, auc double")
    sn.write_evaluation(m, f"{tmp_path}/ev")
    detail, summary = sn.read_evaluation(spark, f"{tmp_path}/ev", "model string, auc double")
    assert detail.count() == 3 and tuple(summary.first()) == (3, "auc", "z", 0.9)


def test_financial_rows_are_not_shuffled_by_their_few_types(spark):
    """Two shuffles of the rows, by destination and by customer; types join where the rows are."""
    from ledgerhawk.operators.features import financial_training_features
    rows = [(i, f"c{i % 7}", f"d{i % 5}", 10.0 * i + 1, 100.0, 100.0 - i, i, [None, "TRANSFER", "PAYMENT"][i % 3]) for i in range(60)]
    t = spark.createDataFrame(rows, "txn_id long, cust_id string, dest_id string, amount double, oldbalanceOrg double, newbalanceOrig double, "
                                    "step long, type string")
    out = financial_training_features(t)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [type" in plan and out.columns[:3] == ["type", "dest_id", "cust_id"]
    got = {r["txn_id"]: r for r in out.collect()}
    assert len(got) == 60 and got[3]["type_encoded"] is None and got[3]["amount_zscore_by_type"] is None
    assert {got[i]["type_encoded"] for i in range(60) if i % 3 == 1} == {1} and {got[i]["type_encoded"] for i in range(60) if i % 3 == 2} == {0}
    assert got[4]["customer_txn_count"] == 8 and got[4]["dest_txn_count"] == 12
