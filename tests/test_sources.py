"""Named sources with skip-if-absent, CSV fallback and CSV landing (A1-A3)."""
import os
import tempfile

import pytest

from ledgerhawk.sources.tables import land_csv, load_transactions


def test_load_with_fallback_and_skip(spark):
    d = tempfile.mkdtemp(prefix="lh-src-", dir="/tmp")
    spark.createDataFrame([("a", "b", 10.0, 1), ("c", "c", 5.0, 0)], "nameOrig string, nameDest string, amount double, "
                          "isFraud int").write.parquet(os.path.join(d, "paysim.parquet"))
    with open(os.path.join(d, "nigerian.csv"), "w") as f:
        f.write("sender_account,receiver_account,amount_ngn\nx,y,abc\nx,z,7.5\n")
    df = load_transactions(spark, [
        dict(path=os.path.join(d, "nigerian.parquet"), name="nigerian", cust="sender_account",
             dest="receiver_account", amount="amount_ngn", label="is_fraud"),
        dict(path=os.path.join(d, "paysim.parquet"), name="paysim", cust="nameOrig", dest="nameDest",
             amount="amount", label="isFraud"),
        dict(path=os.path.join(d, "cifer.parquet"), name="cifer", cust="nameOrig", dest="nameDest", amount="amount")])
    rows = sorted(map(tuple, df.collect()))
    assert ("x", "y", 0.0, 0, "nigerian") in rows and ("a", "b", 10.0, 1, "paysim") in rows and len(rows) == 4
    with pytest.raises(ValueError):
        load_transactions(spark, [dict(path=os.path.join(d, "none.parquet"), name="n", cust="a", dest="b",
                                       amount="c")])


def test_land_csv(spark):
    d = tempfile.mkdtemp(prefix="lh-land-", dir="/tmp")
    with open(os.path.join(d, "in.csv"), "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    out = land_csv(spark, os.path.join(d, "in.csv"), os.path.join(d, "out"))
    assert out.count() == 2 and os.path.exists(os.path.join(d, "out_schema"))
