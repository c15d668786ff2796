"""Cleaning, splitting, entity state, sources and saved models."""

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import clean as C
from riskgraph.operators import entity as N
from riskgraph.operators import split as P
from riskgraph.operators import temporal as T
from riskgraph.sources import readers, sinks

RAW = ("TransactionID long, TransactionDT long, TransactionAmt double, isFraud int, ProductCD string, card1 long, "
       "V1 double, V2 double, D1 double, C1 double, M1 string, id_01 double, id_30 string, P_emaildomain string, addr1 double")


def raw(spark, n=8):
    rows = [(i, i * 10, float(i), i % 2, "WC"[i % 2], 5, None if i else 1.0, float(i), None if i == 3 else 1.0,
             None if i == 2 else 2.0, None if i == 1 else "T", None if i < 4 else 7.0, None, "a.com" if i < 4 else None,
             None if i == 6 else 3.0) for i in range(n)]
    return spark.createDataFrame(rows, RAW)


def test_families(spark):
    f = C.families(raw(spark).schema)
    assert f["v"] == ["V1", "V2"] and f["id_numeric"] == ["id_01"] and f["id_categorical"] == ["id_30"]
    assert f["other_categorical"] == ["ProductCD"] and f["other_numeric"] == ["TransactionAmt", "card1", "addr1"]


def test_fill_and_flags(spark):
    df = raw(spark)
    m = C.fit_clean(df, C.CleanConfig(scale="none"))
    out = {r["TransactionID"]: r for r in m.fill(df).collect()}
    assert m.dropped == ["V1"]
    assert (out[3]["D1"], out[3]["D1__isna"], out[2]["C1"], out[1]["M1"]) == (-1.0, 1, 0.0, "missing")
    assert (out[6]["addr1"], out[6]["addr1__isna"], out[0]["id_30"], out[7]["P_emaildomain"]) == (-999.0, 1, "unknown", "unknown")
    assert "C1__isna" not in out[0].asDict() and out[0]["V2__isna"] == 0


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(i, i, None if i < 3 else 1.0) for i in range(4)], "TransactionID long, TransactionDT long, V1 double")
    assert C.fit_clean(df).dropped == []


def test_schema_is_stable_and_unseen_is_zero(spark):
    df = raw(spark)
    m = C.fit_clean(df)
    new = raw(spark, 1).withColumn("ProductCD", F.lit("S"))
    a, b = m.transform(df), m.transform(new)
    assert a.columns == b.columns and b.first()["ProductCD"] == 0
    assert {r["ProductCD"] for r in a.collect()} == {1, 2}
    assert {r["column"]: r["n_unseen"] for r in m.unseen(new).collect()}["ProductCD"] == 1
    x = a.agg(F.avg("V2"), F.stddev_pop("V2")).first()
    assert x[0] == pytest.approx(0) and x[1] == pytest.approx(1)


def test_saved_state_gives_the_same_rows(spark, tmp_path):
    df = raw(spark)
    m = C.fit_clean(df)
    sinks.save_model(m, str(tmp_path / "m"))
    again = sinks.load_model(spark, C.CleanModel, str(tmp_path / "m"))
    assert m.transform(df).exceptAll(again.transform(df)).count() == 0
    with pytest.raises(RuntimeError):
        sinks.save_model(None, str(tmp_path / "x"))
    t = T.fit_temporal(df)
    sinks.save_model(t, str(tmp_path / "t"))
    t2 = sinks.load_model(spark, T.TemporalModel, str(tmp_path / "t"))
    assert t.transform(df).exceptAll(t2.transform(df)).count() == 0
    e = N.fit_entity(df)
    sinks.save_model(e, str(tmp_path / "e"))
    e2 = sinks.load_model(spark, N.EntityModel, str(tmp_path / "e"))
    assert e.transform(df).exceptAll(e2.transform(df)).count() == 0


def times(spark, ts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(ts)], "TransactionID long, TransactionDT long, isFraud int")


@pytest.mark.parametrize("min_rows", [10**6, 50])
def test_split_sizes(spark, min_rows):
    s = P.temporal_split(times(spark, [i // 3 for i in range(300)]), min_rows=min_rows)
    summary = P.split_summary(s)
    assert {r["split"]: r["n"] for r in summary.collect()} == {"train": 180, "val": 60, "test": 60}
    P.assert_ordered(summary)
    s = P.temporal_split(times(spark, range(1000)), (0.7, 0.15, 0.15))
    assert {r["split"]: r["n"] for r in P.split_summary(s).collect()} == {"train": 700, "val": 150, "test": 150}


def test_split_errors(spark):
    for bad, kw in ((times(spark, [1]).drop("TransactionDT"), {}), (times(spark, [1]).filter("false"), {}),
                    (times(spark, [1, None]), {}), (times(spark, [1]), {"fractions": (0.5, 0.2, 0.2)})):
        with pytest.raises(ValueError):
            P.temporal_split(bad, **kw)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_entity_lookup_for_numeric_and_text_cards(spark, kind):
    df = raw(spark).withColumn("card1", F.col("card1").cast(kind)).withColumn("TransactionAmt", F.lit(4.0))
    m = N.fit_entity(df)
    r = m.transform(df).first()
    assert r["feat_card_mean_amt"] == 4.0 and r["feat_card_count"] == 8
    new = m.transform(df.withColumn("card1", F.lit("77").cast(kind)).limit(1)).first()
    assert new["feat_card_count"] == 0 and new["feat_card_mean_amt"] == m.amount_mean and new["feat_new_device_for_card"] == 0
    moved = m.transform(df.withColumn("DeviceInfo", F.lit("other phone"))).first()
    assert moved["feat_new_device_for_card"] == 1
    assert len(m.transform(df).columns) == 53


def test_median_of_large_groups_is_the_same(spark):
    df = raw(spark)
    a = N.entity_stats(N.with_entity_keys(df), "_card", rows=8).first()
    b = N.entity_stats(N.with_entity_keys(df), "_card", max_group=3).first()
    assert a["median_amt"] == b["median_amt"] == 3.5


def test_loaders(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    raw(spark).select("TransactionID", "TransactionDT", "TransactionAmt", "V2", "id_01", "P_emaildomain").write.option("header", True).csv(p)
    df = readers.load_frame(spark, p)
    assert dict(df.dtypes)["TransactionID"] == "bigint" and dict(df.dtypes)["id_01"] == "double" and df.count() == 8
    with pytest.raises(ValueError):
        readers.load_frame(spark, "x.xlsx")
    bad = tmp_path / "bad.csv"
    bad.write_text("TransactionID,TransactionAmt\n1,2.5\n2,abc\n")
    good, rejected = readers.read_csv_checked(spark, str(bad), readers.csv_schema(["TransactionID", "TransactionAmt"]))
    assert good.count() == 1 and rejected.count() == 1
    tx = raw(spark).select("TransactionID")
    assert readers.join_identity(tx, None) is tx
    s = readers.sample_rows(tx, 3, 1)
    assert s.count() == 3 and s.exceptAll(readers.sample_rows(tx, 3, 1)).count() == 0


def test_null_columns_and_empty_fit(spark):
    df = raw(spark).withColumn("id_01", F.lit(None).cast("double"))
    assert N.bin_risk(df, "id_01") is None
    assert N.fit_entity(df).transform(df).first()["feat_id_01_bin_risk"] == pytest.approx(0.5)


def test_csv_keeps_large_keys_and_sorts_out_bad_cells(spark, tmp_path):
    p, i = tmp_path / "t.csv", tmp_path / "i.csv"
    p.write_text("TransactionID,TransactionDT,TransactionAmt,card1,card2\n1,99999999999,1.25,16777216,1.0\n2,5,2.5,16777217.0,\n3,6,oops,7,8\n")
    i.write_text("TransactionID,id_01,id_30\n1,-5.0,os 1\n2,x,\n")
    good, bad = readers.load_raw_checked(spark, str(p), str(i))
    rows = {r.TransactionID: r for r in good.collect()}
    assert rows[1].TransactionDT == 99999999999 and (rows[1].card1, rows[2].card1) == (16777216, 16777217)
    assert rows[1].id_01 == "-5.0"  # a text in one row makes the column text
    assert [(r.source, '"TransactionAmt":"oops"' in r.rejected) for r in bad.collect()] == [("transactions", True)]
    with pytest.raises(Exception, match="TransactionAmt cannot hold oops"):
        readers.load_raw(spark, str(p), None).collect()


def test_codes_are_looked_up_not_recomputed(spark):
    df = raw(spark)
    plan = C.fit_clean(df).encode(df.select("TransactionID", "P_emaildomain"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
