"""Sources, catalog, schema checks and sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskfold.operators import columns as C
from riskfold.plans import report as RP
from riskfold.sources import Catalog, ColumnInfo, check_schema, get_dataset, read_infos, read_table
from riskfold.sources.cohorts import ORDER_CATALOG, order_cohort
from tests.conftest import SF001


def _tmp():
    return tempfile.mkdtemp(prefix="riskfold-test-")


def test_csv_with_preamble_and_semicolon(spark):
    oc = order_cohort(spark, SF001).select("row_id", "total", "segment").orderBy("row_id").limit(50).toPandas()
    path = os.path.join(_tmp(), "cohort.csv")
    with open(path, "w") as fh:
        fh.write("export v1\nsite A\n\n")
        oc.to_csv(fh, sep=";", index=False)
    df = read_table(spark, path, delimiter=";", skip_lines=3)
    assert df.columns == ["row_id", "total", "segment"]
    got = df.orderBy("row_id").toPandas()
    assert len(got) == 50 and got["total"].round(6).tolist() == oc["total"].round(6).tolist()


def test_read_infos_and_lookups(spark):
    path = os.path.join(_tmp(), "infos.csv")
    with open(path, "w") as fh:
        fh.write(",column_name,endpoint,data_type,input time,drop\n")
        fh.write("0,Na+,False,N,pre,False\n1,LOS>28d,True,B,,False\n2,MittlereTemp.[°C],False,N,intra,True\n"
                 "3,sex,False,B,pre,False\n")
    cat = read_infos(spark, path)
    assert cat.numerical_features() == ["Na+", "MittlereTemp.[°C]"]
    assert cat.numerical_features(include_drop=False) == ["Na+"]
    assert cat.binary_endpoints() == ["LOS>28d"]
    assert cat.feature_set(["pre"]) == ["Na+", "sex"]


def test_schema_check_names_unknown_columns(spark):
    oc = order_cohort(spark, SF001).withColumn("mystery", F.lit(1))
    with pytest.raises(ValueError, match="mystery"):
        check_schema(oc, ORDER_CATALOG)
    check_schema(order_cohort(spark, SF001), ORDER_CATALOG)


def test_catalog_vs_data_anti_and_semi(spark):
    df, *_ = C.select_columns(order_cohort(spark, SF001), ORDER_CATALOG)
    missing, present = C.catalog_vs_data(spark, ORDER_CATALOG, df)
    assert [r[0] for r in missing.collect()] == ["yr"]
    assert present.count() == len(ORDER_CATALOG.rows) - 1


def test_registry_and_unknown_name(spark):
    train, ext, cat = get_dataset("orders", spark, sf_dir=SF001, external=True)
    assert train.count() + ext.count() == 1500 and cat is ORDER_CATALOG
    with pytest.raises(KeyError):
        get_dataset("pancreas", spark)


def test_catalog_rejects_bad_kind():
    with pytest.raises(ValueError):
        Catalog.of([ColumnInfo("x", False, "Q")])


def test_results_sink_partitioned(spark):
    df = spark.createDataFrame([("returned", 42, "logistic", 0, 0.7)],
                               "endpoint string, seed int, model string, fold int, roc_auc double")
    path = os.path.join(_tmp(), "metrics")
    RP.write_results(df, path, run_id="r1")
    back = spark.read.parquet(path)
    assert set(back.columns) >= {"endpoint", "seed", "model", "run_id", "roc_auc"}
    assert os.path.isdir(os.path.join(path, "endpoint=returned", "seed=42", "model=logistic"))


def test_metrics_map_to_json(spark):
    fm = spark.createDataFrame([("e", "m1", f, float(f), 0.5, 0.5, 0.0, 0.5, 0.6, 0.7, 0.8) for f in range(3)],
                               "endpoint string, model string, fold int, balanced_accuracy double, recall double, "
                               "precision double, mcc double, f1_score double, roc_auc double, "
                               "avg_precision double, prc_auc double")
    out = RP.metrics_map(fm).filter("metric = 'balanced_accuracy'").select(F.to_json("values")).first()[0]
    assert json.loads(out) == {"m1": [0.0, 1.0, 2.0]}
