"""Exact quantiles against pandas, with ties and one group that holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import series
from barloom.operators.quantiles import exact_quantiles


def test_exact_quantiles(spark, monkeypatch):
    g = np.random.default_rng(3)
    hot = np.r_[np.round(g.normal(size=4000), 1), np.zeros(3000), g.pareto(1.0, 500)]
    pdf = pd.concat([pd.DataFrame({"k": "hot", "x": hot, "y": g.random(len(hot))}), pd.DataFrame({"k": "one", "x": [5.0], "y": [np.nan]}), pd.DataFrame({"k": "few", "x": [1.0, 2, 4], "y": [3.0, np.nan, 1.0]})])
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    wanted = {"a": ("x", 0.005), "b": ("x", 0.5), "c": ("y", 0.97), "d": ("x", 1.0)}
    for accuracy, band_rows, most in ((2_000, 50_000, 50_000), (10, 20, 0)):  # brackets in several bands, tables by salt
        monkeypatch.setattr(series.look_up, "__defaults__", ("inner", most))
        got = exact_quantiles(df, ["k"], wanted, accuracy, band_rows).toPandas().set_index("k")
        for out, (c, q) in wanted.items():
            want = pdf.groupby("k")[c].quantile(q)
            for k in want.index:
                assert got.loc[k, out] == pytest.approx(want[k], nan_ok=True, abs=1e-12)
    assert exact_quantiles(df, [], {"m": ("x", 0.5)}).first()["m"] == pytest.approx(pdf["x"].median())
