import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def walk(n: int, seed: int = 7, symbol: str = "HOT") -> pd.DataFrame:
    """Log-normal minute bars without gaps."""
    g = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(g.normal(0, 0.002, n)))
    opened = np.r_[close[0], close[:-1]]
    top, low = np.maximum(opened, close), np.minimum(opened, close)
    return pd.DataFrame({
        "symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "open": opened,
        "high": top * (1 + np.abs(g.normal(0, 0.0015, n))), "low": low * (1 - np.abs(g.normal(0, 0.0015, n))),
        "close": close, "volume": g.lognormal(4, 0.6, n)})


@pytest.fixture(scope="session")
def two_walks():
    """One long and one short series: the long one holds most rows."""
    return pd.concat([walk(900), walk(150, 3, "COLD")], ignore_index=True)
