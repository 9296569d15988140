"""Linear models against plain solutions, and the encoding's rules."""

import numpy as np
import pandas as pd
import pytest

from stallwise.operators import linear


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 1500
    df = pd.DataFrame({"a": rng.normal(3, 2, n), "b": rng.random(n), "kind": rng.choice(["x", "y", "z"], n, p=[0.6, 0.395, 0.005]), "y": 0.0})
    df["c"] = df["a"] + rng.normal(0, 0.01, n)
    df["y"] = 20 + 2 * df["a"] - 5 * df["b"] + 3 * (df["kind"] == "y") + rng.normal(0, 0.5, n)
    df.loc[::13, "b"] = np.nan
    df.loc[5::101, "kind"] = None
    return df


def encoded(df, train):
    """The columns by definition."""
    out = {}
    for c in ("a", "b", "c"):
        filled = train[c].fillna(train[c].median())
        out[c] = (df[c].fillna(train[c].median()) - filled.mean()) / filled.std(ddof=0)
    flag = train["b"].isna().astype(float)
    out["b missing"] = (df["b"].isna() - flag.mean()) / flag.std(ddof=0)
    kind = df["kind"].fillna("x")
    out |= {"kind=x": (kind == "x") * 1.0, "kind=y": (kind == "y") * 1.0, "kind rare": (~kind.isin(["x", "y"])) * 1.0}
    return pd.DataFrame(out)


def frame(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(), "a double, b double, kind string, y double, c double")


@pytest.mark.parametrize("kind, alpha", [("ridge", 1.0), ("ridge", 300.0), ("lasso", 0.05), ("elasticnet", 0.2)])
def test_weights_are_optimal(spark, rows, kind, alpha):
    model = linear.fit_linear(frame(spark, rows).repartition(5), kind, alpha, 0.5, ("a", "b", "c"), ("kind",))
    x = encoded(rows, rows)
    assert list(model.weights) == list(x.columns)
    z, y, w, n = (x - x.mean()).to_numpy(), (rows["y"] - rows["y"].mean()).to_numpy(), np.array(list(model.weights.values())), len(rows)
    if kind == "ridge":
        assert np.allclose(w, np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ y), atol=1e-6)
    else:
        l1, l2 = (alpha, 0) if kind == "lasso" else (alpha / 2, alpha / 2)
        slope = z.T @ (y - z @ w) / n - l2 * w
        assert np.allclose(slope[w != 0], l1 * np.sign(w[w != 0]), atol=1e-6) and (np.abs(slope[w == 0]) <= l1 + 1e-6).all()
        assert (w == 0).any() and (w != 0).sum() >= 2
    said = model.predict(frame(spark, rows)).toPandas()["y_pred"].to_numpy()
    assert np.allclose(said, np.maximum(rows["y"].mean() + z @ w, 0), atol=1e-6)


def test_new_rows_are_encoded_by_what_was_fitted(spark, rows):
    model = linear.fit_linear(frame(spark, rows), "ridge", 1.0, 0.5, ("a", "b", "c"), ("kind",))
    new = pd.DataFrame({"a": [1.0, np.nan], "b": [np.nan, 2.0], "kind": ["never seen", None], "y": [0.0, 0.0], "c": [1.0, 2.0]})
    x = encoded(new, rows)
    want = model.intercept + x.to_numpy() @ np.array(list(model.weights.values()))
    assert np.allclose(model.predict(frame(spark, new)).toPandas()["y_pred"], np.maximum(want, 0), atol=1e-9)
    assert x["kind rare"].tolist() == [1.0, 0.0]


def test_one_kind_one_value_and_no_rows(spark, rows):
    same = rows.assign(a=1.0, kind="x", b=2.0)
    model = linear.fit_linear(frame(spark, same), "lasso", 0.01, 0.5, ("a", "b", "c"), ("kind",))
    assert model.weights["a"] == 0 and "kind rare" not in model.weights and abs(model.weights["c"]) > 1
    with pytest.raises(ValueError, match="no row"):
        linear.fit_linear(frame(spark, rows).limit(0), "ridge", 1.0, 0.5, ("a",), ("kind",))
    with pytest.raises(ValueError, match="kind is"):
        linear.fit_linear(frame(spark, rows), "cubic")
