import numpy as np
import pytest

from cairn.operators import late, quantiles


def rows(spark, values, width=4):
    parts = [[None if x is None else float(x) for x in values[at : at + width]] for at in range(0, len(values), width)]
    return spark.createDataFrame([(p, [1.0]) for p in parts], "v array<double>, w array<double>").repartition(3)


AT = [0.0, 0.125, 0.25, 0.3, 0.5, 0.75, 0.875, 1.0]


@pytest.mark.parametrize("fetched", [1 << 20, 0])
def test_quantiles_are_exact(spark, monkeypatch, fetched):
    monkeypatch.setattr(quantiles, "MAX_FETCHED", fetched)
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=801), np.repeat([1.5, -2.0, 0.0, -0.0, 3.0], 40), rng.normal(size=64) * 10.0 ** rng.integers(-300, 300, 64), np.array([7.0])):
        got = quantiles.quantiles(rows(spark, list(x)), {"v": AT, "w": [0.5]})
        assert np.allclose(got["v"], np.quantile(x, AT), rtol=1e-12, atol=0)
        assert got["w"] == [1.0]


def test_quantiles_without_values(spark):
    got = quantiles.quantiles(rows(spark, [None] * 8), {"v": [0.5], "w": [0.5]})
    assert got == {"v": [None], "w": [1.0]}


def test_codec_knows_all_tokens(spark):
    x = np.random.default_rng(6).normal(size=(50_400, 2))
    x[50_000:] *= 40
    tokens = spark.createDataFrame([(n // 10, n % 10, v) for n, v in enumerate(x.tolist())], "doc_id long, pos long, v array<double>")
    codec = late.build(tokens, spark.createDataFrame([(0, [0.0, 0.0])], "cid long, c array<double>"))[1]
    assert np.allclose(codec.cutoffs, np.quantile(x, [0.25, 0.5, 0.75]), rtol=1e-12)
    assert np.allclose(codec.weights, np.quantile(x, [0.125, 0.375, 0.625, 0.875]), rtol=1e-12)
    assert np.isclose(codec.threshold, np.quantile(np.linalg.norm(x, axis=1), 0.75), rtol=1e-12)
