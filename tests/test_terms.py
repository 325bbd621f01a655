import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiosift.operators.terms import Term, dictionary, expand, expanded, format_terms, linear, n_terms, terms_table


@pytest.mark.parametrize(("p", "d", "bias", "inter"), [(1, 1, True, True), (3, 2, True, True), (4, 3, False, True), (5, 2, True, False)])
def test_count_matches_formula(p, d, bias, inter):
    terms = dictionary(p, d, bias, inter)
    assert len(terms) == len(set(terms)) == n_terms(p, d, bias, inter)
    assert not bias or terms[-1].kind == "bias"


def test_order_and_names():
    assert [t.name(["a", "b"]) for t in dictionary(1, 2, bias=False)] == ["a", "a^2", "a^(-1)", "a^(-2)"]
    assert Term((0, 1), (2, -1)).name(["a", "b"]) == "a^2*b^(-1)"
    assert Term((1, 0), (1, 2)).key == Term((0, 1), (2, 1)).key
    assert format_terms([Term((0,), (2,)), Term((1,), (-1,))]) == ["x_0^2", "x_1^(-1)"]


def test_degree_must_be_positive():
    with pytest.raises(ValueError, match="degree"):
        dictionary(2, 0)


def test_columns_equal_matrices_and_clip(spark):
    x = np.array([[2.0, 3.0], [0.0, 1e-15], [-1e-12, 5.0], [1.5, -2.0]])
    terms = dictionary(2, 3)
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    got = np.array(expand(df, ["a", "b"], terms).collect())
    assert np.isfinite(got).all()
    np.testing.assert_allclose(got, expanded(x, terms), rtol=1e-12)


def test_linear_and_table(spark):
    df = spark.createDataFrame([(2.0, 4.0)], "a double, b double")
    value = linear([Term((0,), (2,)), Term((1,), (-1,))], [3.0, 8.0], 1.0, [F.col("a"), F.col("b")])
    assert df.select(value).first()[0] == 15.0
    assert df.select(linear([], [], 7.0, [])).first()[0] == 7.0
    rows = terms_table(spark, dictionary(2, 1), ["a", "b"]).collect()
    assert [r.kind for r in rows] == ["monomial"] * 4 + ["bias"]
