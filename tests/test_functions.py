"""Functions and operators on nulls, several alphabets, ties, empty tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.operators import aggregates as A
from brindle.operators import dml as M
from brindle.operators import joins as J
from brindle.operators import relational as R
from brindle.sources.tables import values
from brindle.sql.locks import COMPATIBLE, MODES, combined


def test_int_div(spark):
    rows = values(spark, [(7, 2), (-7, 2), (7, -2), (None, 2)], "a int, b int")
    assert [r[0] for r in rows.select(S.int_div(F.col("a"), F.col("b"))).collect()] == [3, -3, -3, None]
    with pytest.raises(PySparkException):
        values(spark, [(1, 0)], "a int, b int").select(S.int_div(F.col("a"), F.col("b"))).collect()


def test_strings(spark):
    rows = values(spark, [("aÉ中",), ("",), (None,)], "s string")
    got = rows.select(S.byte_length(F.col("s")), S.lower(F.col("s")), S.upper(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(6, "aé中", "AÉ中"), (0, "", ""), (None, None, None)]
    with pytest.raises(PySparkException):
        values(spark, [("x",)], "s string").select(S.to_bool(F.col("s"))).collect()


def test_values_checks_every_row(spark):
    with pytest.raises(ValueError):
        values(spark, [(1,), (1, 2)], "a int")
    with pytest.raises(Exception):
        values(spark, [(1,), ("x",)], "a int").collect()


def test_nulls_never_join(spark):
    a = values(spark, [(1,), (None,)], "x int")
    b = values(spark, [(1,), (None,)], "y int")
    on = F.col("x") == F.col("y")
    counts = {how: J.join(a, b, on, how).count() for how in J.KINDS}
    assert counts == {"inner": 1, "left": 2, "right": 2, "full": 3, "semi": 1, "anti": 1}
    for algorithm in J.HINTS:
        assert J.join(a, b, on, "inner", algorithm).count() == 1


def test_groups_sorts_and_limits(spark):
    rows = values(spark, [(None, 1), (None, 2), (1, None), (1, 3)], "k int, v int")
    got = R.order_by(A.aggregate(rows, ["k"], n=A.count_star(), s=F.sum("v"), c=F.count("v")), "k")
    assert [tuple(r) for r in got.collect()] == [(1, 2, 3, 1), (None, 2, 3, 2)]
    assert [r[0] for r in R.order_by(rows, ("v", "desc")).select("v").collect()] == [3, 2, 1, None]
    assert R.limit(R.order_by(rows, "v"), 2, 1).count() == 2
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            R.limit(rows, *bad)
    empty = rows.where("false")
    assert [tuple(r) for r in A.aggregate(empty, [], n=A.count_star(), s=F.sum("v")).collect()] == [(0, None)]
    assert A.aggregate(empty, ["k"], n=A.count_star()).count() == 0
    assert sorted(map(tuple, A.analyze(rows).collect())) == [("k", 1, 4), ("v", 3, 4)]
    assert sorted(map(tuple, A.analyze(empty).collect())) == [("k", 0, 0), ("v", 0, 0)]


def test_changes_with_null_conditions(spark):
    rows = values(spark, [(1,), (5,), (None,)], "v int")
    low = F.col("v") < 3
    assert sorted(M.update(rows, {"v": F.col("v") + 1}, low).collect(), key=str) == [(2,), (5,), (None,)]
    assert sorted(M.delete(rows, low).collect(), key=str) == [(5,), (None,)]
    assert M.delete(rows).count() == 0
    with pytest.raises(ValueError):
        M.update(rows, {"w": F.lit(1)})
    with pytest.raises(ValueError):
        M.insert(rows, values(spark, [(1, 2)], "a int, b int"))


@given(st.sampled_from(MODES), st.sampled_from(MODES), st.sampled_from(MODES))
@settings(max_examples=125, deadline=None)
def test_lock_modes(a, b, c):
    assert (b in COMPATIBLE[a]) == (a in COMPATIBLE[b])
    both = combined(a, b)
    assert combined(b, a) == both and combined(both, a) == both
    assert (c in COMPATIBLE[both]) <= (c in COMPATIBLE[a] and c in COMPATIBLE[b])
