import datetime as dt

import pytest

from leafmill.operators import state

T0 = dt.datetime(2030, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture
def store(spark, tmp_path):
    return state.Store(spark, str(tmp_path / "s"))


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(1, b"x" * 9, [(1, b"pixels")]), (2, None, None)], "n int, content binary, pictures array<struct<xref:int,data:binary>>")


def test_save_load_and_staleness(store, pages):
    assert store.load("f") is None
    store.save("f", pages, T0)
    store.save("f", pages.where("n = 1"), T0 + HOUR)
    (r,) = store.load("f").collect()
    assert r.n == 1 and "content" not in r and r.pictures[0].xref == 1 and r.pictures[0].data is None
    assert store.load("f", T0 + HOUR) is not None and store.load("f", T0 + 2 * HOUR) is None and store.load("g") is None


def test_delete_one_and_all(store, pages):
    store.save("f", pages, T0)
    store.save("g", pages, T0)
    store.delete("f")
    assert store.load("f") is None and store.load("g").count() == 2
    store.delete()
    assert store.load("g") is None


def test_runs(store):
    store.start("r", "f", T0, 3)
    store.start("q", "f", T0)
    store.finish("r", T0 + HOUR, True, 3)
    got = {r.run_id: (r.status, r.pages_total, r.pages_done, r.finished_at) for r in store.runs().collect()}
    assert got == {"r": ("complete", 3, 3, T0 + HOUR), "q": ("running", None, 0, None)}
    with pytest.raises(KeyError):
        store.finish("none", T0, False, 0)


def test_latest_and_first_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n")], "k string, t int, v string")
    assert {tuple(r) for r in state.latest(df, ["k"], ["t"]).collect()} == {("a", 2, "y"), ("b", None, "z"), (None, 1, "n")}
    assert {tuple(r) for r in state.first(df, ["k"], ["t"]).collect()} == {("a", 1, "x"), ("b", None, "z"), (None, 1, "n")}
    assert state.latest(df.where("false"), ["k"], ["t"]).count() == 0
