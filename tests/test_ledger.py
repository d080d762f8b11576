import datetime as dt
import threading

import pytest

from leafmill.operators import ledger
from leafmill.operators.ledger import WorkLedger

T0 = dt.datetime(2030, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "item string")


def tokens(df):
    return {r.item: r.token for r in df.collect()}


def states(book, items, now):
    return {r.item: r.state for r in book.state(items, now).collect()}


def test_lease_done_and_states(spark, items, tmp_path):
    book = WorkLedger(spark, str(tmp_path))
    assert states(book, items, T0) == {"a": "pending", "b": "pending"}
    got = book.lease(items, "one", "b1", T0)
    assert set(tokens(got)) == {"a", "b"}
    assert states(book, items, T0) == {"a": "leased", "b": "leased"}
    book.finish(got.where("item = 'a'"), "one", "b1", T0 + HOUR)
    assert states(book, items, T0 + HOUR) == {"a": "done", "b": "leased"}
    assert states(book, items, T0 + 100 * HOUR) == {"a": "done", "b": "pending"}


def test_a_retried_lease_gives_what_it_gave(spark, items, tmp_path):
    book = WorkLedger(spark, str(tmp_path))
    first = tokens(book.lease(items, "one", "b1", T0))
    assert tokens(book.lease(items, "one", "b1", T0)) == first
    assert tokens(book.lease(items, "two", "b1", T0)) == {}
    assert states(book, items, T0) == {"a": "leased", "b": "leased"}


def test_a_stale_writer_is_rejected(spark, items, tmp_path):
    book = WorkLedger(spark, str(tmp_path))
    old = book.lease(items, "one", "b1", T0, HOUR)
    old_tokens = tokens(old)
    late = T0 + 2 * HOUR
    new = book.lease(items, "two", "b1", late, HOUR)
    assert all(tokens(new)[k] > old_tokens[k] for k in old_tokens)
    book.finish(spark.createDataFrame(list(old_tokens.items()), "item string, token long"), "one", "b1", late)
    assert states(book, items, late) == {"a": "leased", "b": "leased"}
    assert tokens(book.lease(items, "one", "b1", late)) == {}
    book.finish(new, "two", "b1", late)
    book.finish(new, "two", "b1", late)
    assert states(book, items, late) == {"a": "done", "b": "done"}


def test_failed_items_return(spark, items, tmp_path):
    book = WorkLedger(spark, str(tmp_path))
    got = book.lease(items, "one", "b1", T0)
    book.finish(got, "one", "b1", T0, ok=False)
    assert states(book, items, T0) == {"a": "pending", "b": "pending"}
    assert set(tokens(book.lease(items, "two", "b2", T0))) == {"a", "b"}


def test_owners_that_lease_at_once_share_no_item(spark, tmp_path):
    many = spark.createDataFrame([(f"i{n}",) for n in range(20)], "item string")
    results: dict = {}

    def work(owner):
        results[owner] = tokens(WorkLedger(spark, str(tmp_path)).lease(many, owner, "b", T0))

    threads = [threading.Thread(target=work, args=(f"o{n}",)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    book = WorkLedger(spark, str(tmp_path))
    top = {r.item: r.token for r in book.state(many, T0).collect()}
    # what an owner may finish is what carries the newest token
    valid = [(o, i) for o, got in results.items() for i, t in got.items() if t == top[i]]
    assert sorted(i for _, i in valid) == sorted(top)
    assert len({t for got in results.values() for t in got.values()}) == len([g for g in results.values() if g])


def test_uncommitted_events_are_not_read(spark, items, tmp_path):
    book = WorkLedger(spark, str(tmp_path))
    spark.createDataFrame([("a", "done", 9, "x", T0, None)], WorkLedger.SCHEMA).write.parquet(f"{tmp_path}/data/left-over")
    assert states(book, items, T0) == {"a": "pending", "b": "pending"}


EX, PS, RL = "pdf_path string, created_at timestamp_ntz, word string", "run_id string, pdf_path string, page_num int, status string, updated_at timestamp_ntz", "run_id string, pdf_path string, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def fold(spark, ex, ps, rl=(), now=None):
    got = ledger.ledger(spark.createDataFrame(list(ex), EX), spark.createDataFrame(list(ps), PS), spark.createDataFrame(list(rl), RL), now)
    return {(r.pdf_path, r.page_num): r.state for r in got.collect()}


def test_pages_of_logs(spark):
    ex = [("f", T0, "x"), ("f", T0, "x"), ("g", T0 + 5 * HOUR, None), (None, T0, "x")]
    ps = [
        ("r1", "f", 0, " DONE ", T0 + HOUR), ("r1", "f", 0, " DONE ", T0 + HOUR), ("r1", "f", 1, "done", T0), ("r0", "f", 2, "pending", T0), ("r1", "f", 2, "error", T0 + HOUR),
        ("r1", "f", 3, "done", T0 + HOUR), ("r2", "f", 3, "error", T0 + HOUR), ("r1", "f", 4, None, T0), ("r1", "g", 0, "done", T0 + HOUR), ("r1", "h", 0, "pending", T0), ("r1", "f", None, "done", T0), ("r1", "f", 5, "done", None),
    ]
    assert fold(spark, ex, ps) == {("f", 0): "done", ("f", 1): "done", ("f", 2): "pending", ("f", 3): "pending", ("f", 4): "pending", ("g", 0): "pending"}


def test_leases_of_runs_expire(spark):
    ex, ps = [("f", T0, "x")], [("reg", "f", 0, "pending", T0), ("reg", "f", 1, "pending", T0), ("run", "f", 1, "error", T0 + 2 * HOUR)]
    live = [("run", "f", T0 + HOUR, None, "running")]
    assert fold(spark, ex, ps, live, T0 + 3 * HOUR) == {("f", 0): "leased", ("f", 1): "pending"}
    assert fold(spark, ex, ps, live, T0 + 9 * HOUR) == {("f", 0): "pending", ("f", 1): "pending"}
    over = [("run", "f", T0 + HOUR, T0 + 2 * HOUR, "failed")]
    assert fold(spark, ex, ps, over, T0 + 3 * HOUR) == {("f", 0): "pending", ("f", 1): "pending"}


def test_empty_logs(spark):
    assert fold(spark, [], []) == {}
