"""Commits and folds of token counts beside each other."""

import pytest

from touchline.llm import token_counts


def test_a_batch_committed_while_folding_counts_once(spark, monkeypatch):
    roll = token_counts.Rollup(spark)
    row = lambda n: spark.createDataFrame([("insert", 1, "s", "en", "v1", n, None, None, None)], token_counts.CHANGES)
    total = lambda: [r["n_tokens"] for r in roll.totals().collect()]
    roll.commit("a", row(1))
    roll.commit("b", row(10))
    put = token_counts.Rollup._put

    def late(self, made, to):
        if "/folds/" in to and not late.done:
            late.done = True
            token_counts.Rollup(spark, self.path).commit("late", row(100))  # between the fold and its rename
        return put(self, made, to)

    late.done = False
    monkeypatch.setattr(token_counts.Rollup, "_put", late)
    before = roll.totals()  # a reader that listed before the fold
    roll.compact()
    assert total() == [111] and before.collect()[0]["n_tokens"] == 11
    assert not roll.commit("late", row(100)) and total() == [111]
    roll.compact()
    roll.compact()
    assert total() == [111] and len(roll.batches()) == 3 and len(roll._names("batches")) < 3
    # a compaction lost before its rename changes nothing
    roll.commit("c", row(1000))
    monkeypatch.setattr(token_counts.Rollup, "_put", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        roll.compact()
    assert total() == [1111]


def test_two_writers_of_one_batch(spark, monkeypatch):
    roll = token_counts.Rollup(spark)
    row = spark.createDataFrame([("insert", 1, "s", "en", "v1", 7, None, None, None)], token_counts.CHANGES)
    assert roll.commit("a", row)
    monkeypatch.setattr(roll, "batches", set)  # the second writer looked before the first had committed
    assert not roll.commit("a", row)
    assert [r["n_tokens"] for r in roll.totals().collect()] == [7] and len(roll._names(f"batches/{roll._names('batches')[0]}")) == 1
