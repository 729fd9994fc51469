"""Rows of groups: numbers come all at once, with their digits, and nulls as None."""

import pyarrow as pa
import pytest

from strandline.operators import groups


def test_rows_are_those_of_arrow():
    big = 9007199254740993
    batch = pa.record_batch(
        {"a": pa.array([1, None, big, -big], pa.int64()), "b": pa.array([1, 2, 3, 4], pa.int32()), "c": pa.array([0.1, None, -0.0, 1e300]), "d": pa.array([True, None, False, True]), "e": pa.array(["x", None, "", "y"]),
         "f": pa.array([[1, None], None, [], [big]]), "g": pa.array([{"k": 1}, None, {"k": None}, {"k": 2}])}
    )
    assert [list(r.items()) for r in groups.rows_of(batch)] == [list(r.items()) for r in batch.to_pylist()]
    assert repr(list(groups.rows_of(batch))) == repr(batch.to_pylist())
    assert list(groups.rows_of(batch.slice(1, 2))) == batch.slice(1, 2).to_pylist()


def test_numbers_are_not_made_one_by_one(monkeypatch):
    batch = pa.record_batch({"a": pa.array(range(1000)), "b": pa.array([None, 5] * 500)})
    monkeypatch.setattr(groups.pa.types, "is_integer", lambda kind: True)
    with pytest.raises(ValueError):
        groups._values(pa.array(["x"])).index(1)
    assert [groups._values(c) for c in batch.columns] == [c.to_pylist() for c in batch.columns]
