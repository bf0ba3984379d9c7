"""Intermediate tables and their end."""

from folioflow import storage


def test_tables_made_since_then_go(spark):
    first = storage.written(spark.range(3))
    before = storage.held()
    second, third = storage.written(spark.range(4)), storage.written(spark.range(5))
    storage.discard_since(before, third)
    assert first.count() == 3 and third.count() == 5 and storage.held() - before == {third._folioflow_path} and second._folioflow_path not in storage.held()
    storage.discard(first, third, first)
    assert not {first._folioflow_path, third._folioflow_path} & storage.held()
