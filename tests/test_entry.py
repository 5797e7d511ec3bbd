import __spark_entry__ as entry_module


def test_every_oracle_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
