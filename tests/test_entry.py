import __spark_entry__ as E


def test_names_match():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 40


def test_entry_runs(spark):
    assert E.entry(spark).limit(1).count() == 1
