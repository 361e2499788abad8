"""Driver contract: entry runs, every query has an oracle."""

import __spark_entry__ as E


def test_entry_count(spark):
    df = E.entry(spark)
    assert df.count() == 1648          # strict legacy records at sf0.001, planted empty ones too
    assert "files" in df.columns and "TM-1" in df.columns


def test_every_query_has_oracle():
    learned = set(E._training_data()[0])  # some of these no SQL can state
    assert set(E.queries()) - learned == set(E.oracle_sql()) - learned
    assert set(E.oracle_sql()) <= set(E.queries())


def test_fixture_counts(spark):
    cf = E._cf(spark, E.SMOKE_DIR)
    assert cf.count() == 6181              # every line item, planted empty folders and clients
    assert cf.select("client_folder", "case_folder").distinct().count() == 1654
