import __spark_entry__ as entry
from timberline import catalog


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_optional_part_is_whole_or_absent():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    there = entry._there("timberline.llm")
    assert len(names) == (10 if there else 0) and ("pipeline" in entry.queries()) == (there and entry._there("corpus_pipeline"))
