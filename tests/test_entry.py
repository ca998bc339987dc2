import __spark_entry__ as entry


def test_every_statement_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and all(r["max_drawdown"] > 0 for r in rows)


def test_every_test_module_has_a_name_of_its_own():
    from collections import Counter
    from pathlib import Path

    names = Counter(p.name for p in Path(__file__).parent.rglob("test_*.py"))
    assert [n for n, k in names.items() if k > 1] == []
