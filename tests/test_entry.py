import __spark_entry__ as entry


def test_every_sql_has_a_query_and_every_problem_one():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {"p2_found", "p3_found", "p5_found", "p6_found", "health_report"} <= set(names)
