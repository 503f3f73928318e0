import __spark_entry__ as entry


def test_the_estimates_stand_first():
    assert next(q for q in entry.queries() if q.startswith("p4_")) == "p4_distinct"
