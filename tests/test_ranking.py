import random

from pyspark.sql import functions as F

from cairn import session
from cairn.operators.ranking import numbered


def test_positions_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40)) for _ in range(3000)] + [("hot", 7)] * 1500
    table = session.materialise(spark.createDataFrame(rows, "g string, x long").repartition(7), "rows")
    got = numbered(table, [F.desc("x")], "g").collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own))) and {r.total for r in own} == {len(own)}
        assert [r.x for r in own] == sorted((x for h, x in rows if h == g), reverse=True)


def test_one_order_for_all_and_no_rows(spark):
    table = session.materialise(spark.createDataFrame([(3,), (1,), (None,), (2,)], "x long"), "rows")
    assert sorted((r.position, r.x) for r in numbered(table, ["x"]).collect()) == [(0, None), (1, 1), (2, 2), (3, 3)]
    assert numbered(table.limit(0), ["x"]).count() == 0
