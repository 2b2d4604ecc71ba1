import random

import pytest

from tessella.operators import details, matching
from tessella.storage import written


@pytest.mark.parametrize("small", [matching.SMALL if hasattr(matching, "SMALL") else None, 0])
def test_grams_are_never_broadcast(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "SMALL", small)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    outer, inner = [word(rng.randrange(12)) for _ in range(40)], [word(rng.randrange(5)) for _ in range(400)]
    a = written(spark.createDataFrame([(k, x) for k, x in enumerate(outer)], "k long, x string").coalesce(1))
    b = written(spark.createDataFrame([(k, y) for k, y in enumerate(inner)], "i long, y string"))
    got = matching.holding(a, b, "x", "y")
    assert sorted((r.k, r.i) for r in got.collect()) == sorted((k, i) for k, x in enumerate(outer) for i, y in enumerate(inner) if y and y in x)
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = line.index("BroadcastExchange")
            for below in lines[k + 1 :]:
                if len(below) - len(below.lstrip(" :+-")) <= deep:
                    break
                assert "Generate" not in below


def test_references_ask_each_title_once(spark):
    entries = spark.createDataFrame([(k, ["Red bolt", "red BOLT", "blue nut"][k % 3]) for k in range(9)], "id long, title string")
    refs = spark.createDataFrame([("red", "blue", "r"), ("bolt", "NUT", "r"), ("red", "bolt", "r"), ("", "nut", "r")], "from_title string, to_title string, relation string")
    assert [tuple(r) for r in details.cross_references(entries, refs).collect()] == [(0, 2, "r")]
