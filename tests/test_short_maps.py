"""Short maps of edits compose as long ones do, and both sides come from one sweep."""

import random

import numpy as np

from prosemill.operators import navigate as N


def test_lists_equal_arrays():
    rng = random.Random(11)
    for _ in range(400):
        side = rng.choice((-1, 1))
        maps = [N._edit(a := rng.randrange(60), a + rng.choice([0, 1, rng.randrange(9)]), rng.randrange(5), side) for _ in range(rng.randrange(2, 9))]
        short = arrays = maps[0]
        for m in maps[1:]:
            short = N._compose_short(short, m)
            arrays = N.compose(tuple(map(np.asarray, arrays)), m)
        assert [list(x) for x in short] == [x.tolist() for x in arrays]


def test_sides_from_one_reading(spark):
    rng = random.Random(12)
    edits = [(d, i, a := rng.randrange(50), a + rng.randrange(4), rng.randrange(4)) for d in range(5) for i in range(rng.choice([1, 40, 600]))]
    maps = N.composed(spark.createDataFrame(edits, "doc_id long, seq long, `from` long, `to` long, insert long")).persist()
    offsets = spark.createDataFrame([(d, x) for d in range(6) for x in range(0, 90, 7)], "doc_id long, offset long")
    got = {(r["doc_id"], r["offset"]): (r["to_left"], r["to_right"]) for r in N.remap_sides(maps, offsets).collect()}
    left, right = ({(r["doc_id"], r["offset"]): r["moved"] for r in N.remap(maps, offsets, side).collect()} for side in (-1, 1))
    assert len(got) == 6 * 13 and got == {k: (left[k], right[k]) for k in left}
    maps.unpersist()


def test_parts_of_many_documents_are_not_separate_calls(spark, sf_dir):
    from prosemill.plans import queries as Q

    plan = Q.QUERIES["remapped"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "FlatMapGroupsInPandas" not in plan
