"""Near duplicates where rows repeat a doc_id with other texts."""

import random

from pagelight.llm import common, jaccard_join


def test_rows_of_one_id_are_one_node(spark):
    common.ship(spark)
    rng = random.Random(4)
    made = lambda: [f"w{rng.randint(0, 10**9)}" for _ in range(100)]
    rows, want = [], {}
    for k in range(30):  # rows of one id hold two texts; of either another id has a near copy
        one, two = made(), made()
        ids = (100 * k + 5, 100 * k + 7, 100 * k + 9)
        rows += [(ids[0], " ".join(one)), (ids[0], " ".join(two)), (ids[1], " ".join(one[:99])), (ids[2], " ".join(two[:99]))]
        want |= dict.fromkeys(ids, ids[0])
    rows += [(100 * k + 1, " ".join(made())) for k in range(30)]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == len(rows)
    assert all(r.component_id == want.get(r.doc_id, r.doc_id) for r in out)
