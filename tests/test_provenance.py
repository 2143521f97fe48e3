"""Provenance along derivations against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import provenance


@pytest.mark.parametrize("loops", [0, 6])
def test_against_plain_walks(spark, loops):
    r = random.Random(loops)
    ids = [f"r{i:03d}" for i in range(120)]
    records = [(x, r.choice([None, None, f"lic{r.randint(0, 5)}"]), r.choice([None, "s1", "s2", "s3"])) for x in ids]
    edges = [(ids[i], ids[r.randint(0, i - 1)]) for i in range(1, 120) for _ in range(r.randint(0, 2))]
    edges += [(ids[i], ids[min(119, i + r.randint(0, 9))]) for i in r.sample(range(120), loops)]
    edges += edges[:5] + [("r001", None), (None, "r001"), ("r001", "gone"), ("gone", "r002")]
    inputs = {x: {b for a, b in edges if a == x and b in ids} for x in ids}
    license_, source = {x: l for x, l, _ in records}, {x: s for x, _, s in records}
    want = {}
    for x in ids:
        near, seen, level, steps = None, set(), {x}, 0
        while level and near is None:
            with_one = sorted(y for y in level if license_[y])
            if with_one:
                near = (license_[with_one[0]], with_one[0], steps)
            seen |= level
            level, steps = {b for y in level for b in inputs[y]} - seen, steps + 1
        above, todo = set(), [x]
        while todo:
            for b in inputs[todo.pop()]:
                if b not in above:
                    above.add(b)
                    todo.append(b)
        want[x] = [near, sorted({source[y] for y in above | {x}} - {None}), x in above]
    # between two cycles
    on = {x for x in ids if want[x][2]}
    reach = {}
    for x in ids:
        above, todo = set(), [x]
        while todo:
            for b in inputs[todo.pop()]:
                if b not in above:
                    above.add(b)
                    todo.append(b)
        reach[x] = above
    for x in ids:
        want[x][2] = bool(reach[x] & on) and any(x in reach[y] or x == y for y in on)
    df = spark.createDataFrame(records + records[:3], "id string, license string, source_id string").repartition(3)
    got = provenance.with_provenance(df, spark.createDataFrame(edges, "id string, input string"), ["license"]).collect()
    assert {g.id: [g.license and tuple(g.license), g.sources, g.cyclic] for g in got} == want
    assert len(got) == 120 and any(g.cyclic for g in got) == bool(loops)


def test_empty_and_pointer(spark):
    none = spark.createDataFrame([], "id string, license string, source_id string")
    assert provenance.with_provenance(none, spark.createDataFrame([], "id string, input string"), ["license"]).count() == 0
    row = spark.range(1).select(provenance.record_pointer(F.lit("css_selector+text_quote"), css_selector=F.lit("p"), text_quote=F.lit("q"), entry_index=F.lit(3)).alias("p")).first().p
    assert row.asDict() == {"kind": "css_selector+text_quote", "css_selector": "p", "text_quote": "q", "entry_index": None}
