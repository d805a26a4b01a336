import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import merkle, merkle_partial
from tesserae.operators.merkle_partial import Part, merged, merkle_hashes_of_parts, part_of, root


def nodes(seed, n, hot=False):
    rng = random.Random(seed)
    pool = [rng.randbytes(32).hex() for _ in range(3 if hot else max(n, 1))]
    return [(rng.choice(pool) if hot else pool[i], rng.randrange(1000)) for i in range(n)]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 23, 60])
def test_every_split_gives_the_whole(n, hot):
    for seed in range(3):
        x = nodes(seed, n, hot)
        want = merkle.roots([x])[0]
        for k in range(n + 1):
            assert root(merged(part_of(x[:k], True), part_of(x[k:], False))) == want


def test_merging_is_associative_and_small():
    rng = random.Random(9)
    for n in (100, 1000, 5000):
        x = nodes(n, n)
        cuts = sorted(rng.sample(range(n), 12))
        parts = [part_of(x[a:b], a == 0) for a, b in zip([0, *cuts], [*cuts, n])]
        want = merkle.roots([x])[0]
        left = parts[0]
        for p in parts[1:]:
            left = merged(left, p)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [merged(parts[k], parts[k + 1])]
        assert root(left) == root(parts[0]) == root(Part.load(parts[0].dump())) == want
        middle = part_of(x, False)
        assert sum(len(v.left) + len(v.right) for v in middle.levels) < 600


def test_parts_in_spark_equal_whole_lists(spark):
    rows = [(f, i, h, s) for f in range(3) for i, (h, s) in enumerate(nodes(f, 30 + 170 * f))]
    df = spark.createDataFrame(rows, "file_id long, chunk_idx long, chunk_hash string, length long")
    a = {r["file_id"]: r["file_hash"] for r in merkle.merkle_hashes(df).collect()}
    b = {r["file_id"]: r["file_hash"] for r in merkle_hashes_of_parts(df.orderBy(F.rand(1)), 37).collect()}
    assert a == b


def test_parts_are_hashed_side_by_side(monkeypatch):
    lists = [nodes(i, 5 + i % 40) for i in range(200)]
    calls, hashed = [], merkle_partial.keyed_hashes
    monkeypatch.setattr(merkle_partial, "keyed_hashes", lambda messages, key: calls.append(len(messages)) or hashed(messages, key))
    made = merkle_partial.in_step([merkle_partial.making_part(x, True) for x in lists])
    assert merkle_partial.in_step([merkle_partial.closing(p) for p in made]) == merkle.roots(lists)
    # a call for each level, not for each list
    assert len(calls) < 15 and sum(calls) > 1000


def test_slices_hold_all_lists():
    for sizes in ([], [0], [3, 3, 3], [9, 1, 1, 7], [1] * 10):
        made = list(merkle.slices_of_lists(sizes, 4))
        assert [i for a, b in made for i in range(a, b)] == list(range(len(sizes)))
        assert all(b == a + 1 or sum(sizes[a:b]) <= 4 for a, b in made)
