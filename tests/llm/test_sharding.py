import math
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from tests.llm import cases

from rulelens.llm import sharding


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (1, 9, 10), (0, 4, 2), (30, 3, 20)])
def test_draws_follow_the_hypergeometric_law(good, bad, draws):
    rng = np.random.default_rng(3)
    n = 4000
    got = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for x in range(draws + 1):
        p = math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws)
        assert abs(got[x] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1e-9


def test_draws_of_any_size():
    rng = np.random.default_rng(4)
    x = [sharding.hypergeometric(rng, 2 * 10**11, 46 * 10**11, 10**6) for _ in range(300)]
    mean, sd = 10**6 / 24, math.sqrt(10**6 / 24 * 23 / 24)
    assert abs(np.mean(x) - mean) < 5 * sd / math.sqrt(300) and 0.8 * sd < np.std(x) < 1.2 * sd


def test_matrix_is_that_of_a_uniform_permutation():
    """Against all permutations of five rows in partitions of 3 and 2 and shards of 2, 2 and 1."""
    counts, sizes = [3, 2], [2, 2, 1]
    shard = np.repeat(np.arange(3), sizes)
    want = Counter()
    for p in permutations(range(5)):
        m = np.zeros((2, 3), int)
        for place, row in enumerate(p):
            m[0 if row < 3 else 1, shard[place]] += 1
        want[m.tobytes()] += 1 / math.factorial(5)
    n = 3000
    got = Counter(sharding.communication_matrix(counts, sizes, f"s{k}").astype(int).tobytes() for k in range(n))
    assert set(got) <= set(want)
    for m, p in want.items():
        assert abs(got[m] - n * p) <= 5 * math.sqrt(n * p * (1 - p))
    with pytest.raises(ValueError):
        sharding.communication_matrix([3], [2])


def test_sums_of_a_matrix():
    counts, sizes = [1000, 0, 77, 1, 12345], sharding.shard_sizes(13423, 24)
    m = sharding.communication_matrix(counts, sizes)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()


def test_shards_are_exact_gapless_and_mixed(spark):
    n = 5000
    rows = sharding.shuffled(spark.range(0, n, 1, 7), 24).collect()
    assert sorted(r.id for r in rows) == list(range(n))
    for s, size in enumerate(sharding.shard_sizes(n, 24)):
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(size))
    # neither the place in the table nor the neighbour says anything about the shard or the slot
    place = np.array([(r.id, r["shard"], r.slot) for r in rows], dtype=float)
    assert np.abs(np.corrcoef(place.T)[0, 1:]).max() < 0.06
    by_id = place[np.argsort(place[:, 0])]
    assert abs(np.corrcoef(by_id[:-1, 1], by_id[1:, 1])[0, 1]) < 0.06
    again = sharding.shuffled(spark.range(0, n, 1, 7), 24).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    other = sharding.shuffled(spark.range(0, n, 1, 7), 24, "another").collect()
    assert sorted(map(tuple, rows)) != sorted(map(tuple, other))


@pytest.mark.parametrize("n", [1, 5, 23])
def test_fewer_rows_than_shards(spark, n):
    rows = sharding.shuffled(spark.range(n), 24).collect()
    assert sorted(r["shard"] for r in rows) == list(range(n)) and {r.slot for r in rows} == {0}


def test_awkward_and_empty_tables(spark, tmp_path):
    docs = cases.awkward(spark).withColumnsRenamed({"k": "shard", "size": "part"})
    rows = sharding.shuffled(docs, 4)
    assert rows.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    kept = [c for c in docs.columns if c != "shard"]
    assert sorted(map(str, rows.select(kept).collect())) == sorted(map(str, docs.select(kept).collect()))
    assert sharding.shuffled(cases.empty(spark)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 4 and back.count() == docs.count()
