"""Buckets that hold many items give the same groups, however they are cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillvec.llm import components, fuzzy_fingerprints, near_dedup


def small_blocks(monkeypatch, *sizes):
    for name, size in zip(("SAMPLE", "HOT_SEEN", "BLOCK", "PAIR_BLOCK"), sizes):
        monkeypatch.setattr(components, name, size)


def test_same_groups_when_every_bucket_is_hot(small, monkeypatch):
    def found():
        return sorted(map(tuple, near_dedup.duplicates(small).collect())), sorted((r["doc_id"], r["family_size"], str(r["family"])) for r in fuzzy_fingerprints.families(small).collect())

    whole = found()
    small_blocks(monkeypatch, 1, 2, 3, 3)
    assert found() == whole


def groups(spark, signatures, parts, tmp_path):
    rows = pd.DataFrame({"id": [i.to_bytes(4, "big") for i in range(len(signatures))], "payload": [x.tobytes() for x in signatures]})
    rows.to_parquet(tmp_path / "items.parquet")
    items = spark.read.parquet(str(tmp_path / "items.parquet")).repartition(4)
    one = lambda some: some.select(F.lit(7).cast("long").alias("bucket"), "id")
    found = components.components(components.bucket_edges(items, one, near_dedup._alike_of, parts)).collect()
    return {int.from_bytes(r["id"], "big"): r["root"] for r in found}


@pytest.mark.parametrize("parts", [near_dedup.parts_of, None])
def test_one_bucket_of_groups_and_loners(spark, monkeypatch, tmp_path, parts):
    """Two large groups, chains of items of which only neighbours are alike, and unlike items, against all pairs."""
    small_blocks(monkeypatch, 4, 4, 32, 48)
    rng = np.random.default_rng(4)
    draw = lambda *shape: rng.integers(0, 65536, shape).astype(np.uint16)
    near = np.repeat(draw(2, 128), 150, 0)
    noise = rng.random(near.shape) < 0.12
    near[noise] = draw(int(noise.sum()))
    chain = [draw(128)]
    for _ in range(40):
        step = chain[-1].copy()
        step[rng.permutation(128)[:45]] = draw(45)
        chain.append(step)
    all_ = np.concatenate([near, np.array(chain), draw(100, 128)])
    all_ = all_[rng.permutation(len(all_))]
    root = np.arange(len(all_))
    for i in range(len(all_)):
        for j in range(i):
            if (all_[i] == all_[j]).sum() >= 0.6 * 128:
                root[root == root[i]] = root[j]
    found = groups(spark, all_, parts, tmp_path)
    ours = [found.get(i, i) for i in range(len(all_))]
    assert len(set(root)) == 103
    assert len({(a, b) for a, b in zip(ours, root)}) == len(set(ours)) == len(set(root))


def test_many_unlike_items_in_one_bucket(spark, tmp_path):
    rng = np.random.default_rng(5)
    assert groups(spark, rng.integers(0, 65536, (20_000, 128)).astype(np.uint16), near_dedup.parts_of, tmp_path) == {}


def test_hot_steps_get_the_items_of_hot_buckets_only(spark, monkeypatch, tmp_path):
    """40 alike items and 20 unlike ones in one bucket, 300 alone in theirs: 60 items are worked on, and no keys are made for them."""
    small_blocks(monkeypatch, 4, 4, 32, 48)
    rng = np.random.default_rng(6)
    near = np.repeat(rng.integers(0, 65536, (1, 128)).astype(np.uint16), 40, 0)
    near[rng.random(near.shape) < 0.12] = 7
    all_ = np.concatenate([near, rng.integers(0, 65536, (320, 128)).astype(np.uint16)])
    pd.DataFrame({"id": [i.to_bytes(4, "big") for i in range(360)], "bucket": [0] * 60 + list(range(1, 301)), "payload": [x.tobytes() for x in all_]}).to_parquet(tmp_path / "items.parquet")
    got, keyed, real = [], [], components.hot_edges

    def hot_edges(members, items, *rest):
        got.append((members.count(), items.count()))
        return real(members, items, *rest)

    monkeypatch.setattr(components, "hot_edges", hot_edges)
    parts = lambda payload: keyed.append(1) or near_dedup.parts_of(payload)
    edges = components.bucket_edges(spark.read.parquet(str(tmp_path / "items.parquet")), lambda some: some.select("bucket", "id"), near_dedup._alike_of, parts)
    found = {int.from_bytes(r["id"], "big"): int.from_bytes(r["root"], "big") for r in components.components(edges).collect()}
    assert got == [(60, 60)] and not keyed
    assert found == dict.fromkeys(range(40), 0)


def test_groups_are_the_same_with_keys_and_without(small, monkeypatch):
    small_blocks(monkeypatch, 1, 2, 3, 3)
    found = []
    for most in (0, 1_000_000):
        monkeypatch.setattr(components, "PAIR_COPIES", most)
        found.append(sorted(map(tuple, near_dedup.duplicates(small).collect())))
    assert found[0] and found[0] == found[1]


def test_alike_items_share_a_part():
    """The signature is cut into one part more than alike items can have differences."""
    parts = near_dedup.parts_of(F.lit(b"x"))._jc.toString()
    assert parts.count("xxhash64") == 52 and 128 - int(np.ceil(0.6 * 128)) == 51


def test_components_of_a_hub_and_a_path(spark):
    name = lambda i: i.to_bytes(3, "big")
    edges = [(name(0), name(i)) for i in range(1, 3000)] + [(name(i), name(i + 1)) for i in range(5000, 5200)]
    found = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert len(found) == 3201 and {bytes(r) for r in found.values()} == {name(0), name(5000)}
