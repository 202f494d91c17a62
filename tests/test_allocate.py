"""Scenes over chunks against the loop that ends one chunk after another; running values; where checkpoints go."""

import random
from bisect import bisect_left
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from lumenreel import tables
from lumenreel.operators import cues, scenes
from lumenreel.tables import checkpoint_folder, running


def one_after_another(chunks, scenes):
    """Chunk of each scene, both given by their words."""
    ends, n = list(accumulate(max(w, 1) for w in scenes)), len(scenes)
    total, said, start, out = sum(max(w, 1) for w in chunks), 0, 0, []
    for k, words in enumerate(chunks):
        said += max(words, 1)
        behind = len(chunks) - k - 1
        if behind == 0 or start >= n:
            end = n
        else:
            wish = bisect_left(ends, said / total * ends[-1]) + 1
            end = max(min(n, start + 1), min(wish, n if n - start <= behind else n - behind))
        out += [k] * (end - start)
        start = end
    return out


def test_every_chunk_ends_where_the_loop_ends_it(spark):
    rng, chunks, scenes, want = random.Random(9), [], [], {}
    for d in range(150):
        c = [rng.choice([0, 1, 2, 5, 40, 300]) for _ in range(rng.randint(1, 9))]
        s = [rng.choice([0, 1, 3, 10, 80]) for _ in range(rng.randint(1, 14))]
        chunks += [(d, k, w) for k, w in enumerate(c)]
        scenes += [(d, k, w) for k, w in enumerate(s)]
        want |= {(d, k): x for k, x in enumerate(one_after_another(c, s))}
    got = cues.allocate(spark.createDataFrame(chunks, "d int, chunk int, words int"), spark.createDataFrame(scenes, "d int, scene int, n_words int"), "d")
    assert {(r.d, r.scene): r.chunk for r in got.collect()} == want


def test_running_sums_and_largest_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randint(-5, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, at int, x int").repartition(7)
    got = {(r.key, r.at): (r.n, r.upto, r.top) for r in running(df, ["key"], ["at"], largest={"top": F.col("x")}, upto=F.col("x")).collect()}
    for key in ("a", "b", None):
        mine = [(at, x) for k, at, x in rows if k == key]
        for n, (at, _) in enumerate(mine, 1):
            before = [x for _, x in mine[:n]]
            assert got[key, at] == (n, sum(before), max(before))


def test_checkpoints_never_lie_on_one_machine_of_several():
    assert checkpoint_folder("hdfs://x/c", "file:/w", "yarn") == "hdfs://x/c"
    assert checkpoint_folder(None, "file:/w", "local[4]") == "file:/w/_checkpoints"
    assert checkpoint_folder(None, "s3a://b/w", "yarn") == "s3a://b/w/_checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(None, "file:/w", "spark://m:7077")


@pytest.mark.parametrize("most", [tables.TASK_ROWS, 0])
def test_zipped_by_places(spark, monkeypatch, most):
    """Chunks at the same place of documents with equally many; rows of one position share a place, rows without one have none."""
    written = []
    monkeypatch.setattr(tables, "TASK_ROWS", most)
    monkeypatch.setattr(tables, "shared_checkpoint", lambda df, real=tables.shared_checkpoint: written.append(1) or real(df))
    groups = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q"), ("a", 9, "r"), ("a", None, "s"), ("b", 1, "t"), (None, 1, "u"), ("c", 2, "v")], "d string, at int, g string")
    meta = spark.createDataFrame([("a", 4, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 1, "x"), ("b", 2, "y"), (None, 1, "z")], "d string, at int, m string")
    out = scenes.zipped(groups, meta, "d", "at")
    assert out.columns == ["d", "at", "g", "m"]
    assert sorted(map(tuple, out.select("g", "m").collect()), key=str) == [("p", "x"), ("q", "x"), ("r", "y"), ("r", "z"), ("s", None), ("t", None), ("u", None), ("v", None)]
    assert bool(written) == (most == 0)


def test_lines_keep_their_parts(spark, sf):
    """Lines are dealt by order into the session's number of parts, not put together by their compressed size, and no step by order deals them again."""
    from lumenreel.plans import registry, work
    from lumenreel.plans import scenes as plans

    assert work.lines(registry.Tables(spark, sf), dealt=True).rdd.getNumPartitions() == 4
    plan = plans.rebased_scenes(registry.Tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_orderkey#") == 1
