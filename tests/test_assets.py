"""Files for scenes against scenes that choose one after another."""

import random

import pytest
from pyspark.sql import functions as F

from lumenreel import tables
from lumenreel.functions import text as T
from lumenreel.operators import assets

SCENES, FILES = "ep string, scene bigint, scene_number bigint, asset_type string", "ep string, name string"


def one_after_another(scenes, files):
    """(scene, name) as scenes (place, own number, type) choose in turn from files (sort number, name, number, kind)."""
    files, taken = sorted(files), {}
    for place, own, wanted in scenes:
        wishes = [f for n in dict.fromkeys([place, own]) if n is not None for f in files if f[2] == n and f not in taken.values()]
        if wishes:
            taken[place] = next((f for f in wishes if f[3] == wanted or not wanted), wishes[0])
    left = [f for f in files if f not in taken.values()]
    for place, *_ in scenes:
        if place not in taken and left:
            taken[place] = left.pop(0)
    return {place: f[1] for place, f in taken.items()}


def test_scenes_choose_in_turn(spark):
    rng = random.Random(3)
    scenes, files, want = [], [], {}
    for e in range(60):
        n = rng.randint(0, 9)
        mine = [(k, rng.choice([None, k, rng.randint(1, 4), rng.randint(1, 12)]), rng.choice(["image", "video", "video", None])) for k in range(1, n + 1)]
        names = {f"{rng.choice(['', 'scene_', 'prompt ', 'x'])}{rng.randint(1, 6)}{rng.choice(['a', 'b', '_c'])}.{rng.choice(['png', 'mp4', 'jpg', 'txt'])}" for _ in range(rng.randint(0, 12))}
        scenes += [(f"e{e}", *s) for s in mine]
        files += [(f"e{e}", x) for x in sorted(names)]
        want[f"e{e}"] = mine
    scanned = assets.scan_files(spark.createDataFrame(files, FILES), "name")
    known = {}
    for r in scanned.collect():
        known.setdefault(r.ep, []).append((r.sort_number, r.name, r.number, r.kind))
    got = {e: {} for e in want}
    for r in assets.assign(spark.createDataFrame(scenes, SCENES), scanned, "ep").collect():
        assert r.scene not in got[r.ep]
        got[r.ep][r.scene] = r.name
    assert got == {e: one_after_another(s, known.get(e, [])) for e, s in want.items()}


def test_all_want_one_number(spark):
    scenes = [("e", k, 1, "image") for k in range(1, 8)]
    files = [("e", f"1{c}.png") for c in "abcde"] + [("e", "1z.mp4"), ("e", "1z.mp4"), ("e", "spare.png")]
    got = assets.assign(spark.createDataFrame(scenes, SCENES), assets.scan_files(spark.createDataFrame(files, FILES), "name"), "ep").collect()
    assert sorted((r.scene, r.name) for r in got) == [(1, "1a.png"), (2, "1b.png"), (3, "1c.png"), (4, "1d.png"), (5, "1e.png"), (6, "1z.mp4"), (7, "spare.png")]


def test_nothing_to_assign(spark):
    none, some = spark.createDataFrame([], SCENES), spark.createDataFrame([("e", 1, None, "image")], SCENES)
    files = assets.scan_files(spark.createDataFrame([], FILES), "name")
    assert assets.assign(none, files, "ep").collect() == assets.assign(some, files, "ep").collect() == []


@pytest.mark.parametrize("most", [tables.TASK_ROWS, 0])
def test_groups_of_any_size(spark, monkeypatch, most):
    """Few scenes with many files, many with few, names twice, groups without a name: the same with groups that fit a task and with those that may not."""
    monkeypatch.setattr(tables, "TASK_ROWS", most)
    rng = random.Random(11)
    scenes, files, want = [], [], {}
    for e in range(40):
        own = rng.choice([[None], [None, 1, 2, 3], [2]])
        mine = [(k, rng.choice(own), rng.choice(["image", "video", "", None])) for k in range(1, rng.choice([1, 2, 4, 12]) + 1)]
        names = [f"{rng.choice(['', 'x', 'asset '])}{rng.randint(1, 5)}_{rng.randint(0, 9)}.{rng.choice(['png', 'mp4', 'wav'])}" for _ in range(rng.choice([0, 3, 40]))]
        scenes += [(f"e{e}", *s) for s in mine]
        files += [(f"e{e}", x) for x in names]
        want[f"e{e}"] = mine
    scanned = assets.scan_files(spark.createDataFrame([*files, (None, "1.png")], FILES), "name")
    known = {}
    for r in scanned.distinct().collect():
        known.setdefault(r.ep, []).append((r.sort_number, r.name, r.number, r.kind))
    out = assets.assign(spark.createDataFrame([*scenes, (None, 1, None, "image")], SCENES), scanned, "ep").collect()
    got = {e: {} for e in want}
    for r in out:
        got[r.ep][r.scene] = r.name
    assert len(out) == sum(map(len, got.values()))
    assert got == {e: one_after_another(s, known.get(e, [])) for e, s in want.items()}


def test_files_out_of_reach_are_written_once(spark, monkeypatch):
    """Of 300 files only those that 4 scenes can get go through both passes."""
    written = []
    for module in (assets, tables):
        monkeypatch.setattr(module, "shared_checkpoint", lambda df, real=tables.shared_checkpoint: written.append(real(df)) or written[-1])
    files = assets.scan_files(spark.createDataFrame([("e", f"{k % 4}_{k}.png") for k in range(300)], FILES), "name")
    got = assets.assign(spark.createDataFrame([("e", k, None, "image") for k in (1, 2, 3, 4)], SCENES), files, "ep").collect()
    assert sorted((r.scene, r.name) for r in got) == [(1, "1_1.png"), (2, "2_10.png"), (3, "3_103.png"), (4, "0_0.png")]
    assert [n for n in (df.count() for df in set(written)) if n > 12] == [300]


def test_names_are_read_as_the_patterns_say(spark):
    names = [None, "", ".", "a", "png", "a.", "a.png", "A.PnG", "a.b/c", "a.b/", "/.mp4", "a..webm", "a.png\n", "a.\n", "a\n.png", "x.m\u212av", "\u0130.JPG", "a.b.c.txt", "prompt 7.png", "PROMPT\n 5", "7prompt", "3 (4)", "(4", "scene_", "12 Scene__9 prompt"]
    names += ["\u017fcene 3", "\u0663x", "7", "07_1.mp4", "12345678901234567890a", "(12345678901234567890) 5", "asset 1(2)", " 8", "9223372036854775807.mov", "\u00e94.png", "5\u00e9.\u00c9", "1.2.3"]
    c = F.col("name")
    suffix = F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))
    kind = F.when(suffix == "", F.lit(""))
    for k, suffixes in T.SUFFIX_CLASSES.items():
        kind = kind.when(suffix.isin(*suffixes), F.lit(k))
    number = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("bigint") for p in T.NUMBER_PLACES])
    want = [suffix, F.regexp_replace(c, r"\.[^./]+$", ""), kind.otherwise("binary"), number]
    rows = spark.createDataFrame([(x,) for x in names], "name string").select("name", F.array(*[x.cast("string") for x in want]).alias("want"), F.array(*[x.cast("string") for x in (T.suffix(c), T.stem(c), T.suffix_class(c), T.number_in_name(c))]).alias("got"))
    for r in rows.collect():
        assert r.got == r.want, r.name
