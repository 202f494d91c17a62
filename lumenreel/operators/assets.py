"""Files for scenes: which file a scene gets, by number, type and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.tables import running, shared_checkpoint, small_keys


#: Classes of files that a scene can show.
KINDS = ("image", "video")


def scan_files(files: DataFrame, name: str) -> DataFrame:
    """Images and videos among `files`, with number, kind and sort key (number, 9999 without one, then name)."""
    kind = T.suffix_class(F.col(name))
    rows = files.withColumns({"kind": kind, "_stem": T.stem(F.col(name))}).withColumn("number", T.number_in_name(F.col("_stem"))).drop("_stem").where(F.col("kind").isin(*KINDS))
    return rows.withColumn("sort_number", F.coalesce("number", F.lit(9999)))


def by_number(files: DataFrame, group: str, name: str) -> DataFrame:
    """(group, number, names): the files of each number, in order of name."""
    return files.where("number is not null").groupBy(group, "number").agg(F.array_sort(F.collect_list(name)).alias("names"))


def type_sequence(scenes: DataFrame, group: str, order: str) -> DataFrame:
    """`scenes` with type_number: their number among those of their type."""
    return scenes.withColumn("type_number", F.row_number().over(Window.partitionBy(group, "asset_type").orderBy(order)))


def wishes(scenes: DataFrame, group: str) -> DataFrame:
    """(group, scene, asset_type, wish, number): the numbers that each scene asks for, its place before its own number."""
    place, own = F.col("scene").cast("bigint"), F.col("scene_number").cast("bigint")
    numbers = F.when(own != place, F.array(place, own)).otherwise(F.array(F.coalesce(place, own)))
    return scenes.select(group, "scene", "asset_type", F.posexplode(numbers).alias("wish", "number"))


def by_wish(scenes: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """(group, scene, name, kind): each scene's first free file with its place or else its own number, of its type if there is one; earlier scenes choose first.

    All scenes ask at once for the best file that no earlier scene is known to have, and a file keeps the earliest that asks.
    Whoever was refused asks on in the next round, until all have different files; what an earlier scene has asked for only ever goes to
    one still earlier, so nobody is refused a file that would have been free in turn. There are as many rounds as
    scenes that want one number, at most; where no scene wants another number than its place, the first is the last.
    """
    alone = scenes.where(F.col("scene_number").cast("bigint") != F.col("scene").cast("bigint")).isEmpty()
    found = wishes(scenes, group).join(files.select(group, F.col("number").cast("bigint").alias("number"), "name", "kind"), [group, "number"])
    other = F.coalesce(F.nullif("asset_type", F.lit("")) != F.col("kind"), F.lit(False))
    asked = found.select(group, "scene", F.struct(other.alias("other"), "wish", "name", "kind").alias("file"))
    while True:
        best = shared_checkpoint(asked.groupBy(group, "scene").agg(F.min("file").alias("file")))
        holders = best.groupBy(group, F.col("file.name").alias("_name")).agg(F.min("scene").alias("_holder"), F.count("*").alias("_asking"))
        if alone or holders.where("_asking > 1").isEmpty():
            return best.select(group, "scene", "file.name", "file.kind")
        refusing = holders.select(group, "_name", "_holder")
        asked = shared_checkpoint(asked.withColumn("_name", F.col("file.name")).join(refusing, [group, "_name"], "left").where("_holder is null or scene <= _holder").select(group, "scene", "file"))


def in_reach(scenes: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """The files that scenes can get, each name once in a group: `choice` tells those that a wish can reach, `spare` those that can be left for a scene.

    Of a number and kind no more names are taken than scenes ask for one number, and they are taken in order; no two scenes have one place. A file
    that is left for a scene has fewer files before it than there are scenes: others that are left, and those that scenes chose.
    """
    place = Window.partitionBy(group).orderBy("sort_number", "name")
    ahead = Window.partitionBy(group, "sort_number").orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    once = files.withColumns({"_place": F.dense_rank().over(place), "_new": F.coalesce(F.lag("name").over(place) != F.col("name"), F.lit(True))})
    alike = [F.when(F.col("kind") == k, F.count(F.when((F.col("kind") == k) & F.col("number").isNotNull() & F.col("_new"), 1)).over(ahead)) for k in KINDS]
    own = F.when(F.col("scene_number").cast("bigint") != F.col("scene").cast("bigint"), 1)
    room = scenes.groupBy(group).agg(F.count("*").alias("_scenes"), (F.count(own) + 1).alias("_asking"))
    rows = once.withColumn("_alike", F.coalesce(*alike, F.lit(0))).where("_new").join(room, group)
    choice = F.col("number").isNotNull() & (F.col("_alike") <= F.col("_asking"))
    return rows.select(*files.columns, choice.alias("choice"), (F.col("_place") <= F.col("_scenes")).alias("spare")).where("choice or spare")


def in_order(scenes: DataFrame, files: DataFrame, group: str, small: bool = False) -> DataFrame:
    """(group, scene, name, kind): the first scene gets the first file, and so on; what is over on either side gets nothing. Where groups are `small`, a task sorts them whole."""

    def numbered(df: DataFrame, *order: str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))) if small else running(df, [group], list(order), number="_n")

    left = numbered(scenes.select(group, "scene"), "scene")
    right = numbered(files.select(group, "sort_number", "name", "kind"), "sort_number", "name")
    return left.join(right.select(group, "_n", "name", "kind"), [group, "_n"]).select(group, "scene", "name", "kind")


def assign(scenes: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """(group, scene, name, kind) of scenes (scene: place from 1, scene_number, asset_type) and scanned files (name, number, kind).

    In order of scenes, each takes the first free file with its place or else its own number, of its
    type if there is one. Scenes that got none then take the files left, in order; those beyond them
    get none. No group is gathered: the first pass joins by number, the second by two running numbers. Of a name that comes twice
    in a group one counts; number and kind follow from the name. Where no group can have more than TASK_ROWS
    files or scenes, files that no scene can get are left out before the first pass; else all go through both.
    """
    scenes = shared_checkpoint(scenes.select(group, "scene", "scene_number", "asset_type"))
    files = shared_checkpoint(files.select(group, "name", "sort_number", "number", "kind"))
    small = small_keys(files, [group]) and small_keys(scenes, [group])
    if small:
        kept = shared_checkpoint(in_reach(scenes, files, group))
        chosen_from, spare = kept.where("choice"), kept.where("spare")
    else:
        chosen_from = spare = shared_checkpoint(files.distinct())
    first = by_wish(scenes, chosen_from, group).withColumn("scene", F.col("scene").cast("bigint"))
    free_scenes = scenes.select(group, F.col("scene").cast("bigint").alias("scene")).join(first, [group, "scene"], "left_anti")
    return first.unionByName(in_order(free_scenes, spare.join(first, [group, "name"], "left_anti"), group, small))


def match_uploads(scenes: DataFrame, uploads: DataFrame, group: str, order: str) -> DataFrame:
    """(group, scene, name): each scene gets the first upload with its number and type; the others match nothing."""
    wanted = uploads.join(scenes.select(group, "scene", F.col("scene_number").alias("number"), F.col("asset_type").alias("kind")), [group, "number", "kind"])
    first = wanted.groupBy(group, "scene").agg(F.min(F.struct(order, "name")).alias("u"))
    return first.select(group, "scene", "u.name")


def probe_usable(kind: Column, wanted: Column, width: Column, height: Column, seconds: Column) -> Column:
    """Whether a remembered probe can be used: the sizes are there, and for videos the length; another type is an error."""
    wrong = F.raise_error(F.concat(F.lit("asset is no "), wanted)).cast("boolean")
    return F.when(kind != wanted, wrong).otherwise((width > 0) & (height > 0) & ((kind != "video") | (seconds > 0)))


def listing_order(name: str, size: str, suffix_rank: dict[str, int]) -> list[Column]:
    """Sort keys of a file listing: empty files last, those at the root first, by suffix, by path."""
    table = F.create_map(*[F.lit(x) for kv in suffix_rank.items() for x in kv])
    c = F.col(name)
    return [(F.col(size) == 0).cast("int"), F.contains(c, F.lit("/")).cast("int"), F.coalesce(F.try_element_at(table, T.suffix(c)), F.lit(99)), F.lower(c)]
