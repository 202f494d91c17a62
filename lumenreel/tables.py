"""Small helpers that all parts of the library share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(named: str | None, warehouse: str, master: str) -> str:
    """The folder that the session names for checkpoints, else one below the warehouse; an error where that lies on one machine of several."""
    if named:
        return named
    if warehouse.startswith("file:") and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{warehouse}/_checkpoints"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that the cluster names for checkpoints and read from there; see checkpoint_folder."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(conf.get("spark.checkpoint.dir", None), conf.get("spark.sql.warehouse.dir"), sc.master))
    return df.checkpoint(eager=True)


#: Rows of a key that one task may sort; parts into which keys are counted to see that none has more.
TASK_ROWS, KEY_PARTS = 1_000_000, 1 << 12


def small_keys(df: DataFrame, keys: list[str], most: int | None = None) -> bool:
    """Whether no key has more than `most` rows (TASK_ROWS), for sure: rows are counted by hash parts of the keys, a few numbers from each task."""
    parts = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(KEY_PARTS)).alias("part")).count()
    return (parts.agg(F.max("count")).first()[0] or 0) <= (TASK_ROWS if most is None else most)


def running(df: DataFrame, keys: list[str], order: list[str], number: str | None = "n", largest: dict[str, Column] | None = None, **sums: Column) -> DataFrame:
    """`df` with the row number by key in the order, and sums, or the `largest` values, of all rows up to each one.

    A key may hold any share of the rows: rows are dealt by ranges of key and order, numbered within
    each range, and moved on by what earlier ranges of the key hold. `order` has to tell rows apart.
    """
    cols, largest = list(df.columns), largest or {}
    sums = ({number: F.lit(1).cast("bigint")} if number else {}) | sums
    agg = dict.fromkeys(sums, F.sum) | dict.fromkeys(largest, F.max)
    with_values = df.select("*", *[v.alias(f"_v_{k}") for k, v in (sums | largest).items()])
    ranged = shared_checkpoint(with_values.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = ranged.select("*", *[f(f"_v_{k}").over(inside).alias(f"_in_{k}") for k, f in agg.items()])
    totals = ranged.groupBy("_range", *keys).agg(*[f(f"_v_{k}").alias(f"_t_{k}") for k, f in agg.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *keys, *[f(f"_t_{k}").over(before).alias(f"_b_{k}") for k, f in agg.items()])
    p, o = part.alias("p"), offsets.alias("o")
    same = F.col("p._range").eqNullSafe(F.col("o._range"))
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}"))
    moved = [(F.col(f"_in_{k}") + F.coalesce(F.col(f"_b_{k}"), F.lit(0))).alias(k) for k in sums] + [F.greatest(f"_in_{k}", f"_b_{k}").alias(k) for k in largest]
    return p.join(o, same).select(*[F.col(f"p.{c}") for c in cols], *moved)


def places(df: DataFrame, key: str, position: str, place: str, n: str) -> DataFrame:
    """`df` with the place of each row's position among the different positions of its key, from 1, and how many of those there are; null where the position is.

    Where no key can hold more than TASK_ROWS, a key's rows are sorted in one task; else places are numbered by `running`, whatever share of the rows a key holds.
    """
    if small_keys(df, [key]):
        w = Window.partitionBy(key)
        ranked = df.withColumn(place, F.when(F.col(position).isNotNull(), F.dense_rank().over(w.orderBy(F.asc_nulls_last(position))).cast("bigint")))
        return ranked.withColumn(n, F.when(F.col(position).isNotNull(), F.max(place).over(w)))
    different = running(df.where(F.col(position).isNotNull()).select(key, position).distinct(), [key], [position], number=place)
    totals = different.groupBy(key).agg(F.max(place).alias(n))
    return df.join(different.join(totals, key), [key, position], "left").select(*df.columns, place, n)


def first_of_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key, with their rank if it is named. Spark cuts to n rows a key in each task before it deals rows by key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= n)
    return ranked if rank else ranked.drop("_rank")


def scan(df: DataFrame, keys: list[str], order: list[str], start, step, schema: str) -> DataFrame:
    """Rows that a state machine makes of the rows of each key in their order.

    `start()` gives the state of a key; `step(state, row)` gets a dict and returns a list of tuples of
    `schema`; `step(state, None)` ends the key. A recurrence over its own output is sequential by
    nature: a key stays in one task, but that task holds one batch and one state, whatever the key's size.
    """
    names = df.columns
    out_names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pandas as pd

        current, state = None, None
        for pdf in batches:
            out = []
            for values in zip(*(pdf[c].tolist() for c in names), strict=True):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != current:
                    if state is not None:
                        out += step(state, None)
                    current, state = key, start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=out_names)
        if state is not None:
            yield pd.DataFrame(step(state, None), columns=out_names)

    # a number of its own: partitions that look small by their bytes are not put together, as steps cost more than rows
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a hash of the keys: rows that a join has dealt by the keys themselves would not be dealt again, and the join may yet change to one that doesn't deal them
    return df.repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
