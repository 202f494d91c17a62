"""The fixed query set of a job store: lookups, listings, new states, joins, queues.

Tables do not change in place: what updates, upserts and deletes return is the new state. The clock
is always given. Nulls in keys match nothing, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.tables import first_of_key


def lookup(df: DataFrame, **keys) -> DataFrame:
    """The row of a key, or none."""
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.limit(1)


def listing(df: DataFrame, order: list[Column | str], where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows by a filter, in a fixed order, at most so many if a limit is given."""
    out = (df if where is None else df.where(where)).orderBy(*order)
    return out if limit is None else out.limit(limit)


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and those new ones whose key isn't there yet; columns that one side lacks are null."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def conflicts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is taken: an insert of them would be an error."""
    return new.join(old.select(*key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str], newest: list[Column] | None = None) -> DataFrame:
    """New rows take the place of old ones of their key. With `newest`, the first row in that order counts of several new ones."""
    rows = first_of_key(new, key, newest) if newest else new
    return rows.unionByName(old.join(rows.select(*key), key, "left_anti"), allowMissingColumns=True)


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns get new values in the rows where the condition is true; in all others, also where it is null, they stay."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def add_missing(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that are missing are added, and nulls in them get their default."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """The rows for which the condition isn't true."""
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_in(df: DataFrame, column: str, values: list, where: Column | None = None) -> DataFrame:
    """Without the rows of a list of values (and of a condition); an empty list deletes nothing."""
    if not values:
        return df
    hit = F.col(column).isin(*values)
    return delete(df, hit if where is None else hit & where)


def cascade(parents: DataFrame, children: DataFrame, key: str, parent_key: str) -> DataFrame:
    """The children whose parent isn't among the deleted `parents`; children without a parent stay."""
    return children.join(parents.select(F.col(key).alias(parent_key)), parent_key, "left_anti")


def overlay(defaults: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): what is stored, else the default, of all keys of either side."""
    d, s = defaults.select(F.col(key), F.col(value).alias("_default")), stored.select(F.col(key), F.col(value).alias("_stored"))
    return d.join(s, key, "full").select(key, F.coalesce("_stored", "_default").alias(value))


def latest_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in the order; combined in each task before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in df.columns])


def tail(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    return first_of_key(df, key, [F.desc(c) for c in order], n)


def head(df: DataFrame, order: list[Column | str], n: int = 1) -> DataFrame:
    """The first rows of a queue."""
    return df.orderBy(*order).limit(n)


def expire_old(df: DataFrame, kind: str, order: list[str], keep: int, flag: str = "expired") -> DataFrame:
    """`df` with a flag for what lies behind the newest `keep` rows of its kind; no kind is sorted as a whole."""
    last = first_of_key(df.select(kind, *order), [kind], [F.desc(c) for c in order], keep)
    limit = last.groupBy(kind).agg(F.min(F.struct(*order)).alias("_oldest"))
    joined = df.alias("d").join(limit.alias("l"), F.col(f"d.{kind}").eqNullSafe(F.col(f"l.{kind}")), "left")
    return joined.select("d.*", (F.struct(*[F.col(f"d.{c}") for c in order]) < F.col("l._oldest")).alias(flag))


def requeue_stale(df: DataFrame, status: str, updated: str, worker: str, now: Column, seconds: int) -> DataFrame:
    """Rows in work that nobody has touched for so long are queued again, without a worker."""
    stale = (F.col(status) == "processing") & (F.col(updated) < now - F.make_dt_interval(secs=F.lit(seconds)))
    return update(df, stale, **{status: F.lit("queued"), worker: F.lit(None)})


def orphans(jobs: DataFrame, beats: DataFrame, worker: str, beat_at: str, beat_status: str, now: Column, seconds: int) -> DataFrame:
    """Jobs without a live worker: it is null, has stopped, or hasn't been heard of for so long."""
    live = beats.where((F.coalesce(F.col(beat_status), F.lit("")) != "stopped") & (F.col(beat_at) >= now - F.make_dt_interval(secs=F.lit(seconds))))
    return jobs.join(live.select(worker), worker, "left_anti")


def claim(jobs: DataFrame, workers: int, order: list[Column | str], queued: Column, key: str) -> DataFrame:
    """(key, slot): which queued jobs go to the slots 1 to `workers`; one writer decides, so none is taken twice."""
    first = jobs.where(queued).orderBy(*order).limit(workers)
    # as many rows as there are slots
    return first.agg(F.collect_list(F.col(key)).alias("_keys")).select(F.posexplode("_keys").alias("slot", key)).select(key, (F.col("slot") + 1).alias("slot"))


def changed(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The new rows that differ from the old ones of their key in any of the columns; rows of new keys too."""
    o = old.select(*key, F.struct(*columns).alias("_old"))
    return new.join(o, key, "left").where(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")


def issues(df: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """(key, code): a row for each check that holds."""
    found = F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(found).alias("code"))


def strict_join(left: DataFrame, right: DataFrame, key: str, message: str) -> DataFrame:
    """Inner join that fails at run time if a left row has no partner."""
    marked = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    return marked.where(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit(message + ": "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("_there")
