"""Names in texts: which known entities a text mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import text as T


def mentions(texts: DataFrame, key: str, text: str, aliases: DataFrame, most_words: int = 4) -> DataFrame:
    """(key, entity, at): entities one of whose aliases stands in a text as whole words, whatever the case; `at` is the first place.

    `aliases` has (entity, alias), aliases of up to `most_words` words. Runs of words are joined to
    aliases by equality, so neither side is read for each row of the other. A word may carry 's.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)'s\b", "")
    cut = lambda c: F.filter(F.split(F.regexp_replace(bare(T.straighten(F.coalesce(c, F.lit("")))), r"(?U)[^\w]+", " "), " "), lambda w: w != "")
    a = aliases.select("entity", cut(F.col("alias")).alias("w")).where(F.size("w").between(1, most_words)).select("entity", F.array_join("w", " ").alias("_run")).distinct()
    at_word = lambda w: lambda k: F.struct((k - 1).alias("at"), F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.array_join(F.slice(w, k, n), " ")).alias("runs"))
    places = T.let(cut(F.col(text)), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), at_word(w))))
    t = texts.select(F.col(key), F.explode(places).alias("p"))
    runs = t.select(key, F.col("p.at").alias("at"), F.explode("p.runs").alias("_run"))
    return runs.join(a, "_run").groupBy(key, "entity").agg(F.min("at").alias("at"))


def ordered_mentions(found: DataFrame, key: str) -> DataFrame:
    """(key, entities): the entities of each text in the order in which they come up."""
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "entity"))).alias("m"))
    return rows.select(key, F.transform("m", lambda x: x["entity"]).alias("entities"))


def reference(c: Column, known: DataFrame | None = None) -> Column:
    """Forms of a reference to try, in order: as it is, with spaces for underscores, and each up to its first punctuation mark."""
    raw = F.lower(T.collapse(F.coalesce(c, F.lit(""))))
    spaced = F.replace(raw, F.lit("_"), F.lit(" "))
    head = lambda x: F.trim(F.element_at(F.split(x, r"[:(,;/|-]", 2), 1))
    return F.filter(F.array_distinct(F.array(raw, spaced, head(raw), head(spaced))), lambda x: x != "")


def resolve(refs: DataFrame, key: str, ref: str, names: DataFrame) -> DataFrame:
    """(key, ref, entity) by the first form of the reference that is a name in `names` (name, entity)."""
    forms = refs.select(key, ref, F.posexplode(reference(F.col(ref))).alias("_k", "name"))
    return forms.join(names, "name").groupBy(key, ref).agg(F.min_by("entity", "_k").alias("entity"))


def label(c: Column) -> Column:
    """A display name without what stands in brackets."""
    return F.trim(F.regexp_replace(T.collapse(c), r"\s*\(.*?\)", ""))
