"""Settings, voices and model catalogues: defaults, limits, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import text as T

# Limits of voice settings, and those of the default preset.
VOICE_LIMITS = {"temperature": (0.35, 0.85), "top_p": (0.60, 0.95), "top_k": (10, 80), "speed": (0.96, 1.05), "chunk_max_chars": (120, 250), "silence_gap_seconds": (0.00, 0.25)}
VOICE_DEFAULTS = {"temperature": 0.55, "top_p": 0.75, "top_k": 30, "speed": 1.0, "chunk_max_chars": 180, "silence_gap_seconds": 0.12}


def voice_settings(config: Column, defaults: dict[str, float] = VOICE_DEFAULTS) -> Column:
    """Struct of numbers from a JSON text: each within its limits, the default where it is missing or no number."""
    read = lambda k: F.get_json_object(F.coalesce(config, F.lit("{}")), f"$.{k}").try_cast("double")
    return F.struct(*[F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.coalesce(read(k), F.lit(float(defaults[k]))))).alias(k) for k, (lo, hi) in VOICE_LIMITS.items()])


def resolve(projects: DataFrame, settings: dict[str, Column], defaults: dict[str, Column]) -> DataFrame:
    """Each setting of a project: its own value, else the stored one, else the default; '' counts as missing."""
    own = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return projects.withColumns({c: F.coalesce(own(c), settings.get(c, F.lit(None)), d) for c, d in defaults.items()})


def model_scores(models: DataFrame, model: str, hints: DataFrame) -> DataFrame:
    """`models` with priority, price and speed from `hints` (prefix, priority, price, speed): that of the longest prefix counts; 999, 3 and 3 without one."""
    m = models.withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(model), F.lit(1))), lambda n: F.substring(F.col(model), F.lit(1), n))))
    found = m.join(hints, F.col("_prefix") == F.col("prefix")).groupBy(model).agg(F.max_by(F.struct("priority", "price", "speed"), F.length("prefix")).alias("_h"))
    out = models.join(found, model, "left")
    return out.select(*models.columns, F.coalesce("_h.priority", F.lit(999)).alias("priority"), F.coalesce("_h.price", F.lit(3)).alias("price"), F.coalesce("_h.speed", F.lit(3)).alias("speed"))


def rank_order(label: str) -> list[Column]:
    """Order of models: by priority, cheap before dear, fast before slow, then by name."""
    return [F.col("priority"), F.col("price"), -F.col("speed"), F.lower(label)]


def recommended(models: DataFrame, model: str, preferred: list[str]) -> DataFrame:
    """One row: the available model that comes first in a list of preferences, else the first by name."""
    place = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(model))
    return models.orderBy(F.when(place == 0, F.lit(1 << 30)).otherwise(place), model).limit(1).select(model)


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows in one of whose columns the query stands, whatever the case; an empty query finds all."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))


def base_url(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "/+$", ""), F.lit("")), F.lit(default))


def profile_errors(name: Column, key: Column, model: Column, url: Column, runnable: Column) -> Column:
    """Array of what a profile lacks."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    checks = [(blank(name), "name is required"), (blank(key), "key is required"), (blank(model), "model is required"), (~blank(url) & ~F.regexp_like(url, F.lit("^https?://[^/]+")), "url is not valid"), (~F.coalesce(runnable, F.lit(False)), "provider can't be run")]
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in checks]), lambda x: x.isNotNull())


def languages(configured: Column, master: Column) -> Column:
    """Configured languages trimmed and once each, the master language first if it isn't among them."""
    own = T.ordered_unique(F.coalesce(configured, F.array().cast("array<string>")))
    return F.when(F.array_contains(own, master), own).otherwise(F.concat(F.array(master), own))


def json_list(c: Column) -> Column:
    """Array of strings of a JSON text; anything else gives an empty one."""
    return F.coalesce(F.from_json(F.when(F.regexp_like(c, F.lit(r"^\s*\[")), c), "array<string>"), F.array().cast("array<string>"))


def merged_catalog(static: DataFrame, discovered: DataFrame, provider: str) -> DataFrame:
    """(provider, value, label) of a static catalogue, in which the discovered models (id, label, capability) take the place of one provider's, if there are any with an id."""
    value = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    own = static.select("provider", value("value").alias("value"), F.coalesce(F.nullif(value("label"), F.lit("")), value("value")).alias("label")).where("value <> ''")
    label = F.concat_ws(" - ", F.nullif(F.coalesce(F.nullif(value("label"), F.lit("")), value("id")), F.lit("")), F.nullif(value("capability"), F.lit("")))
    new = discovered.select(F.lit(provider).alias("provider"), value("id").alias("value"), label.alias("label")).where("value <> ''")
    kept = own.join(new.select("provider").limit(1), "provider", "left_anti")
    return kept.unionByName(new)


def discovered_models(found: DataFrame, model: str) -> DataFrame:
    """Names of models as a provider lists them: trimmed, each once, blank ones left out, with `recommended` on the first by name whatever its case."""
    names = found.select(F.trim(F.col(model)).alias(model)).where(F.coalesce(F.col(model), F.lit("")) != "").distinct()
    first = names.agg(F.min_by(F.col(model), F.struct(F.lower(model), F.col(model))).alias("_first"))
    return names.select(model, (F.col(model) == first.scalar()).alias("recommended"))
