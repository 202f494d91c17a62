"""Checks of translated texts, as one expression for each, and the categories of what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import languages as L
from lumenreel.functions import text as T

# How much longer a translation may be, as a ratio and in words.
LONGER_RATIO, LONGER_WORDS = 1.6, 180

# Categories by wording of an issue. Of each: lists of fragments that must all be there, in order of precedence.
ISSUE_RULES: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("quota_exceeded", (("quota exceeded",), ("quota", "exceeded"))),
    ("invalid_api_key", (("invalid api key",), ("api key is invalid",), ("authentication",), ("unauthorized",))),
    ("rate_limited", (("rate limited",), ("too many requests",))),
    ("network_timeout", (("timed out",), ("timeout",))),
    ("empty_output", (("empty translation",), ("empty output",), ("empty chunk",))),
    ("digits_present", (("digits", "words"),)),
    ("gibberish_output", (("gibberish",), ("non-word output",))),
    ("source_channel_leak", (("source channel",),)),
    ("missing_target_channel_name", (("configured channel name",), ("target channel name",))),
    ("source_text_leak", (("untranslated source paragraphs",),)),
    ("english_cta_leak", (("english cta wording",),)),
    ("wrong_name", (("wrong name",), ("wrong names",), ("proper name",), ("historical name",), ("historical names",), ("historical figure",), ("name should stay",))),
    ("leftover_source_language", (("leftover english",), ("stayed in english",), ("left in english",), ("source-language",), ("source language",), ("untranslated",), ("english phrase",), ("english wording",))),
    ("cta_quality", (("cta",), ("call to action",), ("subscribe",), ("share this video",), ("click here",), ("like this video",))),
    ("channel_name", (("channel name",), ("channel-name",))),
    ("duplication", (("duplicate",), ("duplicated",), ("repeated paragraph",), ("repeated line",))),
    ("literal_phrasing", (("awkward",), ("unnatural",), ("literal",), ("robotic",), ("calque",), ("stiff wording",), ("broken wording",), ("phrasing",))),
    ("faithfulness", (("mistranslation",), ("meaning drift",), ("meaning changed",), ("not faithful",), ("incorrect",), ("inaccurate",), ("wrong historical",), ("faithfulness",))),
    ("provider_error", (("failed to connect",), ("connection refused",))),
)

# Labels of categories.
LABELS = {
    "wrong_name": "Wrong names",
    "leftover_source_language": "Leftover English",
    "literal_phrasing": "Awkward phrasing",
    "faithfulness": "Meaning drift",
    "cta_quality": "CTA needs rewrite",
    "channel_name": "Channel name issue",
    "duplication": "Duplicated text",
    "empty_output": "Empty output",
    "provider_error": "Provider unavailable",
    "quota_exceeded": "Quota exceeded",
    "invalid_api_key": "Invalid API key",
    "rate_limited": "Rate limited",
    "network_timeout": "Timeout",
    "source_text_leak": "Source text leaked",
    "english_cta_leak": "English CTA leaked",
    "source_channel_leak": "Source channel leaked",
    "missing_target_channel_name": "Target channel missing",
    "digits_present": "Digits present",
    "gibberish_output": "Gibberish output",
    "language_rule_violation": "Language rule issue",
}


def issue_category(c: Column) -> Column:
    """Category of an issue by its wording: the first rule that holds, else faithfulness; blank is provider_error."""
    t = T.compare_form(F.coalesce(c, F.lit("")))
    out = F.when(t == "", F.lit("provider_error"))
    for name, cases in ISSUE_RULES:
        hit = F.lit(False)
        for fragments in cases:
            every = F.lit(True)
            for f in fragments:
                every = every & F.contains(t, F.lit(f))
            hit = hit | every
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("faithfulness"))


def summary(categories: Column, most: int = 2) -> Column:
    """Up to so many different labels of an array of categories, joined by 'and'."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    labels = F.array_distinct(F.filter(F.transform(categories, lambda c: F.try_element_at(table, c)), lambda x: x.isNotNull()))
    return F.array_join(F.slice(labels, 1, most), " and ")


def finding(category: str, message: str, when: Column, part: Column | None = None) -> Column:
    what = T.excerpt(part) if part is not None else F.lit(None).cast("string")
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), F.lit(message).alias("message"), what.alias("excerpt")))


def doubled(parts: Column) -> Column:
    """The first string of an array that stands in it again."""
    twice = T.let(F.array_sort(parts), lambda s: F.filter(s, lambda p, k: (k > 0) & (F.try_element_at(s, F.when(k > 0, k).otherwise(1)) == p)))
    return T.let(twice, lambda d: F.try_element_at(F.filter(parts, lambda p: F.array_contains(d, p)), F.lit(1)))


def findings(translated: Column, language: Column, source: Column | None = None, source_channel: Column | None = None, target_channel: Column | None = None, break_at: str = r"\n\s*\n+") -> Column:
    """Array of (category, message, excerpt) of a translated text, in a fixed order, none twice.

    An empty text has that one finding. Without a source text, its checks do not take place.
    """
    t = F.trim(F.coalesce(translated, F.lit("")))
    code = L.pack_code(language)
    low = T.compare_form(t)
    out = []
    if source is not None:
        n_in, n_out = T.word_count(F.coalesce(source, F.lit(""))), T.word_count(t)
        most = F.greatest(F.floor(n_in * LONGER_RATIO), n_in + LONGER_WORDS)
        leaked = F.try_element_at(F.filter(T.paragraphs(F.coalesce(source, F.lit("")), break_at), lambda p: F.contains(low, p)), F.lit(1))
        twice = doubled(T.paragraphs(t, break_at))
        has_source = F.trim(F.coalesce(source, F.lit(""))) != ""
        out += [
            finding("suspicious_length", "Output is suspiciously long and may contain duplicated source text.", (n_in > 0) & (n_out > most), t),
            finding("source_text_leak", "Translation still contains untranslated source paragraphs.", leaked.isNotNull(), leaked),
            finding("duplication", "Translation contains duplicated translated paragraphs.", has_source & twice.isNotNull(), twice),
        ]
    invite = "(?i)(?:" + "|".join(L.ENGLISH_INVITES) + ")"
    out.append(finding("english_cta_leak", "Translation still contains English CTA wording.", (code != "en") & F.regexp_like(t, F.lit(invite)), T.around(t, invite)))
    for lang, rules in L.BAD_WORDINGS.items():
        for pattern, message in rules:
            rx = f"(?iU){pattern}"
            out.append(finding("language_rule_violation", message, (code == lang) & F.regexp_like(t, F.lit(rx)), T.around(t, rx)))
    if source_channel is not None and target_channel is not None:
        s, g = F.coalesce(source_channel, F.lit("")), F.coalesce(target_channel, F.lit(""))
        both, inside = (s != "") & (g != ""), lambda a, b: F.contains(F.lower(a), F.lower(b))
        out.append(finding("source_channel_leak", "Translation still contains the source channel name.", both & inside(t, s)))
        if source is not None:
            out.append(finding("missing_target_channel_name", "Translation did not use the configured channel name.", both & inside(source, s) & ~inside(t, g)))
    rx = r"\p{Nd}"
    out.append(finding("digits_present", "Translation still contains digits; narration must use numbers written as words.", F.regexp_like(t, F.lit(rx)), T.around(t, rx)))
    odd = T.gibberish_token(t)
    out.append(finding("gibberish_output", "Translation contains gibberish or non-word output that is unsafe for narration.", odd.isNotNull(), odd))
    found = F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))
    empty = F.array(finding("empty_output", "Model returned empty translation.", F.lit(True)))
    return F.when(t == "", empty).otherwise(found)


def gate(df: DataFrame, found: str) -> DataFrame:
    """`df` with passed, categories (in order, each once) and their summary, from a column of findings."""
    categories = F.array_distinct(F.transform(found, lambda f: f["category"]))
    return df.withColumns({"passed": F.size(found) == 0, "categories": categories, "summary": summary(categories)})


def repeated_lines(df: DataFrame, key: str, text: str, break_at: str = "\n", least_words: int = 6) -> DataFrame:
    """(key, line, times, first_at): lines of at least so many words that stand several times in a text, in compare form."""
    lines = df.select(key, F.posexplode(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), break_at), T.compare_form)).alias("at", "line"))
    long = lines.where(F.size(F.split("line", " ")) >= least_words)
    return long.groupBy(key, "line").agg(F.count("*").alias("times"), F.min("at").alias("first_at")).where("times > 1")


def contained(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, anchor: int = 4) -> DataFrame:
    """(key, item_key): items whose words stand one after another in a text, in compare form; none of fewer words than the anchor.

    An equality join on the item's first words finds the candidates, each text's run of words is read
    once, and the whole item is then looked for.
    """
    form = lambda c: T.compare_form(F.coalesce(F.col(c), F.lit("")))
    run = lambda w, k: F.array_join(F.slice(w, k, F.lit(anchor)), " ")
    i = items.select(F.col(item_key), form(item_text).alias("_item")).where(F.size(F.split("_item", " ")) >= anchor).withColumn("_run", run(F.split("_item", " "), F.lit(1)))
    t = texts.select(F.col(key), F.monotonically_increasing_id().alias("_row"), form(text).alias("_text"))
    w = F.split("_text", " ")
    runs = t.where(F.size(w) >= anchor).select("_row", F.explode(T.runs(w, anchor)).alias("_run"))
    candidates = runs.join(i, "_run").select("_row", item_key, "_item")
    return t.join(candidates, "_row").where(F.contains(F.concat(F.lit(" "), "_text", F.lit(" ")), F.concat(F.lit(" "), "_item", F.lit(" ")))).select(key, item_key).distinct()


# Kinds of failures of a provider by status code, then by wording.
FAILURE_CODES = {401: "invalid_api_key", 403: "invalid_api_key", 408: "network_timeout", 429: "rate_limited", 504: "network_timeout"}


def failure(code: Column, message: Column) -> Column:
    """Kind of a provider's failure: a quota comes before the status code, the code before the wording."""
    t = T.compare_form(F.coalesce(message, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in FAILURE_CODES.items() for x in kv])
    quota = F.contains(t, F.lit("quota")) | F.contains(t, F.lit("insufficient funds"))
    by_text = issue_category(message)
    worded = F.when(by_text.isin("invalid_api_key", "rate_limited", "network_timeout"), by_text).otherwise(F.lit("provider_error"))
    return F.when(quota, F.lit("quota_exceeded")).otherwise(F.coalesce(F.try_element_at(table, code), worded))


def review(report_text: Column, least: int = 4) -> Column:
    """(passed, scores, issues) of a reviewer's JSON answer: five whole scores, all of them `least` or more; null if it can't be read."""
    body = F.regexp_extract(F.coalesce(report_text, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "scores map<string,int>, passed boolean, issues array<string>", {"mode": "PERMISSIVE"})
    scores = F.map_values(parsed["scores"])
    good = (F.size(scores) == 5) & F.forall(scores, lambda s: s.isNotNull() & s.between(1, 5)) & parsed["passed"].isNotNull()
    passed = F.forall(scores, lambda s: s >= least)
    return F.when(good, F.struct(passed.alias("passed"), parsed["scores"].alias("scores"), T.ordered_unique(F.coalesce(parsed["issues"], F.array().cast("array<string>"))).alias("issues")))


def sensitive_terms(text: Column, protected: tuple[str, ...] = ("Amen", "Hallelujah", "Yahweh", "Messiah"), most: int = 14) -> Column:
    """Array of the terms that a translation should keep: protected ones that occur, then phrases of several capitalised words; each once whatever its case."""
    t = F.coalesce(text, F.lit(""))
    own = F.array(*[F.when(F.regexp_like(t, F.lit(rf"\b{p}\b")), F.lit(p)) for p in protected])
    phrases = F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b"), F.lit(1))
    return F.slice(T.unique_ignoring_case(F.filter(F.concat(own, phrases), lambda x: x.isNotNull())), 1, most)


def feedback(message: Column, given_summary: Column, given: Column, report: Column) -> Column:
    """(summary, categories, passed) for the author of a translation.

    Categories are the given ones, else those of the report (error_categories, error_summary, passed), else the message's; without a
    report given ones don't count. The summary is the given one, else the report's, else made of the categories.
    """
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    listed = F.when(report.isNotNull(), clean(F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(report["error_categories"]))).otherwise(clean(F.lit(None).cast("array<string>")))
    says = F.coalesce(message, F.lit("")) != ""
    categories = F.when((F.size(listed) == 0) & says, F.array(issue_category(message))).otherwise(listed)
    own = F.nullif(F.trim(F.coalesce(F.nullif(given_summary, F.lit("")), report["error_summary"], F.lit(""))), F.lit(""))
    return F.struct(F.coalesce(own, F.nullif(summary(categories), F.lit(""))).alias("summary"), categories.alias("categories"), report["passed"].alias("passed"))
