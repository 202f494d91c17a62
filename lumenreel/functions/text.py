"""Text functions on columns. All stay inside generated code; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), where the value is computed once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(words_: Column, length: int) -> Column:
    """Array of all runs of so many neighbouring words, joined by spaces, each once."""
    every = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - length + 1, F.lit(1))), lambda k: F.array_join(F.slice(w, k, F.lit(length)), " "))
    return F.array_distinct(let(words_, every))


def collapse(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def compare_form(c: Column) -> Column:
    """Collapsed and in lower case, for comparing."""
    return F.lower(collapse(c))


def words(c: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def paragraphs(c: Column, break_at: str = r"\n\s*\n+", least_words: int = 6) -> Column:
    """Array of paragraphs in compare form that have at least so many words."""
    parts = F.transform(F.split(F.trim(c), break_at), compare_form)
    return F.filter(parts, lambda p: F.size(F.split(p, " ")) >= least_words)


def excerpt(c: Column, limit: int = 180) -> Column:
    """Collapsed; longer texts are cut and end in three dots."""
    t = collapse(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(0, limit - 3))), F.lit("...")))


def around(c: Column, pattern: str, radius: int = 36, limit: int = 180) -> Column:
    """Excerpt of so many characters on each side of the first match; null without a match."""
    hit = F.regexp_substr(c, F.lit(pattern))
    at = F.length(F.element_at(F.split(c, pattern, 2), 1)) + 1
    start = F.greatest(at - radius, F.lit(1))
    return F.when(hit.isNotNull(), excerpt(F.substring(c, start, at + F.length(hit) + radius - start), limit))


def preview(c: Column, limit: int) -> Column:
    """The text as it is, or its first characters and an ellipsis."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def slug(c: Column, fallback: str = "job") -> Column:
    """Lower-case ASCII letters and digits with single dashes between them; the fallback if nothing is left."""
    cut = F.lower(F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def safe_filename(c: Column, fallback: str) -> Column:
    """Slug of the name before its last dot, with the suffix as it was."""
    suffix = F.regexp_extract(c, r"[^./](\.[^./]+)$", 1)
    stem = F.substring(c, F.lit(1), F.length(c) - F.length(suffix))
    return F.concat(slug(stem, fallback), suffix)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def strip_fences(c: Column) -> Column:
    """Without the code fence around the whole text, if there is one."""
    t = F.btrim(c, F.lit(" \t\r\n"))
    fenced = F.startswith(t, F.lit("```")) & F.endswith(t, F.lit("```"))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", "")
    return F.btrim(F.when(fenced, inner).otherwise(t), F.lit(" \t\r\n"))


def mask_secret(c: Column) -> Column:
    """Stars for short secrets; of longer ones four characters stay at each end. Null gives ''."""
    t = F.trim(F.coalesce(c, F.lit("")))
    n = F.length(t)
    stars = F.repeat(F.lit("*"), F.greatest(n - 8, F.lit(4)))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(t, F.lit(4)), stars, F.right(t, F.lit(4))))


#: Places of a number in a file name, in order of preference.
NUMBER_PLACES = (r"(?i)prompt\s*(\d+)", r"(?i)scene[_\s]*(\d+)", r"(?i)asset[_\s]*(\d+)", r"\((\d+)\)", r"^(\d+)")


def number_in_name(c: Column) -> Column:
    """The number of a file name as bigint; null if it has none. Names without the words or a bracket need no pattern: only digits at their beginning count."""
    marked = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("bigint") for p in NUMBER_PLACES[:-1]]
    any_mark = F.contains(c, F.lit("("))
    for word in ("prompt", "scene", "asset"):
        any_mark = any_mark | F.contains(F.lower(c), F.lit(word))
    digits = F.left(c, F.length(c) - F.length(F.ltrim(c, F.lit("0123456789"))))
    return F.coalesce(F.when(any_mark, F.coalesce(*marked)), F.nullif(digits, F.lit("")).try_cast("bigint"))


#: File suffixes by class.
SUFFIX_CLASSES = {
    "image": (".png", ".jpg", ".jpeg", ".webp", ".bmp"),
    "video": (".mp4", ".mov", ".mkv", ".webm", ".avi"),
    "audio": (".wav", ".mp3", ".m4a", ".flac", ".ogg"),
    "json": (".json", ".jsonl"),
    "text": (".txt", ".md", ".srt", ".html", ".csv"),
}


def suffix(c: Column) -> Column:
    """The last dot and what follows it, in lower case; '' if nothing, or a slash, follows it."""
    end = F.substring_index(c, ".", -1)
    return F.when(_no_suffix(c, end), F.lit("")).otherwise(F.lower(F.concat(F.lit("."), end)))


def stem(c: Column) -> Column:
    """A name without its suffix."""
    end = F.substring_index(c, ".", -1)
    return F.when(_no_suffix(c, end), c).otherwise(F.left(c, F.length(c) - F.length(end) - 1))


def _no_suffix(c: Column, end: Column) -> Column:
    return (end == "") | (end == c) | F.contains(end, F.lit("/"))


def suffix_class(c: Column) -> Column:
    """image, video, audio, json, text, binary for other suffixes and '' for none."""
    classes = F.create_map(*[F.lit(x) for name, suffixes in SUFFIX_CLASSES.items() for s in suffixes for x in (s.removeprefix("."), name)])
    known = F.when(F.contains(c, F.lit(".")), F.try_element_at(classes, F.lower(F.substring_index(c, ".", -1))))
    return F.coalesce(known, F.when(suffix(c) == "", F.lit("")).otherwise(F.lit("binary")))


def progress(c: Column) -> Column:
    """(current, total) of a text like 'chunk 3/7'."""
    t = collapse(c)
    part = lambda k: F.regexp_extract(t, r"(?i)chunk\s+(\d+)\s*/\s*(\d+)", k).try_cast("int")
    return F.struct(part(1).alias("current"), part(2).alias("total"))


def percent_done(current: Column, total: Column) -> Column:
    """Rounded half to even and held to 0..100; null without both numbers above zero."""
    p = F.bround(current / total * 100, 0).cast("int")
    return F.when((current > 0) & (total > 0), F.greatest(F.lit(0), F.least(F.lit(100), p)))


_STRAIGHT = ("\u2018\u2019\u201c\u201d\u2013\u2014\u00a0", "''\"\"-- ")


def straighten(c: Column) -> Column:
    """Curly quotes, long dashes and hard spaces as plain ones."""
    return F.translate(c, *_STRAIGHT)


def token(c: Column) -> Column:
    """Form of a word for aligning: lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(straighten(c)), r"(?U)[^\w]+", "")


WORD = r"(?U)[^\W_]+(?:['’-][^\W_]+)*"


def canonical(c: Column) -> Column:
    """Lines joined within paragraphs, paragraphs apart by one empty line, plain quotes."""
    t = straighten(F.regexp_replace(c, r"\r\n?", "\n"))
    parts = F.transform(F.split(t, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r"\s*\n\s*", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def ordered_unique(values: Column) -> Column:
    """Collapsed strings of an array, without empty and repeated ones; the first of each stays in place."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: collapse(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def unique_ignoring_case(values: Column) -> Column:
    """The first of strings that differ in case only."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        new = F.struct(F.array_append(acc["seen"], F.lower(v)).alias("seen"), F.array_append(acc["out"], v).alias("out"))
        return F.when(F.array_contains(acc["seen"], F.lower(v)), acc).otherwise(new)

    return F.aggregate(values, start, step, lambda acc: acc["out"])


#: Wordings of a prompt that refer to other prompts, and what stands for them; in this order.
PROMPT_REWRITES = (
    (r"(?i)\bas before\b", "with consistent continuity"),
    (r"(?i)\bprevious scene\b", "this moment"),
    (r"(?i)\bsee above\b", "within this frame"),
    (r"(?i)\bthe same\b", "the shared"),
    (r"(?i)\bsame\b", "shared"),
)
#: Patterns that a prompt must not hold.
PROMPT_BANNED = (r"\bsame\b", r"\bas before\b", r"\bprevious scene\b", r"\bsee above\b", r"\bscene_id\b", r"\basset_type\b", r"[{}]")


def prompt_value(c: Column) -> Column:
    """A fragment of a prompt without references to others, commas set plainly."""
    t = F.replace(collapse(F.coalesce(c, F.lit(""))), F.lit(";"), F.lit(","))
    for pattern, to in PROMPT_REWRITES:
        t = F.regexp_replace(t, pattern, to)
    return F.btrim(F.regexp_replace(t, r"\s*,\s*", ", "), F.lit(" ,;"))


def prompt_rules(c: Column, mandatory: tuple[str, ...]) -> Column:
    """The rules of a text and the mandatory ones, each once whatever its case, joined by commas."""
    own = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;\n]+"), prompt_value)
    every = F.filter(F.concat(own, F.array(*[prompt_value(F.lit(m)) for m in mandatory])), lambda r: r != "")
    return F.array_join(unique_ignoring_case(every), ", ")


def prompt_errors(c: Column) -> Column:
    """Array of messages on a prompt line; empty if it can be used."""
    t = F.coalesce(c, F.lit(""))
    checks = [
        F.when(F.regexp_like(t, F.lit("[\r\n]")), F.lit("Prompt must be a single line.")),
        F.when(word_count(t) < 6, F.lit("Prompt is too short to be useful.")),
        *[F.when(F.regexp_like(t, F.lit(f"(?i){p}")), F.lit(f"Prompt contains banned content matching {p}.")) for p in PROMPT_BANNED],
    ]
    found = F.filter(F.array(*checks), lambda m: m.isNotNull())
    return F.when(t == "", F.array(F.lit("Prompt is empty."))).otherwise(found)


def sentence(c: Column) -> Column:
    """A fragment with a capital at its start and one full stop at its end; '' stays ''."""
    closed = lambda v: F.when(v == "", v).otherwise(F.concat(F.upper(F.left(v, F.lit(1))), F.rtrim(F.substring(v, 2, 1 << 30), F.lit(" .,:;")), F.lit(".")))
    return let(prompt_value(c), closed)


def prompt_text(kind: Column, subject: Column, setting: Column, action: Column, composition: Column, camera: Column, look: Column, lighting: Column, rules: Column, mandatory: tuple[str, ...]) -> Column:
    """One prompt line out of its fields; action and camera are for videos, composition is for images."""
    placed = lambda s, g: F.concat_ws(" ", F.nullif(s, F.lit("")), F.when((s != "") & (g != ""), F.concat(F.lit("in "), g)).otherwise(F.nullif(g, F.lit(""))))
    first = let(F.struct(prompt_value(subject).alias("s"), prompt_value(setting).alias("g")), lambda v: placed(v["s"], v["g"]))
    more = F.when(kind == "video", prompt_value(action)).otherwise(prompt_value(composition))
    head = let(F.struct(first.alias("first"), more.alias("more")), lambda v: F.concat_ws(", ", F.nullif(v["first"], F.lit("")), F.nullif(v["more"], F.lit(""))))
    parts = [head, F.when(kind == "video", camera), look, lighting, prompt_rules(rules, mandatory)]
    return F.array_join(F.filter(F.array(*[sentence(p) for p in parts]), lambda p: p != ""), " ")


def leading_words(c: Column, most: int, stop_words: tuple[str, ...] = ("a", "an", "and", "at", "for", "in", "of", "on", "or", "the", "to", "with")) -> Column:
    """The first words, without stop words at their end."""
    w = F.slice(words(c), 1, most)
    keep = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))),
        F.lit(0),
        lambda acc, k: F.when(~F.lower(F.coalesce(F.try_element_at(w, k), F.lit("the"))).isin(*stop_words), k).otherwise(acc),
    )
    return F.array_join(F.when(keep > 0, F.slice(w, F.lit(1), F.greatest(keep, F.lit(1)))).otherwise(F.array().cast("array<string>")), " ")


def last_words(c: Column, n: int) -> Column:
    """The last n words, joined by single spaces."""
    w = words(c)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " ")


def gibberish_token(c: Column) -> Column:
    """The first word with one character six times in a row, or of eight or more letters that are all consonants; else null."""
    bare = lambda w: F.btrim(w, F.lit("()[]{}<>\"'.,;:!?"))
    letters = lambda w: F.regexp_replace(bare(w), "[^A-Za-z]", "")
    bad = lambda w: (F.length(bare(w)) >= 6) & (F.regexp_like(bare(w), F.lit(r"(.)\1{5,}")) | F.regexp_like(letters(w), F.lit("(?i)^[bcdfghjklmnpqrstvwxyz]{8,}$")))
    return F.try_element_at(F.filter(words(c), bad), F.lit(1))
