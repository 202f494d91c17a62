"""Cases with known results, for operators and functions that no SQL states."""

import pytest
from pyspark.sql import functions as F

from lumenreel import tables
from lumenreel.functions import languages, text, times
from lumenreel.operators import assets, cues, entities, jobs, profiles, quality, scenes, segmentation, store, words
from lumenreel.sources import files, subtitles
from lumenreel.streaming import logs


def one(spark, value, fn, kind="string"):
    """fn of a single value."""
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    ("fn", "value", "expected"),
    [
        (text.collapse, "  a  b\n\tc ", "a b c"),
        (text.slug, "--Ünter den Linden!--", "nter-den-linden"),
        (text.slug, "???", "job"),
        (text.mask_secret, "abcdefgh", "********"),
        (text.mask_secret, "abcdefghi", "abcd****fghi"),
        (text.mask_secret, None, ""),
        (text.strip_fences, "```json\n{\"a\": 1}\n```", '{"a": 1}'),
        (text.number_in_name, "003_prompt7 (4)", 7),
        (text.number_in_name, "012 take", 12),
        (text.number_in_name, "none", None),
        (text.suffix_class, "a/b.JPEG", "image"),
        (text.suffix_class, "noext", ""),
        (text.token, "L’Été_1!", "lété_1"),
        (text.gibberish_token, "fine words xqtrplmn here", "xqtrplmn"),
        (text.gibberish_token, "soooooooo long", "soooooooo"),
        (text.gibberish_token, "rhythm strengths", None),
        (text.prompt_value, "The same; man , as before ", "the shared, man, with consistent continuity"),
        (times.parse_stamp, "01:02:03,004", 3_723_004),
        (times.parse_stamp, "1:2:3", None),
        (quality.issue_category, "The DIGITS must be words", "digits_present"),
        (quality.issue_category, "  ", "provider_error"),
        (quality.issue_category, "Sounds robotic", "literal_phrasing"),
        (languages.language_code, "Deutsch", "de"),
        (languages.language_code, "pt-BR", "pt"),
        (languages.pack_code, "pt-BR", "en"),
        (languages.language_code, None, "en"),
    ],
)
def test_scalars(spark, fn, value, expected):
    assert one(spark, value, fn) == expected


def test_stamps_pass_ninety_nine_hours(spark):
    assert one(spark, 360_000_001, times.format_stamp, "bigint") == "100:00:00,001"
    assert one(spark, -5, times.format_stamp, "bigint") == "00:00:00,000"


@pytest.mark.parametrize(("value", "lang", "expected"), [("1 Jean 4:8", "fr", "Premier Jean chapitre 4 verset 8"), ("Johannes 3:16-17", "de", "Johannes Kapitel 3 Verse 16 bis 17"), ("St. Mark", "en", "Saint Mark"), ("  ", "en", "")])
def test_spoken_form(spark, value, lang, expected):
    assert one(spark, value, lambda c: languages.spoken_form(c, F.lit(lang))) == expected


def test_channel_names(spark):
    assert one(spark, "See OLD name now", lambda c: languages.replace_channel(c, F.lit("Old Name"), F.lit("New $1"))) == "See New $1 now"
    assert one(spark, "please subscribe to  Kanal!", lambda c: languages.invite(c, F.lit("de"), F.lit("Kanal"))) == "please Abonniere Kanal!"


def test_prompts(spark):
    rules = ("no logos", "No Text")
    got = one(spark, "calm, NO LOGOS; calm", lambda c: text.prompt_rules(c, rules))
    assert got == "calm, NO LOGOS, No Text"
    assert one(spark, "the same old scene_id", text.prompt_errors) == ["Prompt is too short to be useful.", r"Prompt contains banned content matching \bsame\b.", r"Prompt contains banned content matching \bscene_id\b."]
    lit = F.lit
    made = one(spark, "a king", lambda c: text.prompt_text(lit("video"), c, lit("a hall"), lit("walks"), lit(""), lit("slow pan"), lit(""), lit("dim light."), lit(""), ()))
    assert made == "A king in a hall, walks. Slow pan. Dim light."


def test_findings(spark):
    cats = lambda t, lang, source=None: [f["category"] for f in one(spark, t, lambda c: quality.findings(c, F.lit(lang), None if source is None else F.lit(source)))]
    assert cats("", "fr") == ["empty_output"]
    assert cats("Tengo 2 manzanas y 3 naranjas.", "es") == ["digits_present"]
    assert cats("xqtrplmn xqtrplmn xqtrplmn", "en") == ["gibberish_output"]
    assert cats("Hello world. " * 120, "en", "two words") == ["suspicious_length"]
    assert "source_text_leak" in cats("One two three four five six.", "en", "one TWO three four five six.")
    assert cats("Bitte subscribe to us. Klicke es", "de") == ["english_cta_leak", "language_rule_violation", "language_rule_violation"]
    twice = "un deux trois quatre cinq six\n\nsept\n\nUn deux trois quatre cinq six"
    assert cats(twice, "fr", "source") == ["duplication"]


def test_leaked_items(spark):
    t = spark.createDataFrame([(1, "x A  quick brown fox jumps over"), (2, "quick brown foxes jump"), (3, None), (4, "")], "k int, text string")
    i = spark.createDataFrame([(9, "a quick brown fox"), (8, "too short"), (7, None)], "item int, text string")
    assert rows(quality.contained(t, "k", "text", i, "item", "text")) == [(1, 9)]


SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHi\r\nthere\r\n\r\n00:00:03,000 --> 00:00:04,000\r\nBye\r\n\r\n\r\n7\r\n00:00:09,000 --> 00:00:08,000\r\nx\r\n\r\n8\r\nnot a time\r\nx\r\n\r\nlone"


def test_srt(spark):
    df = spark.createDataFrame([("a", SRT), ("b", ""), ("c", None)], "doc string, text string")
    got = rows(subtitles.parse_srt(df, "doc", "text").select("doc", "index", "start_ms", "end_ms", "text", F.col("error").isNull()))
    assert got[:2] == [("a", 1, 1000, 2500, "Hi\nthere", True), ("a", 2, 3000, 4000, "Bye", True)]
    assert [g[-1] for g in got] == [True, True, False, False, False, False, False]
    with pytest.raises(Exception, match="SRT block"):
        subtitles.assert_valid(subtitles.parse_srt(df, "doc", "text")).collect()


def test_textgrid(spark):
    grid = 'item [1]:\n name = "words"\n intervals [1]:\n xmin = 0.0\n xmax = 0.5\n text = "hi"\n intervals [2]:\n xmin = 0.5\n xmax = 0.7\n text = "sp"\nitem [2]:\n name = "phones"\n xmin = 0\n xmax = 1\n text = "h"\n'
    df = spark.createDataFrame([(1, grid), (2, None)], "k int, text string")
    assert rows(subtitles.parse_textgrid(df, "k", "text")) == [(1, 0, "hi", 0.0, 0.5)]


def test_scripts_and_listing(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:document>')
    (tmp_path / "b.txt").write_bytes("café".encode("cp1252"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("c")
    (tmp_path / "empty.txt").write_text("")
    got = subtitles.read_scripts(spark.read.format("binaryFile").load(str(tmp_path / "*.*")))
    assert {r["path"].rsplit("/", 1)[1]: r["text"] for r in got.collect()} == {"a.docx": "One two\n\nThree", "b.txt": "café"}
    names = [r["name"] for r in files.listing(spark, f"file:{tmp_path}", [".docx", ".txt"]).collect()]
    assert names == ["a.docx", "b.txt", "sub/c.txt"]
    assert files.read_json(spark, str(tmp_path / "none"), "a int").count() == 0


def cue_df(spark, cues_):
    return spark.createDataFrame([("d", k, s, e, t) for k, (s, e, t) in enumerate(cues_, 1)], "doc string, pos int, start_ms bigint, end_ms bigint, text string")


def test_planning_windows(spark):
    df = cue_df(spark, [(k * 120_000, (k + 1) * 120_000, "x") for k in range(4)])
    got = rows(cues.hop_windows(df, "doc", "pos", 300_000, 30_000))
    assert got == [("d", 1, 0, 300_000, 3, 1, 3), ("d", 2, 270_000, 480_000, 2, 3, 4)]
    assert rows(cues.hop_windows(df, "doc", "pos", 480_000, 30_000)) == [("d", 1, 0, 480_000, 4, 1, 4)]


def test_dedupe_and_ownership(spark):
    s = spark.createDataFrame([("d", 1, 0, 5000, "One"), ("d", 1, 5000, 10000, "Two"), ("d", 2, 5010, 10020, " two "), ("d", 2, 10000, 15000, "Three")], "doc string, chunk int, start_ms bigint, end_ms bigint, text string")
    assert [r["text"] for r in scenes.dedupe(s, "doc", ["chunk"]).orderBy("start_ms").collect()] == ["One", "Two", "Three"]
    edge = spark.createDataFrame([("d", 1, 320_000, 350_000, "Edge A"), ("d", 1, 350_000, 380_000, "Core A"), ("d", 2, 330_000, 360_000, "Edge B"), ("d", 2, 360_000, 390_000, "Core B")], "doc string, chunk int, start_ms bigint, end_ms bigint, text string")
    w = spark.createDataFrame([("d", 1, 0, 360_000), ("d", 2, 330_000, 690_000)], "doc string, chunk int, from_ms bigint, to_ms bigint")
    assert sorted(r["text"] for r in scenes.owned(edge, w, "doc", "chunk", 30_000).collect()) == ["Core B", "Edge A", "Edge B"]


def test_split_long_scene(spark):
    c = cue_df(spark, [(0, 8000, "One."), (8000, 16_000, "Two."), (16_000, 24_000, "Three.")])
    s = spark.createDataFrame([("d", 1, 0, 24_000), ("d", 2, 30_000, 60_000), ("d", 3, 60_000, 61_000)], "doc string, scene int, start_ms bigint, end_ms bigint")
    got = rows(scenes.split_long(s, c, "doc", "scene"))
    assert got == [("d", 1, 0, 0, 16_000), ("d", 1, 1, 16_000, 24_000), ("d", 2, 0, 30_000, 60_000), ("d", 3, 0, 60_000, 61_000)]


def test_rebase_and_coverage(spark):
    s = spark.createDataFrame([(1, 0, 12_000), (1, 12_000, 28_000), (2, 5000, 6000)], "chunk int, start_ms bigint, end_ms bigint")
    w = spark.createDataFrame([(1, 2_970_000, 3_330_000), (2, 0, 10_000)], "chunk int, from_ms bigint, to_ms bigint")
    assert rows(scenes.rebase(s, w, "chunk")) == [(1, 2_970_000, 2_982_000, True), (1, 2_982_000, 2_998_000, True), (2, 5000, 6000, False)]
    checked = scenes.checks(spark.createDataFrame([("d", 1, 0, 8000)], "doc string, pos int, start_ms bigint, end_ms bigint"), "doc", ["pos"])
    got = scenes.report(checked, "doc", "pos", cue_df(spark, [(0, 16_000, "x")])).first()
    assert (got["status"], got["errors"], got["tail_gap_ms"]) == ("invalid", 1, 8000)


def test_clean_scenes(spark):
    data = [("d", 1, "0", "5", "5", " a  b ", None), ("d", 2, "5", "5", "0", "", "gap absorbed"), ("d", 3, "5", "9", "9", "c", ""), ("d", 4, "9", "9", "0", "x", ""), ("d", 5, "10", "11", "1", "", "")]
    df = spark.createDataFrame(data, "doc string, pos int, start string, end string, duration string, text string, notes string")
    got = rows(scenes.clean(df, ["doc"], "pos").select("pos", "start_ms", "end_ms", "text", "error", "warning"))
    assert got == [(1, 0, 5000, "a b", None, None), (3, 5000, 9000, "c", None, "Scene duration does not match start/end.")]
    bad = scenes.clean(df.unionAll(spark.createDataFrame([("d", 6, "x", "1", None, "t", "")], df.schema)), ["doc"], "pos")
    assert [r["error"] for r in bad.orderBy("pos").collect()] == [None, None, "Scene ends before it starts.", "Scene has no text.", "Invalid numeric field."]


def test_packing(spark):
    df = spark.createDataFrame([("d", 1, "One two. Three four five. Six!"), ("e", 1, "x" * 25), ("f", 1, None)], "doc string, k int, text string")
    assert rows(cues.pack_sentences(df, "doc", "text", 10)) == [("d", 0, "One two."), ("d", 1, "Three four"), ("d", 2, "five. Six!"), ("e", 0, "x" * 10), ("e", 1, "x" * 10), ("e", 2, "x" * 5)]
    p = spark.createDataFrame([("d", "a b\n\nc\n\nd e. f g h. tail\n\ni")], "doc string, text string")
    assert rows(cues.pack_paragraphs(p, "doc", "text", 3)) == [("d", 0, 3, "a b\n\nc"), ("d", 1, 2, "d e."), ("d", 2, 3, "f g h."), ("d", 3, 1, "i")]
    s = spark.createDataFrame([("d", 1, "a b"), ("d", 2, " "), ("d", 3, "c"), ("d", 4, "d e f g")], "doc string, pos int, text string")
    assert rows(cues.pack_words(s, "doc", "pos", "text", 3)) == [("d", 1, 1), ("d", 3, 1), ("d", 4, 2)]


def test_running_holds_hot_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("o"), F.lit(2).cast("bigint").alias("v"))
    got = tables.running(df, ["k"], ["o"], "n", total=F.col("v")).where("k = 1").orderBy("o").collect()
    assert [(r["n"], r["total"]) for r in got] == [(k, 2 * k) for k in range(1, 335)]
    assert tables.running(df.limit(0), ["k"], ["o"]).count() == 0


def test_words(spark):
    df = spark.createDataFrame([("d", "“L’été,” he said.\n\nTwo\nlines"), ("e", None)], "doc string, text string")
    got = words.tokenize(df, "doc", "text").orderBy("index").collect()
    assert [(r["word"], r["form"], r["leading"], r["trailing"], r["paragraph"]) for r in got] == [("L'été", "lété", '"', ',"', 0), ("he", "he", "", "", 0), ("said", "said", "", ".", 0), ("Two", "two", "", "", 1), ("lines", "lines", "", "", 1)]
    assert rows(words.paragraph_ranges(words.tokenize(df, "doc", "text"), "doc")) == [("d", 0, 0, 3), ("d", 1, 3, 5)]
    r = spark.createDataFrame([("d", 0, 0, 400), ("d", 1, 400, 500), ("d", 2, 500, 560), ("d", 3, 560, 1500)], "doc string, paragraph int, first int, behind_last int")
    assert [tuple(x)[2:] for x in words.guided_chunks(r, "doc").orderBy("chunk").collect()] == [(0, 500, 0, 512), (500, 560, 488, 572), (560, 1010, 548, 1022), (1010, 1460, 998, 1472), (1460, 1500, 1448, 1500)]


@pytest.mark.parametrize(
    ("lang", "script", "raw", "how"),
    [
        ("fr", ["cest", "bien"], [("c", 0.0, 0.1), ("est", 0.1, 0.3), ("bien", 0.4, 0.6)], ["merge", "equal"]),
        ("es", ["de", "el", "camino"], [("del", 0.0, 0.2), ("camino", 0.3, 0.5)], ["split", "split", "equal"]),
        ("fr", ["magnifique"], [("magnifiqe", 0.0, 0.2)], ["fuzzy"]),
        ("en", ["one", "lost", "two"], [("one", 0.0, 0.2), ("two", 0.6, 0.8)], ["equal", "approximate", "equal"]),
        ("en", ["all", "gone"], [], ["approximate", "approximate"]),
    ],
)
def test_alignment(spark, lang, script, raw, how):
    s = spark.createDataFrame([("d", k, w, lang) for k, w in enumerate(script)], "doc string, index int, form string, language string")
    r = spark.createDataFrame([("d", k, *x) for k, x in enumerate(raw)], "doc string, position int, form string, start double, end double")
    got = words.align(s, r, "doc", "language").orderBy("index").collect()
    assert [x["how"] for x in got] == how
    assert all(x["end"] > x["start"] for x in got)
    if how == ["merge", "equal"]:
        assert (got[0]["start"], got[0]["end"]) == (0.0, 0.3)


def brute_segments(w):
    """The cheapest of all cuts, one by one."""
    rules = segmentation.Rules("en")
    n = len(w)
    shown = segmentation.Breaks([x[0] + x[1] for x in w], rules)
    begin = [max(0.0, w[k][2] - min((w[k][2] - (w[k - 1][3] if k else 0.0)) / 2, 0.75)) for k in range(n)]
    end = [w[k][3] + (min((w[k + 1][2] - w[k][3]) / 2, 0.75) if k + 1 < n else 0.0) for k in range(n)]
    found = []
    for mask in range(1 << (n - 1)):
        ends = [k for k in range(n) if k == n - 1 or mask >> k & 1]
        cost, at = [0, 18.0, 0.0, 0, 0, 0, 0], 0
        for j in ends:
            length = max(end[j] - begin[at], 0.01)
            _, fits, bad, chars = shown.lines(at, j)
            if j > at and (length > 7 or chars > 84 or not fits):
                break
            speed = chars / length
            bad += rules.between(w[j][0], w[j + 1][0] if j + 1 < n else "")
            cost = [cost[0] + (speed > 18), max(cost[1], speed), cost[2] + max(0.0, speed - 18), cost[3] + (not rules.ends(w[j][0], w[j][1])), cost[4] + (length < 1.2), cost[5] + 1, cost[6] + bad]
            at = j + 1
        else:
            found.append((tuple(round(c, 6) for c in cost), ends))
    return min(found)[0], found


def test_segments_are_the_best_of_all_cuts(spark):
    said = "When the king came, nobody in the hall of mirrors spoke to him.".split()
    w, at = [], 0.3
    for k, x in enumerate(said):
        bare = x.rstrip(",.")
        w.append((bare, x[len(bare) :], at, at + 0.07 * len(bare)))
        at += 0.07 * len(bare) + (0.9 if k == 3 else 0.05)
    df = spark.createDataFrame([("d", k, a, "", b, s, e, "en") for k, (a, b, s, e) in enumerate(w)], "doc string, index int, word string, leading string, trailing string, start double, end double, language string")
    got = segmentation.segment(df, "doc", "language").orderBy("segment").collect()
    best, cuts = brute_segments(w)
    assert [r["last"] for r in got] in [ends for cost, ends in cuts if cost == best]
    assert all(len(line) <= 42 for r in got for line in r["text"].split("\n"))
    shared = segmentation.share_gaps(segmentation.segment(df, "doc", "language"), "doc").orderBy("segment").collect()
    assert all(a["end"] <= b["start"] + 1e-9 for a, b in zip(shared, shared[1:]))


def test_assets(spark):
    s = spark.createDataFrame([("e", 1, 1, "image"), ("e", 2, 2, "video"), ("e", 3, 3, "image"), ("e", 4, 4, "image"), ("e", 5, 5, "image")], "ep string, scene bigint, scene_number bigint, asset_type string")
    f = spark.createDataFrame([("e", n) for n in ("001_prompt1.mp4", "001_prompt1.png", "002_scene2.mp4", "orphan_b.webp", "orphan_a.png", "notes.txt")], "ep string, name string")
    got = rows(assets.assign(s, assets.scan_files(f, "name"), "ep"))
    assert got == [("e", 1, "001_prompt1.png", "image"), ("e", 2, "002_scene2.mp4", "video"), ("e", 3, "001_prompt1.mp4", "video"), ("e", 4, "orphan_a.png", "image"), ("e", 5, "orphan_b.webp", "image")]


def test_entities(spark):
    t = spark.createDataFrame([(1, "Then Mary Magdalene's brother met PETER."), (2, "Peters and marys"), (3, None)], "k int, text string")
    a = spark.createDataFrame([("mary", "Mary Magdalene"), ("mary", "Magdalene"), ("peter", "peter")], "entity string, alias string")
    found = entities.mentions(t, "k", "text", a)
    assert rows(found) == [(1, "mary", 1), (1, "peter", 5)]
    assert rows(entities.ordered_mentions(found, "k")) == [(1, ["mary", "peter"])]
    refs = spark.createDataFrame([(1, "Mary_M: young"), (2, "nobody")], "k int, ref string")
    assert rows(entities.resolve(refs, "k", "ref", spark.createDataFrame([("mary m", "mary")], "name string, entity string"))) == [(1, "Mary_M: young", "mary")]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(store.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d"), (None, "n")]
    assert rows(store.conflicts(old, new, ["k"])) == [(2, "c")]
    assert rows(store.changed(old, old.unionAll(new.where("k = 3")), ["k"], ["v"]).where("k is not null")) == [(3, "d")]
    assert rows(store.update(old, F.col("k") > 1, v=F.lit("x"))) == [(1, "a"), (2, "x"), (None, "n")]
    assert rows(store.delete_in(old, "k", [])) == rows(old)
    with pytest.raises(Exception, match="no asset"):
        store.strict_join(new, old.where("k = 2").select("k"), "k", "no asset").collect()


def test_jobs(spark):
    d = F.lit("done")
    assert one(spark, "failed", lambda c: jobs.tone(d, c)) == "error"
    assert one(spark, None, lambda c: jobs.tone(d, c)) == "warn"
    assert one(spark, "Completed ", jobs.stage_status) == "done"
    assert one(spark, "draft", lambda c: jobs.board_column(F.lit(""), F.lit("queued"), c, F.lit("speech"), ("draft", "speech"))) == "speech"
    assert one(spark, "x", lambda c: jobs.start_stage(c, F.lit("b"), ("a", "b"))) == "b"
    parts = spark.createDataFrame([("j", 1), ("j", 5)], "job string, n int")
    assert rows(jobs.resume_index(parts, "job", "n", 10)) == [("j", 3)]


def test_profiles(spark):
    got = one(spark, '{"top_k": 500, "speed": "fast"}', profiles.voice_settings)
    assert (got["top_k"], got["speed"], got["temperature"]) == (80.0, 1.0, 0.55)
    m = spark.createDataFrame([("ab-1",), ("abc-2",), ("zz",)], "model string")
    h = spark.createDataFrame([("ab", 5, 1, 2), ("abc", 1, 2, 3)], "prefix string, priority int, price int, speed int")
    assert rows(profiles.model_scores(m, "model", h)) == [("ab-1", 5, 1, 2), ("abc-2", 1, 2, 3), ("zz", 999, 3, 3)]
    assert profiles.recommended(m, "model", ["none", "zz"]).first()["model"] == "zz"
    assert one(spark, "not json", profiles.json_list) == []
    assert one(spark, '["a"]', profiles.json_list) == ["a"]
    assert one(spark, "en", lambda c: profiles.languages(F.array(F.lit(" de "), F.lit("de")), c)) == ["en", "de"]


def test_throttle_of_a_stream(spark, tmp_path):
    data = [("j", k, 12, k * 0.1 if k < 8 else k * 1.0) for k in range(1, 13)]
    spark.createDataFrame(data, "job string, part int, total int, at double").write.parquet(str(tmp_path / "in"))
    src = logs.source(spark, str(tmp_path / "in"), "job string, part int, total int, at double")
    got = logs.run_all(logs.throttle(src, "job"), str(tmp_path), "t")
    assert sorted(r["part"] for r in got.collect()) == [1, 5, 8, 10, 12]


def test_sensitive_terms_against_a_plain_scan(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(-1, "Amen to New York, new york and New York. Yahweh and messiah; Old Town Hall x"), (-2, None)], "doc_id bigint, text string"))
    got = {r["doc_id"]: list(r["t"]) for r in docs.select("doc_id", quality.sensitive_terms(F.col("text")).alias("t")).collect()}
    for r in docs.collect():
        text, out = r["text"] or "", []
        for term in [p for p in ("Amen", "Hallelujah", "Yahweh", "Messiah") if re.search(rf"\b{p}\b", text)] + re.findall(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b", text):
            if term.lower() not in [x.lower() for x in out]:
                out.append(term)
        assert got[r["doc_id"]] == out[:14]
    assert got[-1] == ["Amen", "Yahweh", "New York", "Old Town Hall"]
