"""op3, op6 and op9: held-out accuracy, planted cases and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenreel.llm import decontaminate, langid, queries, toxicity
from lumenreel.llm.common import read

SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "   "), (4, "1234 !!"), (5, "word"), (5, "word"), (None, "word"), (6, "x" * 200_000), (7, "你好")]


def odd(spark, names):
    return spark.createDataFrame([(i, t, *["c"] * len(names)) for i, t in ODD], "doc_id bigint, text string" + "".join(f", {n} string" for n in names)).repartition(3)


def test_toxicity_on_held_out_rows(spark):
    """On the tables with over a thousand held-out marks; some toxic marks there are noise that no text shows."""
    got = queries.op3_toxicity(spark, SF1)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(read(spark, SF1, "labels"), "doc_id").where("held_out and toxic is not null").collect()
    assert rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    found = [r for r in rows if r["predicted"] == 1]
    assert right > 0.93 and sum(r["toxic"] for r in found) > 0.95 * len(found)
    scores = {k: [r["score"] for r in rows if r["toxic"] == k] for k in (0, 1)}
    assert sum(a < b for a in scores[0] for b in scores[1]) > 0.9 * len(scores[0]) * len(scores[1])
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_toxicity_edge_cases(spark):
    df = odd(spark, ["score", "Predicted", "toxic"])
    labels = spark.createDataFrame([(5, 1), (5, 0), (2, 0), (None, 1), (99, None)], "doc_id bigint, toxic int")
    out = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(df, toxicity.fit(df.limit(0), labels.limit(0))).count() == len(ODD)


def plain_scores(texts, marks, discount):
    """Kneser-Ney class models over bytes, count by count, and their log-likelihood ratios of words; each text's own counts left in."""

    def grams(text):
        return [(f" {w} ".encode()[max(0, i - toxicity.ORDER + 1) : i + 1]) for w in re.findall("[a-z0-9]+", text.lower()) for i in range(1, len(w.encode()) + 2)]

    count = [Counter(), Counter()]
    for t, y in {t: y for t, y in zip(texts, marks, strict=True)}.items():
        count[y].update(set(grams(t)))
    seen = [{}, {}, {}, {}, dict(count[0] + count[1])]
    full = set(seen[4])
    levels = [full]
    for n in range(toxicity.ORDER - 1, 0, -1):
        levels.append({(g if len(g) <= n else g[-n:]) for g in levels[-1]})

    def key(g):  # what a packed n-gram keeps of shorter ones: a missing byte is byte 0
        return b"\0" * (toxicity.ORDER - len(g)) + g

    def shared(g):
        p = 1 / 256
        for n in range(1, toxicity.ORDER + 1):
            longer = {key(x)[-(n + 1) :] for x in full} if n < toxicity.ORDER else None
            c = Counter(x[1:] for x in longer) if longer is not None else Counter({key(x): v for x, v in seen[4].items()})
            h = key(g)[-n:-1] if n > 1 else b""
            same = {x: v for x, v in c.items() if x[:-1] == h}
            size = sum(same.values())
            p = (max(same.get(key(g)[-n:], 0) - toxicity.SHARED_DISCOUNT, 0) + toxicity.SHARED_DISCOUNT * len(same) * p) / size
        return p

    def ratio(g):
        logs = []
        for c in (0, 1):
            same = {x: v for x, v in count[c].items() if x[:-1] == g[:-1] }
            size = sum(same.values())
            back = sum(min(discount, v) for v in same.values()) / size if size else 1
            logs.append(math.log((max(same.get(g, 0) - discount, 0) / size if size else 0) + back * shared(g)) if g in full else math.log(back))
        return logs[1] - logs[0]

    return lambda text: [sum(ratio(g) for g in grams(w)) for w in re.findall("[a-z0-9]+", text.lower())]


def test_toxicity_ratios_are_those_of_a_plain_kneser_ney():
    texts = ["you fool, you fool", "the fool of a man", "a fine man here", "the fine tree", "foolish man", "such a fool here", "a tree here", "that fine fool"]
    marks = [1, 1, 0, 0, 1, 1, 0, 1]
    held = [np.concatenate([np.unique(p.keys) for p in toxicity.pieces([t.encode()])]) for t in texts]
    gram = np.unique(np.concatenate(held))
    gram = gram[gram != 32]
    c = [sum(np.isin(gram, h).astype(int) for h, y in zip(held, marks, strict=True) if y == k) for k in (0, 1)]
    counts = toxicity.Counts.made(gram, *c).common()
    for discount in toxicity.DISCOUNTS[:2]:
        grams, contexts = counts.tables(discount)
        want = plain_scores(texts, marks, discount)
        for text in (*texts, "a fooled tree", "xyz foo"):
            got = []
            for p in toxicity.pieces([text.encode()]):
                r, seen = grams.get(p.keys)
                r = np.where(seen, r, contexts.get(p.keys >> np.uint64(8))[0])
                got += list(p.sums(r))
            assert np.allclose(got, want(text), atol=1e-4), (text, got, want(text))


def test_toxicity_of_few_labels(spark, sf):
    """Small tables and one-sided marks still give a score to every text by what it says."""
    rows = queries.op3_toxicity(spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out and toxic is not null").collect()
    assert len({r["score"] for r in rows}) > 0.8 * len(rows)
    scores = {k: [r["score"] for r in rows if r["toxic"] == k] for k in (0, 1)}
    assert sum(a < b for a in scores[0] for b in scores[1]) > 0.6 * len(scores[0]) * len(scores[1])
    assert any(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    df = spark.createDataFrame([(i, ("you vile worm " if i % 2 else "what a fine day ") + f"no {i}") for i in range(60)], "doc_id bigint, text string")
    out = {c: {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df, df.selectExpr("doc_id", f"cast({c} as int) as toxic"))).collect()} for c in ("doc_id % 2", "1", "null")}
    assert all(out["doc_id % 2"][i] > 0.7 > out["doc_id % 2"][i + 1] for i in range(1, 59, 2))
    assert len(set(out["1"].values())) > 1 and set(out["null"].values()) == {0.5}
    one = toxicity.score(spark.createDataFrame([(1, "a vile worm and 7 words more"), (2, "a vile worm and a vile worm more")], "doc_id bigint, text string"), toxicity.fit(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))).collect()
    assert one[1]["score"] >= one[0]["score"] - 0.05  # a second expression does not speak against the first


def test_toxicity_does_not_grow_with_the_text(spark):
    """Clean texts in one long text score as they do alone, and a toxic one among them is still found."""
    docs, labels = read(spark, SF1, "documents").select("doc_id", "text"), read(spark, SF1, "labels")
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out(F.col("doc_id")) & F.col("text").isNotNull()).orderBy("doc_id").collect()
    texts = [r["text"].encode() for r in rows]
    flagged = model.scores(texts) >= toxicity.THRESHOLD
    clean = [t for t, r, f in zip(texts, rows, flagged, strict=True) if not f and r["toxic"] == 0]
    toxic = [t for t, r, f in zip(texts, rows, flagged, strict=True) if f and r["toxic"] == 1]
    rng = random.Random(0)
    alone = model.scores(clean).mean()
    for k in (5, 20, 100):
        joined = model.scores([b"\n".join(rng.choices(clean, k=k)) for _ in range(100)])
        assert abs(joined.mean() - alone) < 0.05 and joined.max() < toxicity.THRESHOLD, (k, alone, joined.mean(), joined.max())
    hidden = model.scores([b"\n".join([*rng.choices(clean, k=2), t, *rng.choices(clean, k=2)]) for t in toxic])
    assert (hidden >= toxicity.THRESHOLD).mean() > 0.7


def test_toxicity_draws_by_hash(spark):
    """Of many marked rows exactly as many as asked for, whatever the partitions; all of few."""
    df = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as toxic")
    few = lambda d: sorted(tuple(r) for r in toxicity.learning_rows(d, {0: 15_000, 1: 5_000}, {0: 700, 1: 9_000}).collect())
    got = few(df.repartition(7))
    assert sum(t == 0 for _, t in got) == 700 and sum(t for _, t in got) == 5_000 and got == few(df.coalesce(2))
    assert toxicity.learning_rows(df.limit(0), {}).count() == 0


def test_dotted_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "you vile worm", 1, 2), (2, None, 3, 4)], "doc_id bigint, text string, `a.b` int, SCORE int")
    model = toxicity.fit(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"))
    assert toxicity.score(df, model).columns == ["doc_id", "text", "a.b", "score", "predicted"]


def test_toxicity_of_a_thinned_class(spark):
    """Scores are those of the classes' natural shares, however few rows of one class are drawn."""
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices(["tree", "house", "river", "stone", "cloud", "apple"], k=n))
    rows = [(i, f"{some(9)}{' xyzzyx' if i % 9 < 2 else ''} {some(9)}", int(i % 9 == 0)) for i in range(3600)]  # half of those with the word are toxic
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    odds = {}
    for most in (3600, 300):
        model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), {0: most, 1: 3600})
        got = toxicity.score(df.where("text like '%xyzzyx%'"), model).agg(F.avg("score"), F.avg("predicted")).first()
        odds[most] = got[0]
        assert 0.4 < got[0] < 0.6, (most, got)
    assert abs(odds[3600] - odds[300]) < 0.06


def test_language_on_held_out_rows(spark):
    docs = read(spark, SF01, "documents")
    rows = queries.op9_language_id(spark, SF01).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.95 * len(rows)


def test_language_sample_has_no_copies_and_all_languages(spark):
    rows = [(i, f"text number {i % 40 if i >= 3000 else 0} of all", "en") for i in range(4000)] + [(i, f"rare {i}", f"l{i}") for i in range(300)]
    df = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2], "doc_id bigint, text string, lang string")
    got = [(r["lang"], bytes(r["snippet"])) for r in langid.sample(df, 30).collect()]
    assert len(got) == len(set(got)) and sum(x == "en" for x, _ in got) == 30
    assert {x for x, _ in got} == {r["lang"] for r in df.select("lang").distinct().collect()}


def test_texts_without_letters_are_undetermined(spark):
    net = langid.train([b"the cat and the dog", b"der hund und die katze"] * 20, ["en", "de"] * 20, steps=5)
    df = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2167"), (3, "12 _ 3"), (4, "\u00b5"), (5, "\u4f60")], "doc_id bigint, text string")
    assert {r["doc_id"] for r in langid.predict(df, net).where("lang_pred = 'und' and score = 0").collect()} == {1, 2, 3}


def test_language_edge_cases(spark):
    df = odd(spark, ["lang_pred", "score"]).withColumn("lang", F.lit("en"))
    net = langid.train([b"the cat and the dog", b"der hund und die katze"] * 20, ["en", "de"] * 20, steps=30)
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, net).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= out and (7, "und") not in out
    assert langid.predict(df, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(df.limit(0), net).count() == 0


def test_leaks_of_whole_items_are_found(spark):
    docs, items = read(spark, SF01, "documents"), read(spark, SF01, "benchmark")
    texts = {r["item_id"]: b" ".join(decontaminate.words_of((r["text"] or "").encode())) for r in items.collect()}
    want = set()
    for r in docs.collect():
        words = b" " + b" ".join(decontaminate.words_of((r["text"] or "").encode())) + b" "
        want |= {(r["doc_id"], i) for i, t in texts.items() if t.count(b" ") >= 4 and b" " + t + b" " in words}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_benchmark_decontamination(spark, SF01).collect()}
    assert want and want <= got
    assert len({d for d, _ in got}) < 0.1 * docs.count()  # others are left alone


def changed(rng, words, share):
    """The words with so many of them replaced, left out or followed by another."""
    out = list(words)
    for at in rng.sample(range(len(out)), int(share * len(out))):
        out[at] = rng.choice([rng.choice(PLAIN), "", out[at] + " " + rng.choice(PLAIN)])
    return " ".join(w for w in out if w)


PLAIN = [a + b for a in ("ta", "ri", "mo", "ke", "lu", "so", "ne", "di") for b in ("n", "ra", "s", "mel", "to", "vik", "l", "dor")]


def test_recall_of_paraphrases_by_length_and_rank(spark):
    """Against the verifying rules alone, applied to every document and item, with nothing searched before."""
    rng = random.Random(11)
    own = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(4000)]
    pick = lambda n: [rng.choice(PLAIN) if rng.random() < 0.5 else rng.choice(own) for _ in range(n)]
    lengths = [6, 9, 14, 20, 36, 60, 150, 400, 700]
    items = [(k, " ".join(pick(lengths[k % len(lengths)]))) for k in range(90)]
    docs = [(1000 + k, " ".join(pick(rng.randint(20, 300)))) for k in range(200)]
    docs += [(k, " ".join([*pick(rng.randint(0, 90)), changed(rng, t.split(), (0, 0.1, 0.25)[k % 3]), *pick(rng.randint(0, 90))])) for k, t in items]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for d, t in docs:
        w = decontaminate.words_of(t.encode())
        for q, item in items:
            x = decontaminate.words_of(item.encode())
            n = len(x)
            for s in range(0, max(1, len(w)), max(1, n // 4)):  # places of the length of the item and a quarter
                part = w[s : s + n + n // 2]
                share = decontaminate.lcs_length(x, part) / n
                if share >= decontaminate.LCS_SURE or share >= decontaminate.LCS_LEAST and decontaminate.lcs_length(x[-5:], part) >= 3:
                    want.add((d, q))
    found = {}
    for rank in (256, 32):
        found[rank] = {(r["doc_id"], r["item_id"]) for r in decontaminate.with_hits(df, bench, "h", rank).select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.item_id").collect()}
        print("rank", rank, "found", len(found[rank] & want), "of", len(want), "beyond", len(found[rank] - want), "missed", sorted((d, q, lengths[q % len(lengths)]) for d, q in want - found[rank]))
    planted = {(k, k) for k, _ in items}
    assert len(found[256] & want) >= 0.95 * len(want) and len(want & planted) > 60
    assert len({d for d, _ in found[256] if d >= 1000}) <= 10


def test_paraphrases_and_edge_cases(spark):
    items = [(k, " ".join(f"w{k}a{j}" for j in range(30))) for k in range(12)] + [(50, None), (51, ""), (52, "too few words"), (3, "w3a0 w3a1 w3a2 w3a3 w3a4 w3a5")]
    loose = items[4][1].split()
    loose[5], loose[11], loose[17] = "other", "words", "here"
    docs = [(1, "before " * 60 + items[2][1] + " after" * 70), (2, " ".join(loose)), (3, "nothing of the kind " * 30), (4, None), (5, ""), (6, items[2][1]), (6, items[2][1]), (None, items[7][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, hits string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"]) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(-1, 7), (1, 2), (2, 4), (6, 2), (6, 2)]
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert [r["item_id"] for r in decontaminate.contaminated(spark.createDataFrame([(1, "not too, few Words!")], df.schema[:2]), bench).collect()] == [52]
    odd = spark.createDataFrame([(1, items[2][1], 1, "y")], "doc_id bigint, text string, `a.b` int, hits string")
    more = bench.selectExpr("*", "1 as doc_id", "'x' as `hits`")
    assert decontaminate.remove_contaminated(odd, more).columns == odd.columns and decontaminate.remove_contaminated(odd, more).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == decontaminate.contaminated(df.limit(0), bench).count() == 0
