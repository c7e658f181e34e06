"""Operators of the llm folder on small hard cases and against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vouchline.llm import decontaminate, language, mixing, neardup, pii, quality, substrings, tokens, toxicity, urls
from vouchline.llm.common import Words, bits_hold, bits_table, chunks
from vouchline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()] if columns else [tuple(r) for r in df.collect()]


def many(got):
    return collections.Counter(got)


def test_words_of_chunks():
    texts = ["a bb\tc", None, "", "é  x\n", " ", "zz"]
    for limit in (1, 5, 1 << 20):
        found = []
        for _, _, data, offsets in chunks(pa.array([t.encode() if t is not None else None for t in texts], pa.binary()), limit):
            w = Words(data, offsets)
            raw = data.tobytes()
            for i in range(w.texts):
                found.append([raw[w.starts[j] : w.ends[j]].decode() for j in range(w.first_word[i], w.first_word[i + 1])])
        assert found == [WORD.findall(t or "") for t in texts]
    (_, _, data, offsets), = chunks(pa.array([b"same other same"], pa.binary()))
    h = Words(data, offsets).hashes()
    assert h[0] == h[2] != h[1]


def test_components(spark):
    random.seed(5)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = dict(rows(components(spark.createDataFrame(links + [(None, 1), (3, None)], "a long, b long"))))
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_table(spark):
    table = spark.range(1000).select(F.xxhash64("id").alias("h"))
    bits = bits_table(table, "h", 16)
    held = np.array([r.h for r in table.collect()]).view(np.uint64)
    assert bits_hold(bits, held).all()
    assert bits_hold(bits, np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)).mean() < 0.05


# --- near duplicates --------------------------------------------------------------------------------------------------------------

def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(docs, k, percent):
    sets = collections.defaultdict(list)
    for d, t in docs:
        if d is not None:
            sets[d].append(shingles(t, k))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return many((d, len(shingles(t, k)), None if d is None else find(d), d is None or find(d) == d) for d, t in docs)


@pytest.mark.parametrize("k, percent, block", [(3, 85, 256), (5, 80, 3)])
def test_near_duplicates(spark, odd, k, percent, block):
    random.seed(9)
    base = [f"v{random.randrange(5000)}" for _ in range(90)]
    docs = rows(odd, "doc_id", "text")
    for i in range(40):  # a family in which some pairs are near and some are not
        w = list(base)
        for _ in range(random.randrange(6)):
            w[random.randrange(90)] = f"n{random.randrange(9999)}"
        docs.append((300 + i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("x"))
    assert many(rows(neardup.near_duplicates(frame, k=k, percent=percent, block=block))) == brute_groups(docs, k, percent)


def test_only_loose_members_meet_all(spark):
    loose = set(range(0, 60, 12))
    opened = spark.range(60).select(F.lit(7).alias("key"), F.col("id").alias("node"), F.lit(60).alias("n"), F.lit(len(loose)).alias("n_loose"), F.col("id").isin(*loose).alias("loose"))
    blocks = collections.defaultdict(list)
    for r in neardup.in_blocks(opened, 4).collect():
        blocks[r.p, r.q].append((r.node, r.side))
    met = many(tuple(sorted((x, y))) for held in blocks.values() for i, (x, s) in enumerate(held) for y, t in held[i + 1 :] if s == 2 or s != t)
    assert met == {(x, y): 1 for x in range(60) for y in range(x + 1, 60) if x in loose or y in loose}
    assert sum(map(len, blocks.values())) <= 2 * 55 + 5 * (2 + 14)


def test_near_duplicates_of_nothing(nothing):
    assert rows(neardup.near_duplicates(nothing)) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 62, 100, dtype=np.uint64)))
    one = np.array([7], np.uint64)
    s = neardup.signatures(np.concatenate((np.sort(a), np.sort(b), one)), np.array([0, 400, 800, 801]), 150)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.12
    assert len({int(x) >> 48 for x in s[2]}) == 150  # one element takes every slot in a round of its own


# --- repeated windows -------------------------------------------------------------------------------------------------------------

def brute_windows(docs, n):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - n + 1):
                first[tuple(w[i : i + n])] = min(d, first.get(tuple(w[i : i + n]), d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            low = first.get(tuple(w[i : i + n]))
            if low is not None and (d is None or low < d):
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return many(out)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeated_windows(spark, odd, hot):
    random.seed(4)
    docs = rows(odd, "doc_id", "text")
    share = [f"u{i}" for i in range(70)]
    for i in range(25):
        cut = random.randrange(20)
        docs.append((400 + i, " ".join([f"x{random.randrange(50)}" for _ in range(random.randrange(60))] + share[cut : cut + 52] + [f"y{random.randrange(50)}" for _ in range(20)])))
    docs.append((399, " ".join(["zu"] * 300)))
    docs.append((900, " ".join(["zu"] * 200)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(5)
    assert many(rows(substrings.substring_dedup(frame, hot=hot))) == brute_windows(docs, 50)


def test_repeated_windows_of_nothing(nothing):
    assert rows(substrings.substring_dedup(nothing)) == []


# --- token shards -----------------------------------------------------------------------------------------------------------------

def test_token_shards(spark, odd, nothing, monkeypatch):
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    tool = Tokenizer.from_file(path)
    more = spark.createDataFrame([(50, "Don't stop, it's 12 o'clock... <|endoftext|> ﬁn İ naïve e\u0301 \u3000 x"), (-3, "below")], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "size").unionByName(more.withColumn("size", F.lit("x")))
    ids = lambda t: tool.encode(t or "", add_special_tokens=False).ids + [2]
    got = sorted(rows(tokens.token_positions(docs, path)), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in rows(docs, "doc_id")), key=lambda d: (d is not None, d or 0))
    assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert many((d, n, c) for d, _, n, c in got) == many((d, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t in rows(docs, "doc_id", "text"))
    assert rows(tokens.token_positions(nothing, path)) == []


def test_small_word_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    tool = tokens.WordEncoder(tokens.default_vocabulary())
    for text in ("a b c d e f", "g, h. a b", "a b c d e f"):
        assert np.frombuffer(tool.encode(text.encode(), 2), "<u2").tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_perfect_hash_index(tmp_path):
    doc = np.repeat(np.arange(500), 2) * 7 - 100
    nth = np.tile([0, 1], 500)
    h = tokens.key_hash(doc, nth)
    sizes, bits = tokens.build_index(h)
    assert sorted(tokens.find_slots(h, sizes, bits).tolist()) == list(range(1000))
    path = f"{tmp_path}/one.ids"
    tokens.write_shard(path, doc, nth, [np.arange(i % 9, dtype="<u2").tobytes() for i in range(1000)], 2)
    shard = tokens.Shard(path)
    known, first, last = shard.find(doc, nth)
    assert known.all() and [shard.ids(a, b).tolist() for a, b in zip(first, last)] == [list(range(i % 9)) for i in range(1000)]
    assert not shard.find(np.arange(10_000, 12_000), np.zeros(2000, int))[0].any()
    shard.close()


# --- toxicity, language, quality --------------------------------------------------------------------------------------------------

def test_segments_equal_recursive_definition():
    def brute(s, a, b):
        best = (0.0, None)
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > best[0] + 1e-9:
                    best = (total, (i, j + 1))
        if not best[1]:
            return []
        i, j = best[1]
        return brute(s, a, i) + [(i, j, round(best[0], 6))] + brute(s, j, b)

    rng = random.Random(2)
    for _ in range(200):
        s = np.array([rng.choice([-1.0, -1.0, -1.0, 2.37, 0.71, 4.13]) for _ in range(rng.randrange(1, 25))])
        assert [(a, b, round(x, 6)) for a, b, x in toxicity.maximal_segments(s)] == brute(s, 0, len(s))


def test_toxicity(spark, odd, nothing):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["nasty!", "VILE,", "horrid"]) for _ in range(3)]
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (4, 7), (0, 1)], "doc_id long, toxic int")
    model = toxicity.learn(frame.where("doc_id < 400"), marks.where("doc_id < 400 or doc_id is null"))
    out = {r.doc_id: r for r in toxicity.score_texts(frame, model).collect()}
    assert all((out[d].score >= 0.7) == (d % 5 == 0) for d, _ in docs)
    assert all(len(out[d].passages) == (d % 5 == 0) for d, _ in docs)
    text = dict(docs)[500].lower()
    assert all(x in ("nasty!", "vile,", "horrid", "nasty", "vile") for x in text[out[500].passages[0].start : out[500].passages[0].end].split())
    strange = toxicity.score_texts(odd, model)
    assert strange.count() == odd.count() and strange.where("score is null or passages is null or size(passages) > 0").count() == 0
    assert toxicity.score_texts(nothing, model).count() == 0
    blank = toxicity.learn(nothing, marks.limit(0))
    assert toxicity.score_texts(odd, blank).where("score > 0.5 or score is null").count() == 0


def test_language(spark, odd, nothing):
    samples = {"aa": "kalima tuvo senari polu", "bb": "wrixt zorch grumph blenk"}
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(samples[n].split()) for _ in range(30)), n) for i in range(60) for n in samples]
    tools = language.learn_dictionaries(spark.createDataFrame(docs + [(1, None, "aa"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert sorted(tools) == ["aa", "bb"] and all(0 < len(t) <= language.DICTIONARY for t in tools.values())
    frame = spark.createDataFrame([(1, samples["aa"] * 3), (2, samples["bb"] * 3), (3, None), (4, "12 34 !"), (5, samples["aa"] * 9000), (6, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language.classify(frame, tools).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["aa", "bb", "und", "und", "aa", "und"]
    assert [got[i].rejected for i in range(1, 7)] == [False, False, True, True, False, True]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.classify(odd, tools).count() == odd.count() and language.classify(nothing, tools).count() == 0
    assert {r.lang_pred for r in language.classify(frame, {}).collect()} == {"und"}
    assert language.learn_dictionaries(nothing) == {}


def test_every_language_is_learned(spark):
    rng = random.Random(15)
    words = {f"l{n:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for n in range(150)}
    docs = [(i, " ".join(rng.choice(w) for _ in range(40)), n) for n, w in words.items() for i in range(2 if n > "l100" else 1)]
    tools = language.learn_dictionaries(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(tools) == sorted(words) and len(tools) > language.GROUP
    frame = spark.createDataFrame([(" ".join(w * 2), n) for n, w in words.items()], "text string, lang string")
    assert language.classify(frame, tools).where("lang_pred <> lang or rejected").count() == 0


def test_quality_counts(spark, odd, nothing):
    texts = ["a b c d e f a b c d e g", "x\nx\n\n \nx y\nx y", "#$ é*é", "aaa " * 20]
    docs = rows(odd, "doc_id", "text") + [(700 + i, t) for i, t in enumerate(texts)]
    want = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("x"))
    assert many(rows(quality.measure(frame, "doc_id"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == many(want)
    assert quality.measure(nothing, "doc_id").count() == 0
    assert quality.choose_cutoffs(quality.measure(nothing, "doc_id"), spark.createDataFrame([], "doc_id long, quality int")) == []


def test_exact_bound():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    k, n, p = 7, 300, quality.upper_bound(7, 300, 0.01)
    from math import comb
    assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(0.01, rel=1e-6)


def test_cutoffs_spare_good_texts(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(9999)}" + ("##" if i % 4 == 0 else "") for _ in range(80)), int(i % 4 != 0)) for i in range(4000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    counted = quality.measure(frame, "doc_id")
    rules = quality.choose_cutoffs(counted, frame.select("doc_id", "quality"), alpha=0.05)
    assert {(r["stratum"], r["feature"]) for r in rules} >= {(1, "symbol_share")}
    kept = dict(rows(counted.select("doc_id", quality.verdict(rules).alias("k"))))
    assert not any(kept[i] for i, _, q in docs if not q)
    assert sum(not kept[i] for i, _, q in docs if q) <= 0.05 * 3000


# --- decontamination --------------------------------------------------------------------------------------------------------------

def test_leaks(spark, odd, nothing):
    item = "Well Tom has 12 apples and he gives 5 apples to Anna before lunch how many apples are left for Tom"
    docs = [
        (1, "x y " + item + " z"), (2, "then Bob has 30 apples and he gives 7 apples to Eve before lunch how many apples are left for Bob ok"),
        (3, "then Bob has 30 apples and he gives 7 apples to Eve"), (4, item.upper()), (5, None), (None, item), (6, "tiny words only"), (7, ""),
        (8, "he said Bob has 30 apples and Bob has 4 pears"),
    ]
    bench = spark.createDataFrame([(1, item), (2, "tiny words only"), (3, None), (4, ""), (5, "a")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x"))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (6, 2)} | ({(4, 1)} if (4, 1) in got else set())
    assert got[2, 1].n_slots >= 4
    whole = decontaminate._stretch([0, 1], [0, 1], [[1, 0], [0, 1]], [[10, 1], [1, 11]], [[5, 1], [1, 5]])
    assert whole[0] == 2  # 5 stood for 10 first: the second window starts anew
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_leaks_of_exact_copies(spark):
    heavy = "On 3 May 1999 Anna Berg and Tom Hill paid 12 euros 30 cents for 4 kg apples 7 kg pears 2 l milk"
    items = [(1, "Compute 12 times 7"), (2, "What is 345 + 678?"), (3, heavy), (4, "Berlin lies on which long river"), (5, "12 13"), (6, "Rivers cross the town near which old bridge")]
    docs = [(i, f"some words before, {t} and some after") for i, t in items] + [(14, "then Paris lies on which long river"), (16, "he said Anna cross the town near which old bridge"), (20, "Compute 13 times 7, what is 345 + 677, 12 of 13")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(1, 7)} | {(14, 4), (16, 6)}


def test_leaks_in_other_case_and_of_other_word_counts(spark):
    item = "Well Tom has 12 apples and he gives 5 apples to Anna before lunch how many apples are left for Tom"
    greek = "Ο μικρός Τομ έχει δώδεκα μήλα και πέντε αχλάδια στο σπίτι του"
    docs = [
        (1, item.upper()), (2, item.lower()), (3, item.upper().replace("12", "30").replace("5", "7") + " OK"), (4, greek.upper().replace("Ό", "Ο")),
        (5, "then Mary Ann Smith has 2 500 apples and he gives 7 apples to Eve Jones before lunch how many apples are left for Mary Ann Smith"),
        (6, "WELL TOM HAS 12 PEARS AND HE TAKES 5 PEARS FROM ANNA"),
    ]
    bench = spark.createDataFrame([(1, item), (2, greek)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 1)}
    texts = ["Éa ÀÖ×ß Ωσς ЖЁя Ạẞ İi 語 x", "", "é", "Ё"]
    assert decontaminate.lower(np.frombuffer("".join(texts).encode(), np.uint8)).tobytes().decode() == "éa àö×ß ωσσ жёя ạẞ İi 語 xéё"


def test_leaks_equal_plain_windows(spark):
    """Brute force over texts without numbers, names and units, where all forms are one; with them, nothing plain is missed."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice('bcd')}{rng.choice('aeo')}{rng.choice('xyz')}{rng.choice('aeo')}"
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())

    def longest(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    for numbers in (False, True):
        items = [(i, " ".join(str(rng.randrange(50)) if numbers and rng.random() < 0.5 else word() for _ in range(rng.randrange(2, 30)))) for i in range(40)]
        docs = []
        for d in range(150):
            w = rng.choice(items)[1].split()
            cut = rng.randrange(len(w))
            text = " ".join([word() for _ in range(rng.randrange(9))] + w[cut // 2 : cut // 2 + rng.randrange(1, 30)] + [word() for _ in range(rng.randrange(9))])
            docs.append((d, rng.choice([str.upper, str.lower, str.title if numbers else str.lower])(text)))
        want = set()
        for d, t in docs:
            for i, x in items:
                n, size = longest(plain(t), plain(x)), len(plain(x))
                if n >= min(decontaminate.WINDOW, size) and (n >= decontaminate.RUN or n >= decontaminate.SHARE * size):
                    want.add((d, i))
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert len(want) > 50 and (want <= got if numbers else got == want)


# --- mixing, urls, personal data --------------------------------------------------------------------------------------------------

def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(3)
    for sizes in ({"a": 100, "b": 5, "c": 5, None: 1}, {"a": 0, "b": 0}, {chr(97 + i): rng.randrange(1000) for i in range(12)}):
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight, target, fixed = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, {}
        while True:
            open_ = [s for s in names if s not in fixed]
            rest = sum(sizes.values()) - sum(fixed.values())
            target = {**fixed, **{s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}}
            over = [s for s in open_ if target[s] > 3 * sizes[s]]
            if not over:
                break
            fixed |= {s: 3 * sizes[s] for s in over}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(target)


def test_mix(spark, odd, nothing):
    out = mixing.mix(odd)
    assert out.count() == odd.count() and set(out.columns) == (set(odd.columns) | set(mixing.ADDED)) - {"h", "s"}
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert all(r.size == len(r.text.split()) and r.taken in [r.size * n for n in range(4)] for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    again = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)).collect()
    assert many((r.doc_id, r.taken) for r in got) == many((r.doc_id, r.taken) for r in again)
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("bits", [1 << 23, 1])
def test_url_cascade(spark, monkeypatch, bits):
    monkeypatch.setattr(urls, "MAX_BITS", bits)
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)  # many false hits, so several levels
    pages = [(i, f"https://s{i}.example.info/p?q") for i in range(400)] + [
        (1000, None), (1001, "no scheme"), (1002, "HTTP://X.Example.NET/en/a#b"), (1003, "http://org/fr/"), (1004, "http://a.net"), (1005, "http://a.net/x"), (1006, "x://example.com/de/?a"), (1007, "http://bexample.com/de/")]
    listed = spark.createDataFrame([(f"s{i}.example.info",) for i in range(0, 400, 3)] + [("else.where",)], "key string")
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(5))
    got = {r.page_id: r for r in urls.judge(frame, listed).collect()}
    assert all(got[i].verdict == ("block" if i % 3 == 0 else "allow") for i in range(400))
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1000, 1008)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("x.example.net", "/en/a", "example.net/en/", "allow"), ("org", "/fr/", "org/fr/", "allow"),
        ("a.net", "", None, "allow"), ("a.net", "/x", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block"), ("bexample.com", "/de/", None, "allow")]
    assert urls.judge(frame.limit(0), listed).count() == 0 and urls.judge(frame, listed.limit(0)).where("verdict = 'block'").count() == 2
    if bits > 1:
        keys = frame.select(urls.site_of_url().alias("key")).distinct().join(listed.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
        assert len(urls.cascade(keys)) > 2


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return {"email": True, "ip": all(int(x or 0) <= 255 for x in value.split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_personal_data(spark, odd, nothing):
    rng = random.Random(3)
    letters = "a1@.+- 0123459()é😀_x.%A\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["1" * 50_000, "a" * 50_000 + "@b.c", "+" + "1 " * 20_000, "1.2.3.4.5.6.7.8 a@b.co_x@d.e.f@g.h 000000001.2.3.255", None, "", "4111 1111 1111 1111 4111-1111-1111-1112"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("email", F.lit("x")).repartition(8)
    got = dict(rows(pii.find_spans(frame).select("doc_id", pii.listing(*pii.BASE))))
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if holds(k, m[0])), i
    more = spark.createDataFrame([(1, "account GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32, call 415-555-1234"), (2, "see 415-555-1234 x")], "doc_id long, text string")
    assert dict(rows(pii.find_spans(more).select("doc_id", pii.listing(*pii.KINDS)))) == {1: "iban:8:35,national_phone:71:83", 2: ""}
    assert pii.find_spans(odd).count() == odd.count() and pii.find_spans(nothing).count() == 0
    assert rows(pii.masked(spark.createDataFrame([(1, "é mail a@b.co or 4111 1111 1111 1111."), (2, None)], "doc_id long, text string")), "text") == [("é mail [email] or [card].",), ("",)]


def test_base_hash_is_of_the_listing(spark):
    r = pii.find_spans(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sha2(pii.listing(*pii.BASE), 256)).first()[0]
    assert r == hashlib.sha256(b"").hexdigest()
