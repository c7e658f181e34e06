"""Phrases, spelling variants and shared lines on hard cases and against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from vouchline.llm import lines, phrases, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- phrases ----------------------------------------------------------------------------------------------------------------------

def brute_phrases(docs, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(len(q) > len(p) and lang == other and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for (other, q), b in found.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, got in out.items() for i, (s, a, p, l, r) in enumerate(sorted(got)[:top], 1))


@pytest.fixture(scope="module")
def talk():
    random.seed(11)
    words = "the of and New York city bank Straße été a\x00b x1   end ab a".split(" ")
    out = []
    for i in range(120):
        text = "".join(random.choice(words) + random.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for _ in range(random.randrange(60)))
        out.append((i, text + " new york city " * (i % 3), random.choice(["en", "de", None, "und"])))
    return out + [(None, None, "en"), (500, "", None), (501, " \t.,\n", "en"), (1, "same row twice " * 12, "en"), (1, "same row twice " * 12, "en")]


@pytest.mark.parametrize("top,most,keys", [(2000, 1 << 21, 1 << 22), (7, 60, 200)])
def test_phrases(spark, talk, top, most, keys):
    docs = spark.createDataFrame(talk, "doc_id long, text string, lang string").repartition(5)
    want = brute_phrases(talk, 4, top)
    assert sorted(rows(phrases.collocations(docs, 4, top, most, keys))) == want and len(want) > 20


def test_phrases_of_odd_rows(spark, odd, nothing):
    docs = [(r.doc_id, r.text, r.lang) for r in odd.select("doc_id", "text", "lang").collect()]
    assert sorted(rows(phrases.collocations(odd))) == brute_phrases(docs, 10, 2000) != []
    got = phrases.collocations(nothing)
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_trie_finds_each_row_and_nothing_else():
    random.seed(3)
    rng = np.random.default_rng(3)
    kinds = [rng.integers(0, 256, (5000, 4)), np.stack([np.zeros(700, int), np.arange(700) % 256, np.arange(700) // 256], 1), np.zeros((1, 2), int), np.zeros((0, 3), int)]
    for kind in kinds:
        table = np.unique(kind.astype(np.uint8), axis=0)
        trie = phrases.Trie(table)
        known = {tuple(r): i for i, r in enumerate(table.tolist())}
        asked = [tuple(r) for r in table.tolist()] + [tuple(random.randrange(256) for _ in range(table.shape[1])) for _ in range(2000)]
        for word in asked:
            states = np.zeros(1, np.int64)
            for b in word:
                alive, states = trie.walk(states, np.array([b], np.int32), 1)
                if not len(alive):
                    break
            assert (int(-1 - trie.base[states[0]]) if len(states) else None) == known.get(word)


def test_trie_of_phrases_is_small_and_exact():
    """A phrase ends where no other one shares its bytes; what is left of it is compared, also where a text goes on otherwise."""
    rng = np.random.default_rng(5)
    for length, width in ((2, 3), (3, 3), (3, 1), (2, 1)):
        top = min(300_000, 1 << (8 * width - 1))
        words = np.minimum(rng.zipf(1.3, (60_000, length)), top).astype(np.int64) - 1
        words = np.unique(words, axis=0)
        trie = phrases.PhraseTrie(words[:, 0] << 32 | words[:, 1], words[:, 2].astype(np.int32) if length == 3 else None, width)
        codes = np.minimum(rng.zipf(1.3, 60_000), top).astype(np.int32) - 1
        codes[rng.integers(0, len(codes), 5_000)] = -1
        planted = words[:10_000].astype(np.int32).ravel()
        codes[10_000 : 10_000 + len(planted)] = planted
        number = {tuple(w): i for i, w in enumerate(words.tolist())}
        text = codes.tolist()
        want = [(i, number[tuple(text[i : i + length])]) for i in range(len(text) - length + 1) if tuple(text[i : i + length]) in number]
        at, found = trie.find(codes)
        assert sorted(zip(at.tolist(), found.tolist())) == want and want
        size = trie.trie.base.nbytes + trie.trie.check.nbytes
        assert width == 1 or size < 45 * len(words)  # all nodes of all phrases would need more
    assert phrases.PhraseTrie(np.zeros(0, np.int64), None, 2).find(codes)[0].tolist() == []


def test_pages_of_large_rows_do_not_grow_with_the_rows(spark):
    """Ninety rows of 0.4 MB: all in one page if sizes are looked at every hundred rows."""
    from pyspark.sql import functions as F

    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(13_000)), lambda i: F.sha2(F.concat_ws(" ", "id", i), 256)), ""))
    wide = spark.range(0, 90, 1, 1).select(F.lit(1).cast("long").alias("chunk"), noise.alias("codes"))
    [name] = phrases.written(wide, "large-rows", **phrases.LARGE_ROWS).inputFiles()
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(name.removeprefix("file://")).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 1.2 * phrases.LARGE_ROWS["parquet.block.size"]


def test_scores_are_exact(spark):
    a, l, r = 999_999_999_999_999, 999_999_999_999_997, 999_999_999_999_998
    got = spark.range(1).selectExpr(f"{a}L a", f"{l}L l", f"{r}L r").selectExpr(phrases._score("l", "r")).first()[0]
    assert got == 1000000 * a * a // (l * r)


# --- spelling variants ------------------------------------------------------------------------------------------------------------

def brute_words(docs, slip=199):
    count = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_groups(words, ratio=5):
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, near_ in links.items():
        best = min(near_, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(links[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def test_words(spark, odd, nothing):
    random.seed(4)
    alphabet = "abcXYZéÀÿ×÷"
    docs = [(i if i % 7 else None, " ".join("".join(random.choice(alphabet) for _ in range(random.choice([1, 6, 7, 8, 70]))) for _ in range(5)) + random.choice([" ", "1", "ß", "ſ", "Ā"]) + "Straßen-ÄRGER日本語naïveté " * 7) for i in range(300)]
    docs += [(1, "letter" * 40)] * 7 + [(2, None), (None, ""), (3, "x" * 5000 + "y")] + [(j, "a" * 3000) for j in range(6)]
    for slip in (199, 3):
        got = dict(rows(spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string"), slip=slip)))
        assert got == brute_words(docs, slip) and len(got) > 3
    assert dict(rows(spelling.count_words(odd))) == brute_words([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert spelling.count_words(nothing).count() == 0


def test_groups(spark):
    random.seed(6)
    words = {}
    for _ in range(60):
        w = "".join(random.choice("abcé") for _ in range(random.choice([6, 6, 7, 8, 11])))
        words[w] = random.randrange(5, 5000)
        for _ in range(6):
            i, kind = random.randrange(len(w) + 1), random.randrange(3)
            v = w[:i] + random.choice("abcéz") * (kind != 2) + w[i + (kind != 0) :]
            if len(v) >= 6:
                words.setdefault(v, random.randrange(5, 400))
    for w in ("aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "x" * 400 + "y" * 400, "x" * 401 + "y" * 400, "x" * 400 + "z" + "y" * 399, "q" * 300 + "a", "q" * 300 + "b", "q" * 300):
        words.setdefault(w, random.choice([7, 70, 700]))
    # the same both ways, and each other's reverse
    words |= {"abccba": 60, "abcdcba": 9, "abcxcba": 9, "elleelle": 8, "elleelleé": 50, "éelleelle": 51, "éreieré": 7, "éreierée": 600}
    # chains of forms, and ties between forms
    words |= {"chains": 10_000, "chainsa": 1000, "chainsab": 100, "chainsabc": 10, "tiebreax": 500, "tiebreay": 500, "tiebreaz": 7}
    steps = spelling.trie_steps(spelling._keys(spark.createDataFrame(list(words.items()), "word string, n long").select("word")))
    assert spelling.trie_edges(steps).where("label = '' or parent = child").count() == 0
    got = spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(rows(got.select("word", "n", "n_near", "form", "form_n", "root"))) == brute_groups(words)
    assert rows(got.where("word = 'chainsabc'").select("root")) == [("chains",)] and rows(got.where("word = 'tiebreaz'").select("form")) == [("tiebreax",)]


def test_groups_without_words(spark):
    got = spelling.spelling_groups(spark.createDataFrame([], "word string, n long"))
    assert got.count() == 0
    alone = spelling.spelling_groups(spark.createDataFrame([("lonely", 9)], "word string, n long"))
    assert rows(alone.select("word", "n", "n_near", "form", "form_n", "root")) == [("lonely", 9, 0, None, None, "lonely")]


# --- shared lines -----------------------------------------------------------------------------------------------------------------

def brute_lines(docs, least_chars=40, least_docs=5):
    strip = " \t\n\x0b\x0c\r"
    low = -1 << 62
    holders = collections.defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            holders[line.strip(strip).translate(LOWER)].add(low if doc_id is None else doc_id)
    out = []
    for doc_id, text in docs:
        all_ = (text or "").split("\n")
        key = [x.strip(strip).translate(LOWER) for x in all_]
        stay = [x for x, k in zip(all_, key) if not (len(k) >= least_chars and len(holders[k]) >= least_docs and max(holders[k]) != (low if doc_id is None else doc_id))]
        out.append((doc_id, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def pages():
    random.seed(8)
    shared = [f"Shared line number {i} that many pages have at their foot, é" for i in range(12)] + ["short line", "x" * 40, "X" * 40, "y" * 39, " " + "z" * 39]
    out = []
    for i in range(90):
        body = [random.choice([random.choice(shared), f"own line {i} " * 5, "", "  "]) for _ in range(random.randrange(12))]
        body = [random.choice(["", " ", "\t"]) + x + random.choice(["", " ", "\r"]) for x in body]
        out.append((random.choice([i, i, i, 7, None]), "\n".join(body)))
    return out + [(300, None), (301, ""), (302, "\n\n"), (400, "\n".join(["only here but very often in one document indeed"] * 3000))] + [(500, shared[0])] * 2 + [(None, shared[0])] * 3


@pytest.mark.parametrize("batches,fan", [(4, 2), (1, 2), (7, 3)])
def test_lines(spark, pages, batches, fan):
    docs = spark.createDataFrame(pages, "doc_id long, text string").repartition(3)
    got = collections.Counter(rows(lines.line_dedup(docs, batches=batches, fan=fan)))
    assert got == brute_lines(pages)
    assert sum(r[2] for r in got) > 50


def test_lines_of_odd_rows(odd, nothing):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert collections.Counter(rows(lines.line_dedup(odd, 20, 2))) == brute_lines(docs, 20, 2)
    got = lines.line_dedup(nothing)
    assert got.count() == 0 and got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]


def test_each_line_is_in_one_run(spark):
    """Runs are merged level by level, and a hash met again is only counted."""
    runs = lines.LineRuns(spark, fan=2, buckets=3)
    for batch in range(7):
        ids = range(100 - 10 * batch, 90 - 10 * batch, -1)
        runs.add(spark.createDataFrame([(i, k, -k) for i in ids for k in (1, 1, 2 if i % 2 else 3, 1000 + i)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    held = [r.h1 for name in runs.runs() for r in spark.table(name).collect()]
    assert len(held) == len(set(held)) == 3 + 70
    assert {r.h1: (r.top, r.docs) for r in runs.counted().collect()} == {1: (100, 70), 2: (99, 35), 3: (100, 35)}
    plan = runs.spark.table(runs.runs()[0]).join(runs.spark.table(runs.runs()[1]).hint("merge"), lines.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    runs.close()
