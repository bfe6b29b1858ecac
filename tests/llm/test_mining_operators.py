"""Collocations, whitening, the Jaccard join: against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_text_operators import docs
from tidemark.llm import collocations, jaccard_join, near_dedup, whitening, word_arrays

# collocations


def brute_phrases(rows, support, top):
    """rows (lang, text) -> lang, rank, phrase, a, l, r, n, score."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[k : k + size])) for size in range(1, 6) for k in range(len(words) - size + 1))
    frequent = {k: v for k, v in f.items() if v >= support}
    inside = {(lang, p[a:b]) for (lang, p), v in frequent.items() for a, b in itertools.combinations(range(len(p) + 1), 2) if b - a < len(p) and v >= f[lang, p[a:b]]}
    out = []
    for lang in n:
        found = []
        for (own, p), a in frequent.items():
            if own == lang and len(p) > 1 and (lang, p) not in inside:
                cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "top", "held"), [(1 << 16, 1 << 27, 2000, 100_000), (64, 64, 7, 3)])  # with room, and with crowded buckets and small parts
def test_collocations_against_brute_force(spark, monkeypatch, least, most, top, held):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "WAITING", collocations.WAITING if held > 3 else 10)
    r = random.Random(3)
    words = "alpha Beta gamma délta ΣΊΓΜΑ the of to . , ; new york city new york x y Ünder".split(" ")
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 120))) for _ in range(60)]
    texts = [x.replace(" new ", " New York City hall ") for x in texts] + [None, "", " \t\n", ".", "the the the the the the the the the", "new\tyork", "new\x1cyork", "a" * 300_000, "the " * 3_000]
    langs = [("en", "de", None, "und")[k % 4] for k in range(len(texts))]
    rows = list(zip(langs, texts, strict=True))
    df = spark.createDataFrame([(k, t, x, "s", 0, "clash", "clash") for k, (x, t) in enumerate(rows)], docs(spark, []).schema).repartition(3)
    got = collocations.mine(df, support=12, top=top, least_buckets=least, most_buckets=most).collect()
    want = brute_phrases(rows, 12, top)
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == want
    assert len(want) > 10 and {len(x[2].split(" ")) for x in want} >= {2, 4, 5}


def test_counts_of_a_pass_are_sent_packed(spark):
    """Rows that a task sends don't grow with its phrases, and what it sends adds up to each phrase's count."""
    texts = [" ".join(f"a{i} b{j}." for j in range(60)) for i in range(60)] * 2
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    made = collocations.counting_pass(rows, 2, 0, 100)
    assert made.count() <= collocations.FILED
    assert sorted((x.phrase, x.f) for x in collocations.summed(made, 2).collect()) == sorted((f"a{i} b{j}", 2) for i in range(60) for j in range(60))
    assert collocations.summed(made, 3).count() == 0


def test_collocations_of_nothing(spark):
    assert collocations.mine(docs(spark, [])).count() == 0 and collocations.mine(docs(spark, ["a b", None])).count() == 0
    assert collocations.mine(docs(spark, ["a b. c"] * 100)).select("phrase", "a", "l", "r", "n", "score").collect() == [("a b", 100, 100, 100, 300, 3000)]
    assert collocations.mine(docs(spark, ["a b c. a b"] * 100), longest=2).select("phrase", "a", "l", "r", "n").orderBy("phrase").collect() == [("a b", 200, 200, 200, 500), ("b c", 100, 200, 100, 500)]


def test_large_counts_stay_exact(spark):
    frequent = spark.createDataFrame([("en", "a b", 2, 3_000_000_000), ("en", "a", 1, 3_000_000_001), ("en", "b", 1, 3_000_000_007)], "lang string, phrase string, k int, f long")
    got = collocations.scored(frequent, spark.createDataFrame([("en", 70_000_000_000_000)], "lang string, n long")).first()
    assert got.score == 1000 * 3_000_000_000 * 70_000_000_000_000 // (3_000_000_001 * 3_000_000_007)


# whitening

VECTORS = "vec_id string, embedding array<float>, label int, n string, x string, component string"


def whitened(spark, vectors, **how):
    rows = [(f"v{k}", v, 0, "clash", "clash", "clash") for k, v in enumerate(vectors)]
    return whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3), **how).collect()


@pytest.mark.parametrize(("tile", "block"), [(32, 8192), (3, 7)])
def test_whitening_against_numpy(spark, tile, block):
    r = np.random.default_rng(5)
    base = (r.normal(size=(150, 10)) * np.array([3, 2, 1.5, 1, 0.5, 0.5, 0.4, 0.3, 0.2, 0.1])) @ r.normal(size=(10, 10))
    vectors = [list(map(float, np.float32(x))) for x in base]
    vectors += [vectors[3]] * 40 + [[-0.0] * 10, [0.0] * 10, None, [None] + [1.0] * 9, [float("nan")] * 10, [float("inf")] + [0.0] * 9]
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors[:-4]]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), np.array(fit).sum(axis=0)
    cov = np.cov(np.array(fit, float).T, bias=True)
    values, directions = (a[..., ::-1] for a in np.linalg.eigh(cov))
    got = {(y.vec_id, y.component): y for y in whitened(spark, vectors, tile=tile, rows=block)}
    assert set(got) == {(f"v{k}", c) for k in range(len(x)) for c in range(1, 5)}
    for c in range(1, 5):
        want = (np.array(x) - s / n) @ directions[:, c - 1] / np.sqrt(values[c - 1])
        have = np.array([got[f"v{k}", c].whitened for k in range(len(x))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
    for (name, c), y in got.items():
        row = x[int(name[1:])]
        assert y.n == n and y.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))
        assert y.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9) and y.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitened(spark, []) == [] and whitened(spark, [None, [None]]) == [] and whitened(spark, [[]]) == []
    one = whitened(spark, [[1.0, 2.0], [1.0, 2.0]])
    assert len(one) == 4 and all(y.n == 1 and y.whitened is None and y.explained == 0 and y.identity_error == 0 and y.deviation == 0 for y in one)
    line = whitened(spark, [[0.0], [1.0, 0.0, 0.0], [2.0]])  # shorter ones are filled with zeros
    assert [y.component for y in line if y.vec_id == "v0"] == [1, 2, 3] and {y.whitened for y in line if y.component > 1} == {None}
    assert sorted(abs(round(y.whitened, 6)) for y in line if y.component == 1) == [0, 1.224745, 1.224745]
    huge = whitened(spark, [[1e12, 0.0], [-1e12, 1.0], [0.0, 2.0]])  # beyond 64 bits
    assert {y.vec_id: int(y.deviation) for y in huge}["v0"] == (3 * 256 * int(np.float32(1e12))) ** 2 + 768**2
    assert whitened(spark, [[1e30], [-1e30]])[0].deviation is None  # beyond 38 digits


# Jaccard join


def test_word_arrays_cut_as_bytes_do():
    import pyarrow as pa

    r = random.Random(2)
    texts = [None, "", " ", "a", "A a\x0b\x0cB", "é É x", "x" * 5000] + ["".join(r.choice("aAbB \t\n\rßé\x1c") for _ in range(r.randrange(60))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(["skip", *texts])[1:], pa.array(texts, pa.large_string())):
        w = word_arrays.words(column)
        want = [(t or "").encode().lower().split() for t in texts]
        assert np.diff(w.rows).tolist() == list(map(len, want))
        flat = [x for xs in want for x in xs]
        assert [w.text[a:b].tobytes().lower() for a, b in zip(w.start, w.end, strict=True)] == flat
        assert len(set(w.number.tolist())) == len(set(flat)) == len(set(zip(w.number.tolist(), flat, strict=True)))
        for t, s in zip(want, word_arrays.shingle_sets(column, 3), strict=True):
            assert len(s) == len({tuple(t[k : k + 3]) for k in range(max(1, len(t) - 2))} if t else ())


def brute_similar(texts, ids, size=5, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(texts)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) or ids[a] is not None and ids[a] == ids[b] and sets[a] and sets[b]:
            up[top(a)] = top(b)
    group = {}
    for k, i in enumerate(ids):
        if i is not None:
            group.setdefault(top(k), []).append(i)
    return sorted((str(i), len(s), str(min(group.get(top(k), [None]), default=None)) if sets[k] else str(i)) for k, (i, s) in enumerate(zip(ids, sets, strict=True)))


def near_texts(r):
    passage = " ".join(f"pass{k}" for k in range(60))
    prose = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    texts = [None, "", "one two", "One  two", "one two three four five", "one two three four five six"]
    for k in range(25):
        base = prose(r.randrange(5, 150)).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            changed = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 12))):
                changed[r.randrange(len(changed))] = f"new{r.randrange(9)}"
            texts.append(" ".join(changed) if r.random() < 0.7 else " ".join(changed + [f"tail{r.randrange(5)}"] * 3))
    texts += [passage + " " + prose(8) for _ in range(25)] + [passage + f" end{k}" for k in range(30)] + [passage] * 9
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 3])
def test_jaccard_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 3: most lists are cut into blocks
    if block == 3:
        monkeypatch.setattr(jaccard_join, "HUBS", 1)
        monkeypatch.setattr(jaccard_join, "SHORT", 2)
    for seed in (1, 2):
        texts = near_texts(random.Random(seed))
        ids = list(range(len(texts)))
        random.Random(9).shuffle(ids)
        found = jaccard_join.similar_documents(docs(spark, texts, ids).repartition(4)).collect()
        assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in found) == brute_similar(texts, ids)


def test_members_of_groups_whose_leaders_are_not_linked(spark, monkeypatch):
    """Two groups with the same rare words each: only members that aren't their leaders are linked."""
    common = [f"c{k}" for k in range(400)]
    rare = lambda k, n: [f"r{k}x{j}" for j in range(n)]
    texts = []
    for k in range(12):  # frequent passages, so that they stand behind the rare words in the order
        texts += [" ".join(common[a : a + 60] + rare(f"{k}y{a}", 40)) for a in range(0, 400, 50)]
    one, two = rare("p", 40), rare("p", 36) + rare("q", 4)
    for tail in (common[:60], common[60:120]):
        texts += [" ".join(one + tail), " ".join(two + tail)]
    texts += [" ".join(one + common[:60][::-1])]
    found = jaccard_join.similar_documents(docs(spark, texts)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in found) == brute_similar(texts, list(range(len(texts))))


def test_copies_with_many_own_words_do_not_meet_a_large_group(spark, monkeypatch):
    """Copies too far from all others keep the original's lists open, but can't share their first shingle there."""
    r, base = random.Random(3), [f"w{k}" for k in range(150)]

    def copy(k, n):
        at = set(r.sample(range(8, 142, 6), n))
        return " ".join(f"own{k}x{j}" if j in at else w for j, w in enumerate(base))

    texts = [" ".join(base)] + [copy(k, 1) for k in range(60)] + [copy(k, 4) for k in range(60, 120)]
    kept, durable = {}, jaccard_join.durable

    def counting(df, name, *path):
        found = durable(df, name, *path)
        kept[name] = found.count()
        return found

    monkeypatch.setattr(jaccard_join, "durable", counting)
    found = jaccard_join.similar_documents(docs(spark, texts).repartition(3)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in found) == brute_similar(texts, list(range(len(texts))))
    assert len({x.component_id for x in found}) == 61 and kept["entries"] > 500 and kept["open"] == kept["open_pairs"] == 0


def test_jaccard_join_starts_no_job_for_each_partition(spark):
    """With partitions that aren't coalesced, what comes to the driver takes one job a table, and components end where the edges are stars."""
    held = {"spark.sql.shuffle.partitions": "70", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker, group = spark.sparkContext.statusTracker(), "jaccard-jobs"
    texts = near_texts(random.Random(5))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, "")
        found = jaccard_join.similar_documents(docs(spark, texts).repartition(4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(k, None)
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in found) == brute_similar(texts, list(range(len(texts))))
    assert 0 < len(tracker.getJobIdsForGroup(group)) < 200


@pytest.mark.parametrize("keys", [jaccard_join.KEYS, 8])
def test_bits_mark_what_stands_in_several_tasks_or_twice_in_one(spark, monkeypatch, keys):
    monkeypatch.setattr(jaccard_join, "KEYS", keys)  # 8: many parts
    r = random.Random(6)
    value = lambda: r.randrange(-(1 << 63), 1 << 63)
    once, twice = [value() for _ in range(4000)], [value() for _ in range(300)]
    rows = [[x] for x in once] + [[x, x] for x in twice[:100]] + [[x] for x in twice[100:]] * 2
    r.shuffle(rows)
    df = spark.createDataFrame([(x,) for x in [*rows, None, []]], "keys array<long>").repartition(5)
    for least, wanted in ((1, once + twice), (2, twice)):
        table = jaccard_join.bit_table(df, least)
        assert len(jaccard_join.marked(table, np.array(wanted, np.int64))) == len(wanted)
        assert len(jaccard_join.marked(table, np.array([value() for _ in range(4000)], np.int64))) < 40
    assert len(jaccard_join.marked(table, np.array(once, np.int64))) < 40 and (len(table) > 100) == (keys == 8)
    assert jaccard_join.bit_table(df.where("keys is null"), 2).sum() == 0


def test_jaccard_join_with_text_ids_repeats_and_nulls(spark):
    texts = near_texts(random.Random(4))[:60] + ["same text of some words here"] * 3 + [None, "", "unique words stand here now"]
    ids = [f"d{k % 50:02d}" for k in range(60)] + [None, "d07", "zz", "n1", "n2", None]
    df = spark.createDataFrame(list(zip(ids, texts, ["c"] * len(ids), strict=True)), "doc_id string, text string, rep string")
    found = jaccard_join.similar_documents(df.repartition(3)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in found) == brute_similar(texts, ids)
    assert jaccard_join.similar_documents(docs(spark, [])).count() == 0 and jaccard_join.similar_documents(docs(spark, [None, ""])).count() == 2


def test_the_rest_of_a_hot_bucket_is_compared_by_sizes(spark, monkeypatch):
    """Sets of many sizes under one key and without links between most: all links are found, and no block is larger than its bound."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(6)
    sets = [np.unique(np.array([r.randrange(1 << 40) for _ in range(r.randrange(10, 200))], np.uint64)) for _ in range(120)]
    sets += [np.unique(np.append(s[: int(len(s) * 0.9)], np.array([7, 8], np.uint64))) for s in sets[:40]]
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)}
    part = spark.createDataFrame([(1, k, len(s), k) for k, s in enumerate(sets)], "key long, rep long, size long, component long")
    held = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "rep long, shingles binary")
    got = {tuple(sorted((x.u, x.v))) for x in near_dedup.compare_rest(part, held, 80).collect()}
    assert got == want and len(want) >= 30
