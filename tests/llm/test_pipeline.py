"""The stages of the corpus pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_dedup, pii
from tests.llm.test_text_operators import brute_groups, brute_hits, brute_replace

DOC = "doc_id long, text string, lang string, source string, n_chars long"
FOREIGN = (
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. ",
    "Wszystkie szczęśliwe rodziny są do siebie podobne, każda nieszczęśliwa rodzina jest nieszczęśliwa na swój sposób. ",
    "Bütün mutlu aileler birbirine benzer, her mutsuz ailenin kendine özgü bir mutsuzluğu vardır. ",
)
SCRIPTS = ((97, 123), (0x430, 0x450), (0x3B1, 0x3C9), (0x4E00, 0x5E00), (0xAC00, 0xB400))


def test_language_stage_rejects_noise(spark):
    r = random.Random(7)
    words = {x: ["".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(60)] for x, parts in {"en": "th ing ed er on ly".split(), "de": "sch ung ein ich heit ge".split(), "fr": "eau aux ment ou qu ai".split(), "es": "ción os as ll ar ue".split()}.items()}
    real = [(k, " ".join(r.choice(words[x]) for _ in range((5, 30, 300)[k % 3])), x, "s", 1) for k, x in enumerate(list(words) * 60)]
    noise = ["".join(" " if r.random() < 0.15 else chr(r.randrange(*SCRIPTS[k % 5])) for _ in range((80, 1500)[k % 2])) for k in range(60)]
    odd = [(1000 + k, x, None, "s", 1) for k, x in enumerate(noise)] + [(2000 + k, x * n, None, "s", 1) for k, x in enumerate(FOREIGN) for n in (1, 8)] + [(3000, "x" * 500, None, "s", 1), (3001, "12 !", "en", "s", 1), (3002, None, "en", "s", 1)]
    out = {x.doc_id: x for x in corpus_pipeline.language(spark, spark.createDataFrame(real + odd, DOC), "").collect()}
    kept = [x for x in real if x[0] in out]
    assert len(kept) >= 0.97 * len(real) and all(out[x[0]].lang == x[2] and out[x[0]].text == x[1] for x in kept)
    assert sum(1000 <= k < 2000 for k in out) <= 2 and not any(k >= 2000 for k in out)


ITEMS = [(k, " ".join(f"item{k}word{j}" for j in range(14))) for k in range(3)]


def corpus():
    """Rows (doc_id, text, lang, source, n_chars): prose of four languages, copies, repeated and missing ids, odd and private texts, benchmark passages."""
    r = random.Random(11)
    words = {x: ["".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(80)] for x, parts in {"en": "th ing ed er on ly".split(), "de": "sch ung ein ich heit ge".split(), "fr": "eau aux ment ou qu ai".split(), "es": "ción os as ll ar ue".split()}.items()}
    prose = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(k, prose(x, (8, 60, 200)[k % 3]), x) for k, x in enumerate(list(words) * 30)]
    rows += [(500 + k, rows[3 * k + 2][1], rows[3 * k + 2][2]) for k in range(10)]  # copies
    for k in range(10):  # near copies
        w = rows[3 * k + 2][1].split()
        w[k] = "changed"
        rows.append((600 + k, " ".join(w), rows[3 * k + 2][2]))
    rows += [(5, prose("en", 70), "en"), (5, prose("de", 70), "de"), (None, prose("fr", 90), "fr"), (None, prose("es", 90), "es"), (None, rows[2][1], rows[2][2])]
    rows += [(700 + k, prose("en", 30) + " " + ITEMS[k % 3][1] + " " + prose("en", 30), "en") for k in range(4)]
    rows += [(800 + k, prose("en", 40) + f" mail ann{k}@mail.org or Mrs. Anna Schmidt{'' if k else ' and Schmidt'}", "en") for k in range(4)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 345 !!", "de"), (903, "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", None)]
    return [(i, t, x, "s", len(t or "")) for i, t, x in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), DOC).withColumn("score", F.lit("clash")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows_of(df):
    return sorted((tuple(x) for x in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_each_stage_accounts_for_every_row(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    start = rows_of(docs)
    spoken = corpus_pipeline.language(spark, docs, tables)
    after_language = rows_of(spoken)
    gone = set(start) - set(after_language)
    assert {x[0] for x in gone} == {900, 901, 902, 903} and len(after_language) == len(start) - 4

    single = corpus_pipeline.near_duplicates(spark, spoken, tables)
    groups = brute_groups([(k, x[1]) for k, x in enumerate(after_language)], 5, 80)
    by = {}
    for k, (_, g) in groups.items():
        by.setdefault(g, []).append(after_language[k])
    kept = rows_of(single)
    assert len(kept) == len(by) and len(kept) < len(after_language)
    for rows in by.values():
        mine = [x for x in rows if x in kept]
        assert len(mine) >= 1 and min((x[0] is None, x[0] or 0) for x in rows) == min((x[0] is None, x[0] or 0) for x in mine)
    assert sum(x[0] == 5 for x in kept) == 3 and sum(x[0] is None for x in kept) == 2

    clean = corpus_pipeline.decontaminated(spark, single, tables)
    assert rows_of(clean) == [x for x in kept if not brute_hits(x[1], ITEMS)[1]] and len(kept) - clean.count() == 4

    private = corpus_pipeline.without_pii(spark, clean, tables)
    found = sorted({(kind, form) for x in rows_of(clean) for _, _, kind, form in pii.detect(x[1])})
    made = pii.Surrogates(pii.demo_key())
    moved = {(m.kind, m.entity): m.surrogate for m in pii.resolve(spark.createDataFrame(found, "kind string, entity string"), pii.demo_key()).collect()}
    texts = brute_replace([x[1] for x in rows_of(clean)], {e: moved.get(e) or made.of(*e) for e in found})
    assert sorted(x[1] for x in rows_of(private)) == sorted(texts) and not any("Schmidt" in t or "@mail.org" in t for t in texts)
    assert all(x[4] == len(x[1]) for x in rows_of(private))

    count = corpus_pipeline.packing.TokenCounter(corpus_pipeline.VOCABULARY, corpus_pipeline.SPLIT)
    packed = corpus_pipeline.packed(spark, private, tables).collect()
    assert sum(x.length for x in packed) == sum(1 + count(x[1]) for x in rows_of(private))

    whole = corpus_pipeline.run(spark, tables).collect()
    shape = lambda rows: sorted((x.doc_id is None, x.doc_id or 0, x.part, x.start, x.length) for x in rows)
    assert shape(whole) == shape(packed)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_recall_of_bands_at_the_limit(spark):
    """Pairs just over the similarity that links, in texts of their own: all are found."""
    r = random.Random(13)
    texts, pairs = [], 0
    while pairs < 150:
        w = [f"w{r.randrange(10**6)}" for _ in range(180)]
        v = list(w)
        for k in r.sample(range(180), 5):
            v[k] = f"x{r.randrange(10**6)}"
        a, b = ({tuple(x[i : i + 3]) for i in range(178)} for x in (w, v))
        if 0.85 <= len(a & b) / len(a | b) <= 0.87:
            texts += [" ".join(w), " ".join(v)]
            pairs += 1
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, shingle=3, percent=85).collect()}
    assert sum(out[2 * k + 1] == 2 * k for k in range(pairs)) == pairs


def test_very_long_near_copies(spark):
    long = [f"w{k}" for k in range(60_000)]
    other = list(long)
    other[7] = "x"
    out = near_dedup.near_duplicates(spark.createDataFrame([(1, " ".join(long)), (2, " ".join(other)), (3, "w " * 90_000)], "doc_id long, text string"), shingle=3, percent=85).collect()
    assert {x.doc_id: (x.component_id, x.n_shingles) for x in out} == {1: (1, 59_998), 2: (1, 59_998), 3: (3, 1)}
