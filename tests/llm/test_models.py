"""Language identification, toxicity and decontamination."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec.llm import decontam, labelled, langid, queries, toxicity

# -- language identification -----------------------------------------------------------------------


def test_ngrams_cover_whole_texts(monkeypatch):
    text = "Ein Satz, der länger ist! " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_PIECE", 17)
    pieces = langid.ngram_counts(text)
    assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])
    for empty in (None, "", "12 34 !?"):
        assert len(langid.ngram_counts(empty)[0]) == 0


def test_ftrl_is_sparse_and_learns():
    rng, model = np.random.default_rng(1), langid.Ftrl(2, 50, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        at = np.sort(np.append(rng.choice(np.arange(10, 50), 5, replace=False), y))
        model.learn(at, np.ones(6) / 6**0.5, y)
    w = model.weights()
    assert w[0, 0] > 0 > w[1, 0] and w[1, 1] > 0 > w[0, 1] and (w == 0).mean() > 0.2


def test_temperature_softens_wrong_scores():
    logits = np.array([[9.0, 0.0]] * 10)
    assert langid._temperature(logits, np.array([0] * 6 + [1] * 4)) > 5


@pytest.fixture(scope="module")
def identified(spark, sf_dir):
    return {r.doc_id: r for r in queries.op6_ftrl_language_id(spark, sf_dir).collect()}


def test_held_out_accuracy(spark, sf_dir, identified):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(truth) == set(identified)
    held = [r for r in identified.values() if r.held_out]
    assert len(held) > 20 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in identified.values())


def test_held_out_labels_teach_nothing(spark, sf_dir, identified):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blind = docs.withColumn("lang", F.when(labelled.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    got = langid.language_id(blind).collect()
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in got} == {k: (r.lang_pred, round(r.score, 9)) for k, r in identified.items()}


def test_odd_texts(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in ((f"der und nicht {i} ung", "de"), ("the and of that", "en"))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)] + [(100, None, "de"), (101, "", None), (102, "123 !!", "en"), (103, "und der", None), (103, "und der", None), (None, "the of", None), (104, "the " * 100_000, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.language_id(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (100, 101, 102))
    assert (by[103].lang_pred, by[None].lang_pred, by[104].lang_pred) == ("de", "en", "en")
    assert {r.lang_pred for r in langid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(df.limit(0)).count() == 0


# -- toxicity --------------------------------------------------------------------------------------


def test_rare_languages_are_taught(spark):
    word = lambda k: "".join(chr(97 + (k // 26**p) % 26) for p in range(3))
    rows = [(k, f"{word(k % 210)} " * 5, f"l{k % 210:03}") for k in range(210 * 6 + 400)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").coalesce(2)
    sample = labelled.bounded_sample(df, "lang", "id", 7)
    assert sample.columns == df.columns and sample.select("lang").distinct().count() == 210 and sample.count() < df.count()


def test_training_leaves_little_memory_on_the_driver(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(langid, "give_back", lambda: freed.append(True))
    langid.train_on(spark.createDataFrame([(k, f"some words {k}", "en") for k in range(9)], "doc_id long, text string, lang string"))
    assert freed


def test_folding():
    assert toxicity.fold("You 1D10T!") == " you idiot " and toxicity.fold("ѕtυpіd") == " stupid " and toxicity.fold("stúp​id") == " stupid "
    assert toxicity.fold("$tupid m@ggot") == " tupid maggot " and toxicity.fold(None) == " " and toxicity.fold("!!") == " "


def test_hits_and_exceptions():
    lex = toxicity.Lexicon({"trash": 4.0, "idiot": 4.0, "stark": 0.0}, {"star": 2.0})
    hit = lambda t: sorted(lex.hits(toxicity.fold(t)).values())
    assert hit("an idiot, trash") == [4.0, 4.0] and hit("put it in the trash can") == [] and hit("idiots") == []
    assert hit("idiot idiot") == [4.0, 4.0] and hit("starling") == [2.0] and hit("stark") == [] and hit("restart") == []
    assert lex.density("idiot") > lex.density("idiot " + "word " * 100) > lex.density("word") == 0


def _toxic_table(spark):
    rng, words = random.Random(2), [f"w{k:03d}x" for k in range(200)]
    rows, marks = [], []
    for i in range(600):
        text, bad = [rng.choice(words) for _ in range(60)], i % 4 == 0
        if bad:
            for k in range(3):
                text[k * 7] = rng.choice(["zorkel", "zorkeling", "zorkels"])
        rows.append((i, " ".join(text), 0.5))
        marks.append((i, int(bad), 1))
    rows += [(900, None, 0.1), (901, "", 0.1), (902, "zorkel " * 50_000, 0.1), (902, "zorkel " * 50_000, 0.1), (None, "w001x", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*marks, (5000, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")


def test_learnt_lexicon(spark):
    docs, labels = _toxic_table(spark)
    got = toxicity.toxicity(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 605 and np.mean([by[i].predicted == (i % 4 == 0) for i in range(600)]) > 0.98
    assert by[902].predicted == 1 and by[900].predicted == by[901].predicted == by[None].predicted == 0 and all(0 <= r.score <= 1 for r in got)
    blind = labels.withColumn("toxic", F.when(labelled.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, blind).collect()} == {k: r.score for k, r in by.items()}


def test_no_labels(spark):
    docs, labels = _toxic_table(spark)
    some = spark.createDataFrame([(1, "you idiot, you moron"), (2, "fine words")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(some, labels.limit(0)).collect()} == {1: 1, 2: 0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_query(spark, sf_dir):
    """On labelled rows that taught nothing: most toxic ones are found, and few others are."""
    larger = sf_dir.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = queries.op8_lexicon_toxicity(spark, larger).collect()
    assert len(got) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    found = sum(t and p for t, p in unseen)
    assert found >= 0.85 * sum(t for t, _ in unseen) and found >= 0.85 * sum(p for _, p in unseen)


# -- decontamination -------------------------------------------------------------------------------

ITEMS = [(i, " ".join(random.Random(i).choice("abcdefghijklmnop") * random.Random(i * 31 + k).randint(1, 4) for k in range(12 + i))) for i in range(30)]


def test_retrieval_equals_brute_force():
    ix, rng = decontam.build_index(ITEMS), random.Random(3)
    for _ in range(300):
        query = sorted(rng.sample(range(len(ix.postings)), rng.randint(1, min(20, len(ix.postings)))))
        scores = {}
        for t in query:
            for item, x in ix.postings[t]:
                scores[item] = scores.get(item, 0) + x
        for threshold in (0.1, 0.5, 1.0):
            assert [i for i, _ in ix.retrieve(query, threshold)] == sorted(i for i, s in scores.items() if s >= threshold - 1e-9)


def test_screening_loses_no_passage():
    ix, rng = decontam.build_index(ITEMS), random.Random(4)
    for _ in range(200):
        item = rng.choice(ITEMS)
        noise = lambda n: " ".join(rng.choice(ITEMS)[1].split()[0] + "q" for _ in range(n))
        assert item[0] in {ix.ids[k] for k in ix.matches(f"{noise(rng.randint(0, 200))} {item[1].upper()}! {noise(rng.randint(0, 90))}")}


def test_question_and_answer():
    assert decontam.question_and_answer("What is it?\nAnswer: a cat") == (["what", "is", "it"], ["a", "cat"])
    assert decontam.question_and_answer("a b c d e f g h i j") == (list("abcdefg"), list("hij")) and decontam.question_and_answer("a") == (["a"], [])
    assert decontam.in_order(list("abcd"), list("xaxbxd")) == 0.75 and decontam.in_order([], []) == 1.0


def test_half_an_item_is_no_match():
    text = " ".join(f"word{k}" for k in range(40))
    ix = decontam.build_index([(1, text)])
    assert ix.matches(text) and not ix.matches(" ".join(text.split()[:28])) and not ix.matches(" ".join(text.split()[12:]))
    assert ix.matches(" ".join("other" if k in (5, 17, 35) else w for k, w in enumerate(text.split())))


def test_contaminated(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x y {t} z", 9) for i, t in ITEMS[:10]] + [(50, None, 9), (51, "", 9), (52, "clean words", 9), (53, "q " * 100_000 + ITEMS[3][1], 9), (0, f"x {ITEMS[0][1]}", 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (77, None), (78, "")], "item_id long, text string")
    got = decontam.contaminated(docs, items).collect()
    assert {(i, i) for i in range(10)} <= {(r.doc_id, r.item_id) for r in got} and (53, 3) in {(r.doc_id, r.item_id) for r in got}
    assert not {50, 51, 52} & {r.doc_id for r in got}
    kept = decontam.decontaminate(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [50, 51, 52] and kept.columns == docs.columns
    blocks = decontam.item_blocks
    monkeypatch.setattr(decontam, "item_blocks", lambda *a: blocks(*a, most_bytes=200))
    # scores depend on the block's statistics, whole matches don't
    assert {(i, i) for i in range(10)} <= {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), items).count() == 0


def test_short_items_and_items_without_an_id(spark):
    """Too few words to tell match a text of just these words; an item without an id keeps none."""
    items = spark.createDataFrame([(1, "Yes"), (2, "new york"), (-1, ITEMS[0][1]), (None, ITEMS[1][1])], "item_id long, text string")
    docs = spark.createDataFrame([(1, "I said yes to a job"), (2, "the new job is far from old york town"), (3, "New York!"), (4, f"x {ITEMS[0][1]}"), (5, f"x {ITEMS[1][1]}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(3, 2), (4, -1), (5, None)]


def test_a_long_item_widens_no_other(spark, monkeypatch):
    rng = random.Random(9)
    short = (100, "What is the capital of France?\nAnswer: Paris")
    items = [*ITEMS, short, (101, " ".join(f"long{rng.randrange(10**6)}" for _ in range(1_000)))]
    spread = " ".join(f"{w} " + " ".join(f"n{rng.randrange(10**6)}" for _ in range(30)) for w in "france of what is the capital of france and paris".split())
    ix = decontam.build_index(items)
    assert not ix.matches(spread) and not ix.matches(f"{spread} {' '.join(items[3][1].split()[:4])}")
    assert [ix.ids[k] for k in ix.matches(f"{spread} what is the capital of france answer paris")] == [100] and ix.matches(items[-1][1])
    docs = spark.createDataFrame([(i, f"x y {t} z {spread}") for i, t in items], "doc_id long, text string").coalesce(1)
    table = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    one = sorted(map(tuple, decontam.contaminated(docs, table).collect()))
    blocks = decontam.item_blocks
    monkeypatch.setattr(decontam, "item_blocks", lambda *a: blocks(*a, most_bytes=4_000))
    assert len(decontam.item_blocks(table, "item_id", "text")) > 1 and sorted(map(tuple, decontam.contaminated(docs, table).collect())) == one


def test_decontamination_query(spark, sf_dir):
    norm = lambda t: f" {' '.join(decontam.words(t))} "
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, norm(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in queries.op7_bm25_decontamination(spark, sf_dir).collect()} == want
