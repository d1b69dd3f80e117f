"""SimHash, line dedup, packing and the pipeline, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.oracle import connection, same
from tidevec.llm import components, decontam, langid, linededup, numbering, packing, queries, simhash

JSON = public_tokenizers.path("byte_bpe_50k.json")

# -- components and numbering ----------------------------------------------------------------------


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(-40, 40)] + [(100, 100 + k) for k in range(1, 200)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(5, 4), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([x for x in links if x[0] != x[1]]).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_rank(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, 1).otherwise(F.col("id") % 3 + 5).alias("c"))
    rows = numbering.gapless_rank(df, "c", F.col("id"), [F.col("id")], per_bucket=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.c].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 500


# -- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    marks = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({m for _, m in marks})
    root = roots([(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 3])
    least = {}
    for i, m in marks:
        if i is not None:
            r = root.get(m, m)
            least[r] = min(i, least.get(r, i))
    return Counter((i, f"{m:016x}", least.get(root.get(m, m))) for i, m in marks)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "Two\x0bWords", "a b c d a b c", "Äpfel ÄPFEL x\xa0y z", "w " * 70_000], ids=range(8))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_are_complete(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    bits = set(centres.tolist()) | {0, 1, 7, 2**64 - 1}
    for c in centres.tolist():
        for _ in range(int(rng.integers(1, 60))):
            x = c
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                x ^= 1 << b
            bits.add(x)
    distinct = sorted(bits)
    want = roots([(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in distinct], "bits long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all((a ^ b).bit_count() <= 3 * 64 for a, b in got) and roots(got) == want


def test_tiles_skip_only_what_is_far():
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2**64, 900, dtype=np.uint64) & np.uint64(0xFFFF)
    bits = bits[np.lexsort((bits, np.bitwise_count(bits)))]
    i, j = simhash.tile_links(np.zeros(900, int), bits, 3)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(900) for b in range(a + 1, 900) if (int(bits[a]) ^ int(bits[b])).bit_count() <= 3}


def test_simhash_components(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(9, base), (4, base), (5, base + " end"), (6, None), (7, ""), (8, "alone here"), (8, "alone here"), (None, base), (None, "nobody"), (11, base.replace("w7 ", "q "))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bits int")
    got = simhash.simhash_components(df).select("doc_id", simhash.as_hex(F.col("bits")), "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_simhash_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op5_tiled_simhash(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_components(rows)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_wide_fingerprints():
    text = " ".join(f"w{k % 700}" for k in range(40_000))
    assert simhash.wide_fingerprint(text, 3, 42, 4)[0] == simhash.fingerprint(text) and simhash.wide_fingerprint(None, 5, 42, 4) == [0] * 4
    assert len(set(simhash.wide_fingerprint(text, 5, 42, 4))) == 4


def test_near_copies_are_found(spark):
    """Texts with some words changed: nine in ten pairs of similarity 0.8 or more are in one group, and no clean text is in one."""
    rng, words = random.Random(9), [f"w{k}" for k in range(5000)]
    rows, pairs = [], []
    for base in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        copy = list(text)
        for at in rng.sample(range(len(copy)), max(1, len(copy) // 60)):
            copy[at] = rng.choice(words)
        rows += [(2 * base, " ".join(text)), (2 * base + 1, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append(base)
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 300)))) for k in range(100)]
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and sum(got[2 * k + 1] == 2 * k for k in pairs) >= 0.9 * len(pairs)
    assert all(got[i] in (i, i - 1) and (i < 1000 or got[i] == i) for i in got)


def test_near_components_equal_brute_force(spark):
    """Every pair of Jaccard similarity 0.8 or more links and no other, whatever its SimHashes."""
    rng, words, rows, sets = random.Random(11), [f"w{k}" for k in range(2000)], [], []
    for base in range(0, 1200, 2):
        text = [rng.choice(words) for _ in range(rng.randint(60, 260))]
        rows.append((base, " ".join(text)))
        for _ in range(rng.randint(1, 1 + len(text) // 45)):
            text[rng.randrange(len(text))] = "x" + rng.choice(words)
        rows.append((base + 1, " ".join(text)))
    tail = " ".join(rng.choice(words) for _ in range(20))
    rows += [(2000 + k, "same " * 300 + " ".join(f"t{k}v{i}" for i in range(20)) + " " + tail) for k in range(5)]
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    want = roots([(i, j) for j in range(len(rows)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(want) > 400 and got == {i: rows[want.get(k, k)][0] for k, (i, _) in enumerate(rows)}


def test_prefix_pairs_of_large_groups():
    """A group larger than a tile, cut by batches, gives each pair of different roots once."""
    rng = np.random.default_rng(2)
    key, root = np.repeat([1, 2, 3], [3, 700, 2]), rng.integers(0, 600, 705)
    got = []
    for end, first in ((400, 0), (705, 400)):
        got += [(i, j) for a, b in simhash._crossing(key[:end], root[:end], first) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for j in range(705) for i in range(j) if key[i] == key[j] and root[i] != root[j]}


def test_bands_lose_no_links(spark):
    """All links within the radius, against brute force."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, (30, 4), dtype=np.uint64)
    prints = [c.copy() for c in centres]
    for c in centres:
        for _ in range(8):
            x = c.copy()
            for b in rng.choice(256, int(rng.integers(0, 46)), replace=False).tolist():
                x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            prints.append(x)
    bands = simhash.Bands(4, simhash.differing_share(0.8), 12)
    assert bands.radius == 46
    want = roots([(i, j) for j in range(len(prints)) for i in range(j) if int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= 46])
    df = spark.createDataFrame([(i, *x.astype(np.int64).tolist()) for i, x in enumerate(prints)], "node long, f0 long, f1 long, f2 long, f3 long").repartition(3)
    links = [(r.a, r.b) for r in simhash.banded_links(df, bands).collect()]
    got = roots(links)
    assert set(got) <= set(want) and sum(got.get(i) == want[i] for i in want) >= 0.98 * len(want)


def test_texts_travel_only_for_pairs_whose_prefixes_share_enough(spark, monkeypatch):
    """Texts with a passage in common meet by its shingles if those aren't known as common; they are told apart without their texts."""
    rng, words, told, similar = random.Random(17), [f"w{k}" for k in range(4000)], [], simhash.similar
    passage = [rng.choice(words) for _ in range(16)]
    rows = [(k, " ".join([*(rng.choice(words) for _ in range(150)), *passage, *(rng.choice(words) for _ in range(rng.randint(0, 30)))])) for k in range(60)]
    rows.append((60, " ".join([*rows[0][1].split()[:-2], "other", "end"])))

    def counted(texts, nodes, pairs, *more):
        told.append({(r.a, r.b) for r in pairs.collect()})
        return similar(texts, nodes, pairs, *more)

    monkeypatch.setattr(simhash, "similar", counted)
    monkeypatch.setattr(simhash, "common_shingles", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    got = {r.doc_id: r.component_id for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 60 for k in range(61)} and sum(map(len, told)) <= 3


def test_near_components_in_rounds(spark, monkeypatch):
    """Rounds of bands, prefixes and pairs find what one round finds, and their tables are as many."""
    rng, words, rows, made, materialise = random.Random(19), [f"w{k}" for k in range(900)], [], [], simhash.materialise
    for base in range(0, 300, 3):
        text = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        for k in range(3):
            rows.append((base + k, " ".join(text)))
            text[rng.randrange(len(text))] = f"x{base}y{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    for name, value in (("ROUND", 500), ("PAIRS", 9)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(simhash, "materialise", lambda df, label: made.append(label) or materialise(df, label))
    got = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    assert got == whole and len(set(whole.values())) < 290
    many = Counter(made)
    assert many["simhash-met"] > 1 and many["simhash-rest"] > 2 and many["simhash-similar"] > 2


def test_near_components_of_odd_rows(spark):
    rows = [(3, None), (2, ""), (5, "a b"), (5, "a b"), (None, "a b"), (None, "alone"), (9, "a b c d e f g")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, row string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_components(df).collect())
    assert got == Counter([(3, 2), (2, 2), (5, 5), (5, 5), (None, 5), (None, None), (9, 9)])
    kept = corpus_pipeline.without_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(2, ""), (5, "a b"), (5, "a b"), (None, "alone"), (9, "a b c d e f g")])
    assert corpus_pipeline.without_near_copies(spark, df.limit(0), "").count() == 0


# -- line dedup ------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        out[i] = []
        for k, line in enumerate((text or "").split("\n")):
            words = set(line.split())
            if words:
                if any(9 * len(words & o) >= 4 * (len(words) + len(o)) for o in seen):
                    out[i].append(k)
                seen.append(words)
    return out


def line_rows():
    rng, words = random.Random(5), [f"w{k}" for k in range(40)]
    base, rows = [rng.choice(words) for _ in range(12)], []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < 0.5:
                line = list(base)
                for _ in range(rng.randint(0, 3)):
                    line[rng.randrange(12)] = rng.choice(words)
                lines.append(" ".join(line))
            elif k < 0.6:
                lines.append(rng.choice(["", " ", "\t"]))
            else:
                lines.append((" " if rng.random() < 0.2 else "") + rng.choice([" ", "\t", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 6))))
        rows.append((d, "\n".join(lines)))
    return [*rows, (70, None), (71, ""), (72, " ".join(f"v{k}" for k in range(20_000))), (73, " ".join(f"v{k}" for k in range(19_000))), (None, "first of all\nfirst of all")]


@pytest.mark.parametrize("near", [2, 64])
def test_lines_equal_brute_force(spark, near):
    rows = line_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, n int")
    got = linededup.line_dedup(df, near=near, bits=10)
    assert {r.doc_id: list(r.removed_lines) for r in got.collect()} == brute_lines(rows)
    if near > 2:
        kept = {r.doc_id: r.text for r in linededup.without_lines(df, got).collect()}
        assert kept[70] is None and kept[None] == "first of all"


def test_no_lines(spark):
    assert linededup.line_dedup(spark.createDataFrame([], "doc_id long, text string"), bits=10).count() == 0
    assert linededup.line_dedup(spark.createDataFrame([(1, None)], "doc_id long, text string"), bits=10).collect()[0][1:] == (0, 0, [])


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(None, "a b c\nsame words here"), (None, "same words here\nonly mine"), (None, "d e f\ng h i"), (7, "x y\nsame words here"), (7, "p q\nr s"), (7, "p q\nr s"), (-(1 << 63), "t u\na b c"), (8, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removed = linededup.line_dedup(df, hashed=True, bits=10)
    assert removed.count() == len(rows)
    left = [line for r in linededup.without_lines(df, removed).collect() for line in r.text.split("\n")]
    once = {"a b c", "same words here", "only mine", "d e f", "g h i", "x y", "t u", "lone"}
    assert Counter(w for w in left if w) == Counter({**dict.fromkeys(once, 1), "p q": 2, "r s": 2})


def test_frequent_words_of_unlike_lines_make_no_crowd(spark, monkeypatch):
    rng, crowds = random.Random(8), []
    rows = [(d, " ".join(rng.sample([f"w{k}" for k in range(60)], 6))) for d in range(200)]
    rows += [(200 + d, rows[d][1] + f"\n{rows[d][1]} more" + "\nthe\nthe the") for d in range(6)]
    meet = linededup.met_pairs

    def met_pairs(*args):
        met = meet(*args)
        crowds.append(met.filter("b IS NULL").count())
        return met

    monkeypatch.setattr(linededup, "met_pairs", met_pairs)
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), near=8, bits=12)
    assert {r.doc_id: list(r.removed_lines) for r in got.collect()} == brute_lines(rows)
    assert crowds[0] < 20


def test_lines_meet_in_rounds(spark, monkeypatch):
    rows, shares = [r for r in line_rows() if len(r[1] or "") < 1000], []
    monkeypatch.setattr(linededup, "rounds_of", lambda *args: 3)
    posted = linededup.postings_of

    def postings_of(sets, num, den, share, rounds):
        shares.append((share, posted(sets, num, den, share, rounds).count(), posted(sets, num, den).count()))
        return posted(sets, num, den, share, rounds)

    monkeypatch.setattr(linededup, "postings_of", postings_of)
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), near=4, bits=10)
    assert {r.doc_id: list(r.removed_lines) for r in got.collect()} == brute_lines(rows)
    assert [s for s, _, _ in shares] == [0, 1, 2]
    assert sum(n for _, n, _ in shares) == shares[0][2] and max(n for _, n, _ in shares) < shares[0][2] / 2


def test_rounds_follow_the_postings(spark):
    sets = [(k, 20, 3, list(range(6))) for k in range(10)]  # each: words 0 to 2 alone, words 3 to 5 two by two
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in sets], "order long, n int, rare int, prefix array<int>, last long, low long, high long")
    assert linededup.postings_of(df, 4, 5).count() == 60
    assert [linededup.rounds_of(df, 4, 5, each, 1) for each in (1, 2, 4, 6)] == [6, 3, 2, 1]
    assert linededup.rounds_of(df, 4, 5) == linededup.rounds_of(df.limit(0), 4, 5) == 1


@pytest.mark.parametrize("told", [0, 1 << 22])
def test_texts_that_no_pair_names_change_no_line(spark, monkeypatch, told):
    rows, plain = [r for r in line_rows() if len(r[1] or "") < 1000], linededup.bit_table
    rows += [(100 + d, "\n".join(r[1] or "" for r in rows[d : d + 2])) for d in range(8)]
    monkeypatch.setattr(linededup, "TOLD", told)
    monkeypatch.setattr(linededup, "bit_table", lambda hashes, count: plain(hashes.sparkSession.range(1 << 15), 1))  # all bits set
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), near=4, bits=10)
    assert {r.doc_id: list(r.removed_lines) for r in got.collect()} == brute_lines(rows)


def test_a_word_is_met_by_the_early_words_of_smaller_sets_alone(spark):
    sets = linededup.signed_sets(spark.createDataFrame([(k, " ".join(f"{'w' if i else 'x'}{i}y{k % 5 if i else 0}" for i in range(20))) for k in range(40)], "order long, line string"), spark.range(1).select(F.array_repeat(F.lit(0).cast("long"), 1 << 10).alias("grades")), 4, 5, 10, 256)
    met = linededup.met_pairs(sets, 256, 4, 5)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter") :]
    assert join.index("SPARK_PARTITION_ID") < join.rindex("RepartitionByExpression") and plan.count("SPARK_PARTITION_ID") == 1
    assert met.filter("b IS NOT NULL").count() == 5 * 28  # the pairs of each eight equal sets


def test_line_query_equals_sql(spark, sf_dir):
    name = "op10_set_similarity_line_dedup"
    same(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.oracle_sql()[name])


# -- packing ---------------------------------------------------------------------------------------


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[k] <= capacity:
                bins[j] += items[k]
                place(k + 1, bins)
                bins[j] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_bins_are_fewest():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        packed = packing.pack_lengths(Counter(items), capacity)
        used = Counter()
        for kind, m in packed:
            assert sum(n * c for n, c in kind) <= capacity
            for n, c in kind:
                used[n] += c * m
        assert used == Counter(items) and packing.bins_of(packed) == fewest(items, capacity) >= packing.lower_bound(Counter(items), capacity)


def test_many_lengths_stay_near_the_bound():
    rng = random.Random(2)
    counts = Counter(rng.randint(1, 1024) for _ in range(20_000))
    assert packing.bins_of(packing.pack_lengths(counts, 1024)) <= packing.lower_bound(counts, 1024) * 1.005
    assert packing.pack_lengths({}, 8) == []
    with pytest.raises(ValueError):
        packing.pack_lengths({9: 1}, 8)


TEXTS = ["", "a b", " a  b ", "a\n\nb c\t", "it's 123 ok!! we'LL z", "Äö ñ é x", "x\x1cy z", "a\n", "x <|endoftext|> y", "a  <|endoftext|>\n\n<|endoftext|>b", "<|endoftext|", "\u3000x  \u00a0y", "e\u0301 \U0001f600\U0001f600"]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_tokens(text):
    """The contract's plain call, special strings included."""
    reference = Tokenizer.from_file(JSON)
    tokens = packing.Tokens(JSON)
    assert tokens.full is not None
    assert np.frombuffer(tokens.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_special_ids():
    assert np.frombuffer(packing.Tokens(JSON).encode("x <|endoftext|> y"), "<u4").tolist() == [87, 220, 50256, 331]


def test_other_files_are_read_by_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = packing.Tokens(path)
    assert tokens.full is None
    assert np.frombuffer(tokens.encode("Hello  World"), "<u4").tolist() == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


def check_packing(rows, pieces):
    reference, places, by_doc = Tokenizer.from_file(JSON), defaultdict(list), defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    copies = Counter(i for i, _ in rows)
    for i, text in dict(rows).items():
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 2]
        found = sorted(by_doc[i], key=lambda p: p.start)[:: copies[i]]
        assert [p.piece for p in found] == list(range(len(found)))
        assert sum(p.length for p in found) == len(ids) and all(p.length == 1024 for p in found[1:])
        for p in found:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    lengths = Counter(p.length for p in pieces)
    return len(places), packing.lower_bound(lengths, 1024)


def test_the_search_beats_best_fit():
    """Bins of a made table in which best-fit decreasing is two bins above the lower bound."""
    rng = random.Random(5)
    counts = Counter(rng.randint(100, 700) for _ in range(3000)) | Counter({n: 3 for n in range(1, 60)})
    found, fit = packing.pack_lengths(dict(counts), 1024), packing.best_fit_decreasing(dict(counts), 1024)
    assert packing.gap(found, 1024) < packing.gap(fit, 1024)
    used = Counter()
    for kind, m in found:
        assert sum(n * c for n, c in kind) <= 1024
        for n, c in kind:
            used[n] += c * m
    assert used == counts


def test_pack(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, None), (3, ""), (4, "word " * 5000), (5, "a b c"), (5, "a b c"), (None, "x y")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, rank int")
    n, least = check_packing(rows, packing.pack(df, JSON).collect())
    assert n == least
    assert packing.pack(df.limit(0), JSON).count() == 0


def test_pack_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    n, least = check_packing(rows, queries.op9_bin_completion_packing(spark, sf_dir).collect())
    assert n <= least + 1


# -- pipeline --------------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train_on(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    told = {i: model.predict(t) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if told[i][0] != "und" and told[i][1] >= 0.4}
    gone = brute_lines(list(rows.items()))
    rows = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if t.split()}
    prints = {i: np.array(simhash.wide_fingerprint(t, 5, 42, 4), np.uint64) for i, t in rows.items()}
    root = roots([(i, j) for i in prints for j in prints if i < j and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= 46])
    rows = {i: t for i, t in rows.items() if root.get(i, i) == i}
    items = [" ".join(decontam.words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(f" {x} " in f" {' '.join(decontam.words(t))} " for x in items)}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(rows)
    check_packing(list(rows.items()), pieces)


def test_stages_bear_clashing_columns_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    clashing = ["_kept", "_gone", "_id", "_hash", "gone", "row", "id", "doc", "order", "node", "f0", "least", "spot", "_text", "draw"]
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clashing)])
    more = more.unionByName(more.limit(3)).unionByName(more.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(more.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, more, sf_dir)
        assert found.columns == more.columns and found.count() <= more.count(), name
        assert stage(spark, more.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, more, sf_dir).count() >= more.count()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
