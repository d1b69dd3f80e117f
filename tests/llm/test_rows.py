"""Sharding, exact dedup, chat and HTML: small tables against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import connection, same
from tidevec.llm import chat, exact_dedup, html_extract, queries, sharding

DOCS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "ü" * 50_000), (6, "a b"), (6, "a b"), (7, " a b"), (None, "a b"), (None, "lone"), (8, "ü" * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with nulls, ties, repeated rows, a null id, a long text, and columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 1, "y", 2) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string, size int, _digest string, shard int").repartition(3)


# -- sharding --------------------------------------------------------------------------------------


def test_shards_are_gapless_and_whole(docs):
    rows = sharding.shard_by_slots(docs, 4, n_slots=64).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in DOCS)
    by, where = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r.place)
        where[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(p) == list(range(len(p))) for p in by.values()) and all(0 <= s < 4 for s in by)
    assert all(len(s) == 1 for text, s in where.items() if text[1] < 1000)  # the long one is over a shard's share
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in DOCS if i is not None}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows if r.doc_id is not None} == want


def test_hot_texts_spread(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    by = {r.shard: r.bytes for r in sharding.shard_by_slots(rows, 16).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    assert len(by) == 16 and max(by.values()) - min(by.values()) <= 0.01 * sum(by.values()) / 16 + 5


def test_equal_texts_within_a_share_stay_together(spark):
    """Two texts of a twentieth of the bytes each are whole, in slots of their own."""
    rows = [(i, "x" * 19) for i in range(50)] + [(i, "y" * 19) for i in range(50, 100)] + [(i, f"{i:019d}") for i in range(100, 1000)]
    found = sharding.shard_by_slots(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    by, where = Counter(r.shard for r in found), defaultdict(set)
    for r in found:
        where[r.text_crc32].add((r.shard, r.virtual_slot))
    assert all(len(w) == 1 for w in where.values()) and len({r.virtual_slot for r in found if r.doc_id < 100}) == 2
    assert max(by.values()) - min(by.values()) <= 1


def test_a_stored_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.xxhash64("id").cast("string"), 3).alias("text"))
    first = {r.doc_id: r.shard for r in sharding.shard_by_slots(rows.filter("doc_id < 19000"), 8, map_path=path, tolerance=0.02).collect()}
    again = {r.doc_id: (r.shard, r.map_version) for r in sharding.shard_by_slots(rows.filter("doc_id < 19000"), 8, map_path=path, tolerance=0.02).collect()}
    assert {i: s for i, (s, _) in again.items()} == first and len({v for _, v in again.values()}) == 1
    before = sharding.SlotMap.load(spark, path)
    grown = sharding.shard_by_slots(rows, 8, map_path=path, tolerance=0.02).collect()
    load = Counter()
    for r in grown:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8
    assert sum(r.shard != first[r.doc_id] for r in grown if r.doc_id in first) < 0.03 * len(first)
    after = sharding.SlotMap.load(spark, path)
    assert after.versions[: len(before.versions)] == before.versions
    more = sharding.shard_by_slots(rows, 9, map_path=path, tolerance=0.02).collect()
    assert len({r.shard for r in more}) == 9 and len(sharding.SlotMap.load(spark, path).versions) > len(after.versions)


def test_no_documents_no_shards(docs):
    assert sharding.shard_by_slots(docs.limit(0), 4).count() == 0


def test_slot_maps(spark, tmp_path):
    m = sharding.SlotMap.initial(4, 100)
    weight = {s: 1 + (s * 37) % 50 for s in range(100)}
    level = m.rebalance(weight, 4)
    load = Counter()
    for s, w in weight.items():
        load[level.current[s]] += w
    assert max(load.values()) - min(load.values()) <= 1 and len(level.versions) == 2
    assert sum(a != b for a, b in zip(*level.versions, strict=True)) < 30
    grown = level.grow(4)
    moved = [(a, b) for a, b in zip(level.current, grown.current, strict=True) if a != b]
    assert all(b == 4 for _, b in moved) and len(moved) == 20
    grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown
    assert sharding.SlotMap.initial(4, 8).rebalance({}, 4).current == [0, 1, 2, 3] * 2


def test_shard_query(spark, sf_dir):
    rows = queries.op1_slot_sharding(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert {r.law for r in rows} == {"bytes"} and len(load) == 16
    text = {d.doc_id: (d.text or "").encode() for d in docs}
    by, where = defaultdict(list), defaultdict(set)
    for r in rows:
        assert (r.size, r.text_crc32, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), None)
        by[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(w) == 1 for w in where.values())
    assert max(load.values()) - min(load.values()) <= max(0.02 * sum(load.values()) / 16, max(r.size for r in rows) - sum(load.values()) / 16)


# -- exact dedup -----------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.length(c).cast("string"), lambda c: F.lit("same")], ids=["sha256", "length", "one"])
def test_exact_dedup_equals_brute_force(docs, digest):
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in DOCS:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want[i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = exact_dedup.exact_dedup(docs, digest=digest, salts=3).collect()
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_of_nothing(docs):
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_normalises(docs):
    got = exact_dedup.exact_dedup(docs, normalise=F.trim).collect()
    assert next(r for r in got if r.doc_id == 1).keep_id == 7


@pytest.mark.parametrize("name", sorted({"op2_typed_parts_chat", "op4_exact_dedup"}))
def test_queries_equal_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.oracle_sql()[name])


# -- chat ------------------------------------------------------------------------------------------

TEXT = st.lists(st.sampled_from([*"ab<>\\/lg:# \n", "</turn>", "<turn:user>", "<image:0>", "\\l"]), max_size=30).map("".join) | st.text(max_size=20)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
@settings(max_examples=200, deadline=None)
def test_formatting_is_reversible(turns):
    text = "".join(chat.format_turn(role, [chat.Part(text=t)])["formatted"] for role, t in turns)
    back = [(role, "".join(p.text for p in parts)) for role, parts in chat.parse_turns(text)]
    assert back == turns


def test_parts_become_placeholders_in_order():
    parts = [chat.Part(text="see <b>"), chat.Part("image", ref="a.png", width=57, height=28), chat.Part(text="and"), chat.Part("audio", ref="b.wav", seconds=1.5), chat.Part("document", ref="c.pdf", pages=2), chat.Part(text=None)]
    got = chat.format_turn("assistant", parts)
    assert got["formatted"] == "<turn:assistant>see \\lb\\g<image:0>and<audio:1><document:2></turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 512)]
    assert got["expanded_tokens"] == 553
    assert [got["formatted"][s["start"] : s["end"]] for s in got["loss"]] == ["see \\lb\\g", "and"]
    assert chat.format_turn("user", parts)["loss"] == []
    odd = [chat.Part("video", ref="v.mp4"), chat.Part(None, text="lost?"), chat.Part("audio", seconds=float("nan")), chat.Part("image", width=-5, height=28), chat.Part("document", pages=None)]
    got = chat.format_turn("user", odd)
    assert got["formatted"] == "<turn:user><other:0><other:1><audio:2><image:3><document:4></turn>\n" and got["expanded_tokens"] == 0
    assert [a["ref"] for a in got["attachments"]] == ["v.mp4", "lost?", "", "", ""] and chat.parse_turns(got["formatted"]) == [("user", [0, 1, 2, 3, 4])]
    with pytest.raises(ValueError):
        chat.parse_turns("x<turn:user></turn>\n")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yo</turn>"), (1, 0, "user", "hi"), (2, 0, None, None), (None, 0, "user", "x"), (3, 0, "assistant", "a" * 100_000), (3, 0, "assistant", "a" * 100_000), (1, 2, "assistant", "ü")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(2)
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].n_turns == 3 and got[1].loss_chars == 10 and got[1].loss_sha256 == hashlib.sha256("yo</turn>ü".encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\nyo</turn>\nassistant\nü\n".encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[2].loss_chars == 0 and got[3].loss_chars == 200_000
    assert chat.digest_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", [("text", "hi", None), None, ("image", None, "a")]), (1, 1, "user", None)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string>>")
    got = chat.format_conversations(df, "parts").orderBy("turn").collect()
    assert [r.formatted for r in got] == ["<turn:user>hi<image:0></turn>\n", "<turn:user></turn>\n"] and got[0].attachments[0].ref == "a"


# -- HTML ------------------------------------------------------------------------------------------

LONG = "A sentence that is long enough to make the windows surge, as any real paragraph would be."
PAGES = {
    "<html><body><nav><ul><li><a href=x>m</a></ul></nav><header><h1>Site</h1></header><main><h2>T &amp; x</h2><p>one<br>two<p>three <b>b</b><div class='comments'><p>c1</div><form><input>q</form></main><aside>s</aside><footer>f": "T & x\none two\nthree b",
    "<script>var t='</p><article>';</script><style>p{}</style><article><p>a</p><!-- <p>no</p> --><p>b&nbsp;&copy;</article>": "a\nb ©",
    f"<div id=menu><a href=x>m</a></div><div><a href=1>aaaa</a> <a>bbb</a></div><p>{LONG}</p><p>Short.</p><p>{LONG}</p><div class='cookie-notice'>x</div><div><a>home</a></div>": f"{LONG}\nShort.\n{LONG}",
    "<article><div class=ad>x</div><h1>t</h1><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article><article><p>more</article>": "t\n1\n2\na b\nmore",
    "": "",
    "<p>": "",
    "plain": "plain",
    "<article><p>cut off": "cut off",
    f"<article><p>{'word ' * 40_000}</article>": ("word " * 40_000).strip(),
}


@pytest.mark.parametrize("html", list(PAGES), ids=range(len(PAGES)))
def test_main_text(html):
    assert html_extract.main_text(html) == PAGES[html]


def test_surges():
    assert html_extract.surges([0, 0, 50, 60, 70, 0, 0, 0, 0, 90, 0], 3, 86) == [(1, 6), (7, 11)]
    assert html_extract.surges([], 3, 86) == [] and html_extract.surges([5], 3, 0) == [(0, 1)]


def test_extract(spark, sf_dir):
    rows = [(1, "u", None, "t"), (2, None, "<p>a", "t"), (2, None, "<p>a", "t"), (None, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [(0, "", 0), (1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert html_extract.extract(df.limit(0)).count() == 0
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op3_line_block_html(spark, sf_dir).collect()
    assert len(got) == len(pages) and all(r.text == html_extract.main_text(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)
    assert all("<" not in r.text and "track(" not in r.text for r in got)


def test_lines_outside_an_article_are_not_lost():
    text = "".join(f"<p>{k} {LONG}</p>" for k in range(4))
    want = "\n".join(f"{k} {LONG}" for k in range(4))
    assert html_extract.main_text(f"<div>{text}</div><section><article><a href=1>card</a></article><article><a href=2>card</a></article></section>") == want
    assert html_extract.main_text(f"<div><a href=1>home</a></div><article><p>a</p>{text}<p>b</p><p>c</p><p>d</p><p>e</p></article>") == f"a\n{want}\nb\nc\nd\ne"


def test_all_spans_are_kept():
    html = f"<p>{LONG}</p><h2>List</h2><ul><li>a<li>b<li>c</ul><p><a href=1>a link</a> x</p><p>Sh is.</p><p>{LONG}</p><p>{LONG}</p>"
    assert html_extract.main_text(html) == f"{LONG}\nList\na\nb\nc\na link x\nSh is.\n{LONG}\n{LONG}"


PARSED = {
    '<article><p>A <svg class="i"/> text</p><p>more': "A text\nmore",
    "<!-- <script> --><article><p>a</p></article><script>x</script>": "a",
    "<article><p>a</p><script>s = '<!--'</script><p>b</p></article>": "a\nb",
    "<article><math><mi>x</mi><annotation>no</annotation></math> and <xmp><b>&amp;</xmp></article>": "x and\n<b>&amp;",
    "<article><svg><title/><desc>no</desc><text>label</text></svg> a</article>": "label a",
    f"<div class='has-sidebar'><p>{LONG}</p></div>": LONG,
    f"<article class='post tag-social'><p>{LONG}</p></article>": LONG,
    f"<div class='page notice'><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p>": f"{LONG}\n{LONG}\n{LONG}",
    f"<form><p>{LONG}</p><input></form>": LONG,
    f"<body><p class='notice'>no<p>{LONG}<ul><li class=ad>no<li>yes</ul></body>": f"{LONG}\nyes",
    f"<p>{LONG}</p><div class='comments'><p>{LONG}</p><p>{LONG}</p></div>": LONG,
}


@pytest.mark.parametrize("html", list(PARSED), ids=range(len(PARSED)))
def test_markup_hides_no_text(html):
    assert html_extract.main_text(html) == PARSED[html]


def test_only_rows_of_bad_markup_are_slow():
    assert html_extract.main_text("<div>" * 20_000 + "a" + "</section>" * 20_000) == "a"
