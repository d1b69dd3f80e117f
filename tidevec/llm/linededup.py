"""Line deduplication by an exact set-similarity join, on DataFrame operations alone.

A line is the set of its words (split at white space). Words are ordered by rarity; two sets of Jaccard
similarity ``num/den`` or more share one of their first n - ceil(n * num / den) + 1 words,
so sets meet by those prefix words. Pairs pass a length filter, a positional filter, a filter on bit
signatures of their prefixes and one on the number of prefix words they share, and are verified on the words
themselves. A line goes if any earlier line, in the order of (id, line number), is as similar as that;
equal lines are one set, so copies make no pairs. Different texts with one id, or none, are documents
of their own, in the order of a hash of their texts.

Rarity comes from a table of word counts by hash, over the whole corpus; any table gives the same
result, a finer one fewer candidates. Lines are known by two 64-bit hashes, sets by the order of their
first line, a long. Words of classes above that of ``near`` meet two by two: similar sets whose first
common word is such a word share a second one. Words and pairs of words shared by more than ``near`` sets
go another way: their sets are first compared with the earliest of them, and only those that it doesn't
remove meet every earlier set. So a large group of near copies costs rows, not pairs.

Sets meet in rounds, each of a share of the words, whose postings are the only ones on disk meanwhile. Their number
follows the postings a set, which grow with the corpus as more of its words become frequent.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import numbered
from ..scratch import discard, materialise
from .bits import bit_table, dense, marked, ones

_OTHER = ("\t", "\x0b", "\f", "\r")
_POSTING = ("s", "size", "low", "high", "last")
#: Of so many lines a bit table of 2**26 bits knows one in 16 of all others at most.
TOLD = 1 << 22


def words(line: Column) -> Column:
    """The words of a line whose white space is spaces."""
    return F.array_remove(F.split(line, " "), "")


def documents_of(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, at, text) of every row; the same with each ``at`` once; and line_bits, lower bits of ``at`` that are 0 and can hold any line number.

    ``at`` numbers the different texts of all ids in the order of (id, hash of the text), a null id first; it is made of the id
    itself where that fits. Only texts whose id is not theirs alone are looked up by a hash; where all ids are unique and fit
    nothing is joined.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = df.select(id_.alias("id"), F.coalesce(id_.cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text"))
    shared = materialise(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc"), "shared")
    alone = shared.isEmpty()
    if alone:
        placed = rows.withColumn("rep", F.lit(0))
    else:
        told = rows.withColumn("hash", F.xxhash64("text"))
        different = materialise(told.select("doc", "hash").join(shared, "doc", "left_semi").distinct(), "different")
        numbers = numbered(different, ["doc", "hash"], "place")
        first = numbers.groupBy("doc").agg(F.min("place").alias("first"))
        reps = numbers.join(first, "doc").select("doc", "hash", (F.col("place") - F.col("first")).cast("int").alias("rep"))
        placed = materialise(told.join(reps, ["doc", "hash"], "left").select("id", "doc", F.coalesce("rep", F.lit(0)).alias("rep"), "text"), "documents")
    reach = placed.agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("rep").alias("rep"), F.max(F.octet_length("text")).alias("longest")).first()
    line_bits, low, reps = (reach["longest"] or 0).bit_length() + 1, reach["low"] or 0, (reach["rep"] or 0) + 1
    if ((reach["high"] or 0) - low + 1) * reps << line_bits < 1 << 63:
        number = (F.col("doc") - F.lit(low)) * F.lit(reps).cast("long") + F.col("rep")
    else:
        numbers = materialise(numbered(placed.select("doc", "rep").distinct(), ["doc", "rep"], "number"), "numbers")
        placed, number = materialise(placed.join(numbers, ["doc", "rep"]), "documents"), F.col("number")
    documents = placed.select("id", F.call_function("shiftleft", number, F.lit(line_bits)).alias("at"), "text")
    return documents, documents if alone else materialise(documents.dropDuplicates(["at"]), "documents"), line_bits


def spaced(text: Column) -> Column:
    """The text with every white space but line feeds as spaces; the pattern is only tried on texts that have other white space."""
    other = text.contains(_OTHER[0])
    for c in _OTHER[1:]:
        other = other | text.contains(c)
    return F.when(other, F.translate(text, "".join(_OTHER), " " * len(_OTHER))).otherwise(text)


def lines_of(documents: DataFrame) -> DataFrame:
    """(order, line) of every line with words, white space as spaces; order has the line's number in the lower bits of ``at``."""
    lines = documents.select("at", spaced(F.col("text")).alias("text")).select("at", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.trim("line") != "").select(F.col("at").bitwiseOR(F.col("line_no").cast("long")).alias("order"), "line")


def rarity_table(documents: DataFrame, bits: int) -> DataFrame:
    """One row: for each of 2**bits hash slots, the class (0 to 63) of its count of words in the corpus, which ``word_keys`` finds exclusive-or'ed with the slot, above a key's hash."""
    flat = F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" "))
    counts = documents.select(F.explode(F.split(flat, " ")).alias("word")).groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    grade = F.least(F.lit(63), F.floor(1.4 * F.log2(1 + F.col("n")))).cast("long")
    classes = dense(counts.select("cell", grade.alias("value")), 1 << bits, "rarity")
    return materialise(classes.select(F.transform("values", lambda x, slot: F.call_function("shiftleft", x.bitwiseXOR(slot.cast("long")), F.lit(64 - bits))).alias("grades")), "rarity")


def word_keys(line: Column, grades: Column, bits: int) -> Column:
    """The line's different words as longs, rarest first: the rarity class above the lower bits of the word's hash."""

    def key(h: Column) -> Column:
        return F.coalesce(F.get(grades, F.shiftrightunsigned(h, 64 - bits).cast("int")), F.lit(0).cast("long")).bitwiseXOR(h)  # never null: such arrays sort faster

    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    loose = line.contains("  ") | line.startswith(" ") | line.endswith(" ")  # only then a word is empty
    return F.sort_array(F.transform(F.when(loose, F.array_remove(hashes, F.xxhash64(F.lit("")))).otherwise(hashes), key))


def signed_sets(lines: DataFrame, grades: DataFrame, num: int, den: int, bits: int, near: int) -> DataFrame:
    """Of lines (order, line): order, n (different words), prefix (31 bits of each word's hash, one word more than must hold a shared
    one), last (the key of its last word, cut to 32 bits), rare (how many of its words, the first ones, are of classes up to that of
    ``near``), low and high (a signature of the prefix)."""
    keyed = lines.select("*", grades.scalar().alias("grades")).select("order", word_keys(F.col("line"), F.col("grades"), bits).alias("keys"))
    kept = F.least(F.size("keys"), _prefix_size(F.size("keys"), num, den).cast("int") + 1)
    cut = keyed.select("order", F.size("keys").alias("n"), F.slice("keys", F.lit(1), kept).alias("keys"))
    rare = F.size(F.filter("keys", lambda k: k < F.lit((_grade(near) + 1) << (64 - bits))))
    prefix = F.transform("keys", lambda k: k.bitwiseAND(ones(31)).cast("int"))
    sets = cut.select("order", "n", F.shiftright(F.get("keys", F.size("keys") - 1), 64 - bits - 26).alias("last"), rare.alias("rare"), prefix.alias("prefix"))
    return sets.select("*", _signature(0).alias("low"), _signature(1).alias("high"))


def _grade(n: int) -> int:
    """The rarity class of a count."""
    return min(63, floor(1.4 * log2(1 + n)))


def _prefix_size(n: Column, num: int, den: int) -> Column:
    return F.call_function("div", n * (den - num), F.lit(den)) + 1


def _signature(half: int) -> Column:
    """The lower or upper 64 of the 128 bits that a prefix's words set."""

    def put(bits: Column, word: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)))
        return F.when(word.bitwiseAND(F.lit(64)) == 64 * half, bits.bitwiseOR(bit)).otherwise(bits)

    return F.aggregate("prefix", F.lit(0).cast("long"), put)


def rounds_of(sets: DataFrame, num: int, den: int, each: int = 4, least: int = 4_000_000, most: int = 16) -> int:
    """How many rounds, ``most`` at most, hold the postings of ``sets`` to ``each`` a set (or ``least`` in all) at a time; every round makes all and keeps its own."""
    must = _prefix_size(F.col("n"), num, den)
    often = F.greatest(F.lit(0), F.least(must + 1, F.size("prefix")) - F.col("rare"))
    posted = F.when(F.col("n") * num <= den, must).otherwise(F.least(must, F.col("rare"))) + F.call_function("div", often * (often - 1), F.lit(2))
    told = sets.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum(posted), F.lit(0)).alias("postings")).first()
    return min(most, max(1, ceil(told["postings"] / max(least, each * told["sets"]))))


def postings_of(sets: DataFrame, num: int, den: int, share: int = 0, rounds: int = 1) -> DataFrame:
    """(word, s, size, low, high) of the words of one ``share`` of ``rounds``: s is the set's order. word has ``last`` in its lower
    half; size has n above the number of words from this one on; low and high are a signature of the prefix.

    Sets meet by rare words one by one, by frequent ones two by two: if the first word that two similar sets share is frequent,
    so is the second, and size is then as if the second were the first. Sets so small that one common word may do meet by all words alone too.
    """
    must = _prefix_size(F.col("n"), num, den).cast("int")
    alone = F.when(F.col("n") * num <= den, must).otherwise(F.least(must, "rare"))
    each = sets.select("*", alone.alias("alone"), F.posexplode(F.slice("prefix", F.lit(1), must)).alias("i", "x"))
    # null stands for no second word
    itself, after = F.array(F.lit(None).cast("int")), F.slice("prefix", F.col("i") + 2, F.size("prefix"))
    seconds = F.when(F.col("i") < F.least("alone", "rare"), itself).when(F.col("i") >= F.col("alone"), after).otherwise(F.concat(itself, after))
    both = each.select("order", "n", "last", "low", "high", "alone", "i", "x", F.posexplode(seconds).alias("j", "y"))
    at = F.col("i") + F.col("j") - F.when(F.col("y").isNotNull() & (F.col("i") < F.col("alone")), 1).otherwise(0)
    word = F.when(F.col("y").isNull(), F.col("x").cast("long")).otherwise(F.xxhash64("x", "y").bitwiseAND(ones(31)))
    both = both.select("order", "n", "last", "low", "high", at.alias("at"), word.alias("word"))
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("n") - F.col("at")).cast("long"))
    if rounds > 1:
        both = both.filter(F.pmod(F.xxhash64("word"), F.lit(rounds)) == share)
    return both.select(F.shiftleft("word", 32).bitwiseOR(F.col("last")).alias("word"), F.col("order").alias("s"), size.alias("size"), "low", "high")


def _unpacked(postings: DataFrame) -> DataFrame:
    return postings.select(F.shiftright("word", 32).alias("word"), "s", "size", "low", "high", F.col("word").bitwiseAND(ones(32)).alias("last"))


def may_match(a: str, b: str, num: int, den: int) -> Column:
    """Length, positional and signature filters for postings ``a`` and ``b`` of one word.

    At the first word that two sets share, no more than the shorter rest (it included) can be common; a
    pair that is similar passes there. Of the prefix that ends first, a word that the other prefix lacks
    is not in the other set.
    """
    n = {x: F.shiftright(F.col(f"{x}.size"), 32) for x in (a, b)}
    left = {x: F.col(f"{x}.size").bitwiseAND(ones(32)) for x in (a, b)}
    both = (n[a] + n[b]) * num  # common words needed, times num + den

    def fits(x: str, y: str) -> Column:
        lacking = F.bit_count(F.col(f"{x}.low").bitwiseAND(F.bitwise_not(F.col(f"{y}.low")))) + F.bit_count(F.col(f"{x}.high").bitwiseAND(F.bitwise_not(F.col(f"{y}.high"))))
        return (F.col(f"{x}.last") >= F.col(f"{y}.last")) | ((n[x] - lacking) * (num + den) >= both)

    return (F.least(n[a], n[b]) * den >= F.greatest(n[a], n[b]) * num) & (F.least(left[a], left[b]) * (num + den) >= both) & fits(a, b) & fits(b, a)


def met_pairs(sets: DataFrame, near: int, num: int, den: int, share: int = 0, rounds: int = 1) -> DataFrame:
    """Sets that meet by a posting of one ``share`` of ``rounds``: (a, b) pairs that may match, of words (or pairs of words) that
    up to ``near`` sets share, and for the others postings with b null. One shuffle of the postings serves all.

    The larger set has the first common word in its prefix, the smaller among the words from which on
    2 * num / (num + den) of it are left.
    """
    postings = postings_of(sets, num, den, share, rounds)
    # the join would ask this of its right side alone, and the sides would then have a shuffle each
    postings = postings.filter("word IS NOT NULL AND shiftright(word, 32) IS NOT NULL AND s IS NOT NULL AND size IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL").repartition(F.shiftright("word", 32))
    a = _unpacked(postings).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("word"))).filter("shared > 1").alias("a")
    early = F.col("size").bitwiseAND(ones(32)) * (num + den) >= F.shiftright("size", 32) * (2 * num)
    b = _unpacked(postings).filter(early | (F.spark_partition_id() < 0)).alias("b")  # the same, and it stays above the shuffle
    larger, smaller = F.shiftright("a.size", 32), F.shiftright("b.size", 32)
    roles = (smaller < larger) | ((smaller == larger) & (F.col("a.s") < F.col("b.s")))
    on = (F.col("a.word") == F.col("b.word")) & (F.col("a.shared") <= near) & roles & may_match("a", "b", num, den)
    few = F.col("b.s").isNotNull()
    crowded = [F.when(~few, F.col(f"a.{c}")).alias(c) for c in ("word", *_POSTING[1:])]
    # postings of crowded words find nobody, so the outer join hands them through
    met = a.join(b, on, "left").filter(few | (F.col("a.shared") > near))
    return met.select(F.col("a.s").alias("a"), F.col("b.s").alias("b"), *crowded).distinct()


def met_in_rounds(sets: DataFrame, near: int, num: int, den: int) -> list[DataFrame]:
    """``met_pairs`` of all words, a stored table a round; the shuffle files of a round go before the next."""
    rounds = rounds_of(sets, num, den)
    if rounds == 1:
        return [materialise(met_pairs(sets, near, num, den), "met")]
    return [materialise(met_pairs(sets, near, num, den, share, rounds), "met") for share in range(rounds)]


def sharing(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) whose prefixes share enough words: those of the prefix that ends first, less all that its set may have alone; a is before b."""
    known = sets.select("order", F.struct("n", "last", "prefix").alias("x"))
    both = pairs.join(known.select(F.col("order").alias("a"), F.col("x")), "a").join(known.select(F.col("order").alias("b"), F.col("x").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    common = F.call_function("div", (x["n"] + y["n"]) * num + (num + den - 1), F.lit(num + den))

    def of(z: Column) -> Column:
        return F.size(z["prefix"]) - z["n"] + common

    least = F.when(x["last"] < y["last"], of(x)).when(y["last"] < x["last"], of(y)).otherwise(1)
    shared = both.filter(F.size(F.array_intersect(x["prefix"], y["prefix"])) >= least)
    return shared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def wanted_lines(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(order, line) of the ``wanted`` (order), read again from the documents and stored; some others too, which no pair names.

    A bit table of the wanted lines keeps most others out; where they are too many for it, a join does.
    """
    n = wanted.count()
    found = lines_of(documents).filter(marked(F.xxhash64("order"), bit_table(wanted.select(F.xxhash64("order").alias("spot")), n)))
    return materialise(found if n <= TOLD else found.join(wanted, "order", "left_semi"), "texts")


def verify(texts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(order) of the later sets of ``pairs`` (a, b: orders, a before b) whose lines have enough words in common.

    A set that the earliest of its partners removes needs no other, so those pairs are verified first.
    """
    first = materialise(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    gone = materialise(_alike(texts, first, num, den), "gone")
    left = pairs.join(first, ["a", "b"], "left_anti").join(gone.select(F.col("order").alias("b")), "b", "left_anti")
    return materialise(gone.unionByName(_alike(texts, materialise(left.select("a", "b"), "left"), num, den)), "gone")


def _alike(texts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(order) of the later sets of stored ``pairs`` that are similar. Only lines that a bit table knows from the pairs travel."""
    named = pairs.select(F.xxhash64("a").alias("spot")).unionByName(pairs.select(F.xxhash64("b").alias("spot"))).distinct()
    table = bit_table(named, 2 * pairs.count())
    needed = texts.filter(marked(F.xxhash64("order"), table))
    left, right = needed.select(F.col("order").alias("a"), F.col("line").alias("a_line")), needed.select(F.col("order").alias("b"), F.col("line").alias("b_line"))
    x, y = F.array_distinct(words(F.col("a_line"))), F.array_distinct(words(F.col("b_line")))
    both = pairs.join(left, "a").join(right, "b").select(F.col("b").alias("order"), x.alias("x"), y.alias("y"))
    return both.filter(F.size(F.array_intersect("x", "y")) * (num + den) >= (F.size("x") + F.size("y")) * num).select("order").distinct()


def different_lines(documents: DataFrame, again: tuple[DataFrame, int], first: DataFrame) -> DataFrame:
    """(order, line) of the first line of each set; ``again`` is a bit table of s of sets of more lines, ``first`` (order) are the
    first lines of the sets that it knows. A bit table tells most other lines that it knows, and only what is left is shuffled."""
    lines = lines_of(documents)
    known = marked(F.xxhash64("line"), again)
    spot = F.xxhash64("order")
    doubtful = lines.filter(known & marked(spot, bit_table(first.select(spot.alias("spot")), first.count())))
    return lines.filter(~known).unionByName(doubtful.join(first, "order", "left_semi"))


def removed_lines(documents: DataFrame, num: int = 4, den: int = 5, bits: int | None = None, near: int = 256) -> DataFrame:
    """(order) of every line of ``documents`` (at, text; each ``at`` once) that goes; ``num/den`` is the least Jaccard similarity.

    Lines without words are never removed. ``bits`` sizes the rarity table: 64 slots a document if not given, between 2**12 and 2**20.
    """
    bits = bits or min(20, max(12, ceil(log2(64 * documents.count() + 1))))
    lines = materialise(lines_of(documents).select("order", F.xxhash64("line").alias("s"), F.xxhash64(F.lit(1), "line").alias("s2")), "lines")
    known = materialise(lines.groupBy("s", "s2").agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("lines")), "known")
    several = materialise(known.filter("lines > 1").select("s", "s2", "order"), "several")
    again = bit_table(several.select("s"), several.count())
    first = materialise(known.filter(marked(F.col("s"), again)).select("order"), "first-lines")
    copies = lines.filter(marked(F.col("s"), again)).join(several.withColumnRenamed("order", "first"), ["s", "s2"]).filter("order > first").select("order")
    copies = materialise(copies, "copies")
    discard(lines)
    discard(known)
    sets = materialise(signed_sets(different_lines(documents, again, first), rarity_table(documents, bits), num, den, bits, near), "sets")
    parts = met_in_rounds(sets, near, num, den)
    met = reduce(DataFrame.unionByName, parts)
    pairs = met.filter("b IS NOT NULL").select("a", "b")
    pairs = pairs if len(parts) == 1 else pairs.distinct()  # a pair may meet in several rounds
    few, crowd = materialise(sharing(pairs, sets, num, den), "few"), met.filter("b IS NULL").select("word", F.col("a").alias("s"), *_POSTING[1:])
    wanted = materialise(few.select(F.col("a").alias("order")).union(few.select("b")).union(crowd.select("s")).distinct(), "wanted")
    texts = wanted_lines(documents, wanted)
    dropped = verify(texts, few, num, den)
    if not crowd.isEmpty():
        later = crowd.join(dropped.withColumnRenamed("order", "s"), "s", "left_anti")
        lead = later.groupBy("word").agg(F.min_by(F.struct(*_POSTING), "s").alias("lead")).select("word", "lead.*")
        gone = _meet(texts, later, lead, num, den)
        later = materialise(later.join(gone.withColumnRenamed("order", "s"), "s", "left_anti"), "later")
        dropped = dropped.unionByName(gone).unionByName(_meet(texts, later, crowd, num, den)).distinct()
    found = materialise(copies.unionByName(dropped), "removed")
    for done in (copies, several, first, sets, *parts, few, wanted, texts):
        discard(done)
    return found


def _meet(texts: DataFrame, later: DataFrame, earlier: DataFrame, num: int, den: int) -> DataFrame:
    """(order) of the sets in ``later`` that a set in ``earlier``, before them, removes; both are postings."""
    near = (F.col("a.word") == F.col("b.word")) & (F.col("a.s") < F.col("b.s")) & may_match("a", "b", num, den)
    found = earlier.alias("a").join(later.alias("b"), near).select(F.col("a.s").alias("a"), F.col("b.s").alias("b")).distinct()
    return verify(texts, materialise(found, "found"), num, den)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False, **options) -> DataFrame:
    """One row per row of ``df``: id, n_lines, n_removed, removed_lines (line numbers from 0, in order), and text_hash if ``hashed``.

    Null texts have no lines and give zeros; empty texts have one line, which stays; rows that repeat
    an id are decided each by its own text; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    documents, different, line_bits = documents_of(df, id_col, text_col)
    line_no = F.col("order").bitwiseAND(ones(line_bits))
    removed = removed_lines(different, **options).select(F.col("order").bitwiseXOR(line_no).alias("at"), line_no.cast("int").alias("line_no"))
    removed = removed.groupBy("at").agg(F.array_sort(F.collect_set("line_no")).alias("removed_lines"))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = documents.select("id", "at", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), *([F.xxhash64("text").alias("text_hash")] if hashed else []))
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return rows.join(removed, "at", "left").select(F.col("id").alias(id_col), "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"), *(["text_hash"] if hashed else []))


def without_lines(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the lines that ``removed`` (of ``line_dedup``) names; all columns stay, whatever their names.

    With text_hash in ``removed`` a row is known by its id and text. Without it ids must be unique.
    """
    hashed = "text_hash" in removed.columns
    keys = [F.col(f"`{id_col}`").alias("id"), *([F.col("text_hash")] if hashed else [])]
    gone = removed.filter(F.size("removed_lines") > 0).select(*keys, F.col("removed_lines"))
    if hashed:
        gone = gone.dropDuplicates(["id", "text_hash"])
    text = F.col(f"row.`{text_col}`")
    on = F.col(f"row.`{id_col}`").eqNullSafe(F.col("gone.id"))
    if hashed:
        on = on & (F.xxhash64(text) == F.col("gone.text_hash"))
    joined = df.select(F.struct("*").alias("row")).join(gone.select(F.struct("*").alias("gone")), on, "left")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("gone.removed_lines"), i))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[left.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
