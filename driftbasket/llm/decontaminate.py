"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A document leaks an item if a window of as many words as the item has is similar to it: weighted Jaccard of
their distinct 5-word shingles (a shingle's weight is its number of characters) of at least `similarity`. An item of
fewer words is one shingle, which a window has or lacks. A document shorter than the item is one window.

1. Places. A map of bytes, sized from the items, marks the items' shingle hashes; each document's hashes are probed in
   place, and the words around marked places are cut out in the same pass. All that follows sees only these.
2. Windows. For each item whose shingles in such a cut weigh enough, every start at which a window holds enough of them
   gives one, not only those that line up with the item: after an insertion the best one lies in between.
3. Fingerprints. Windows have weighted SimHashes of 128 bits, in 8 blocks of 16. The index holds each item under
   all values within 3 bits of each of its blocks. Fingerprints within `RADIUS` = 31 bits differ by at most 3 in one
   of 8 blocks, so a join on size, block and value finds all of them; of chance pairs it makes 8 * 697 / 65,536 = 0.085
   rows each. Equal windows are matched once, however many documents have them.
4. The weighted similarity of the candidates is computed exactly.

Words are runs of other than ASCII white space, in lower case. How likely a similar window lies beyond the
radius: at similarity 0.75 the angle between the weight vectors is about 31 degrees, 22 +- 4.3 bits, so about one in
seventy; at 0.8 one in a thousand. Steps 1 and 2 lose nothing.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize
from .quality import word_array

N = 5
BITS, BLOCK_BITS, BLOCK_RADIUS = 128, 16, 3
BLOCKS = BITS // BLOCK_BITS
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Bytes of the map for each shingle of an item, the least and the most of them. Beyond some hundred thousand shingles more places
#: are looked at, with the same results.
MAP_SHARE, LEAST_MAP, MOST_MAP = 32, 1 << 16, 1 << 24
PROBES = (0, 15, 30, 45)


def _hashes(words: Column, n: int) -> Column:
    """Of the shingles of n words at each place 0 .. size - n."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    own = (F.lit(n),) if n < N else ()
    rolled = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n)), *own))
    return F.when(F.size(words) >= n, let(hashed, rolled)).otherwise(F.array().cast("array<bigint>"))


def _weight(words: Column, at: Column, n: int) -> Column:
    return F.length(F.array_join(F.slice(words, at + 1, n), ""))


def _by_size(n_words: Column, short: list[int], body) -> Column:
    """body(n) with the words of a shingle of items of n_words."""
    out = body(N)
    for n in short:
        out = F.when(n_words == n, body(n)).otherwise(out)
    return out


def _weighted(words: Column, n_words: Column, short: list[int]) -> Column:
    """Distinct (hash, weight) of the shingles."""
    sized = lambda n: lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), _weight(words, i, n).alias("w")))
    return F.array_distinct(_by_size(n_words, short, lambda n: let(_hashes(words, n), sized(n))))


def _prints(rows: DataFrame, key: str) -> DataFrame:
    """(key, low, high): the fingerprints of rows(key, shingles)."""
    each = rows.select(key, F.explode("shingles").alias("s")).select(key, F.col("s.w").alias("w"), F.col("s.h").alias("h0"), F.xxhash64("s.h", F.lit(1)).alias("h1"))
    vote = lambda b: F.sum(F.col("w") * F.shiftrightunsigned(f"h{b // 64}", b % 64).bitwiseAND(F.lit(1))).alias(f"b{b}")
    votes = each.groupBy(key).agg(F.sum("w").alias("total"), *(vote(b) for b in range(BITS)))

    def half(first: int) -> Column:
        out = F.lit(0).cast("long")
        for b in range(64):
            out = out.bitwiseOR(F.when(2 * F.col(f"b{first + b}") > F.col("total"), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(b))).otherwise(F.lit(0).cast("long")))
        return out

    return votes.select(key, half(0).alias("low"), half(64).alias("high"))


def _blocks() -> Column:
    per = 64 // BLOCK_BITS
    value = lambda k: F.shiftrightunsigned("low" if k < per else "high", BLOCK_BITS * (k % per)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), value(k).alias("v")) for k in range(BLOCKS)))).alias("b")


def _near_values(value: Column) -> Column:
    """All values within the block's radius."""
    masks = [sum(1 << b for b in c) for n in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), n)]
    return F.explode(F.transform(F.lit(masks), lambda m: value.bitwiseXOR(m)))


def _slot(h: Column, shift: int, size: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(size - 1)).cast("int")


def _total(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0), lambda t, s: t + s["w"])


def _similarity(x: Column, y: Column) -> Column:
    both = _total(F.array_intersect(x, y))
    return both / (_total(x) + _total(y) - both)


def _map_of(hashes: DataFrame) -> bytes:
    """The items' map: a byte for each hash and probe."""
    size = LEAST_MAP
    while size < min(MOST_MAP, MAP_SHARE * hashes.count()):
        size *= 2
    marks = bytearray(size)
    slots = F.array(*(_slot(F.col("h"), p, size) for p in PROBES))
    for r in hashes.select(F.explode(slots).alias("slot")).distinct().toLocalIterator():  # at most `size` rows
        marks[r["slot"]] = 1
    return bytes(marks)


def _cuts(docs: DataFrame, marks: bytes, short: list[int], longest: int) -> DataFrame:
    """(cut, row, doc_id, begin, words, hits): the words up to `longest` before and after marked places, and these, (i, h, w)
    each, counted from the cut's first word `begin`. `row` tells equal rows of docs."""

    def probed(held: Column, h: Column) -> Column:
        marked = [F.substring(held, _slot(h, p, len(marks)) + 1, F.lit(1)) == F.lit(b"\x01") for p in PROBES]
        return reduce(and_, marked)

    def hits(held: Column, words: Column, n: int) -> Column:
        places = lambda hs: F.filter(F.transform(hs, lambda h, i: F.when(probed(held, h), i)), lambda i: i.isNotNull())
        full = lambda hs: F.transform(places(hs), lambda i: F.struct(i.alias("i"), F.element_at(hs, i + 1).alias("h"), _weight(words, i, n).alias("w")))
        return let(_hashes(words, n), full)

    all_ = lambda m, w: hits(m, w, N) if not short else F.array_sort(F.concat(hits(m, w, N), *(hits(m, w, n) for n in short)))
    words = word_array(F.lower(F.coalesce("text", F.lit(""))))
    # the map stands in the plan once, of which the driver keeps texts
    read = let(F.lit(marks), lambda m: let(words, lambda w: F.struct(w.alias("words"), all_(m, w).alias("hits"))))
    # one row each: a filter on what explode() returns isn't pushed below it, where all would be computed twice
    found = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.explode(F.array(read)).alias("x")).where(F.size("x.hits") > 0).select("row", "doc_id", "x.words", "x.hits")
    gap = lambda x, k: (k == 0) | (x["i"] - F.element_at("hits", F.greatest(k, F.lit(1)))["i"] > 2 * longest)
    first = F.transform(F.filter("hits", gap), lambda x: x["i"])  # of the hits of each cut
    found = found.withColumn("first", first).select("*", F.posexplode("first").alias("k", "a"))
    after = F.coalesce(F.get("first", F.col("k") + 1), F.size("words"))
    found = found.withColumn("own", F.filter("hits", lambda x: (x["i"] >= F.col("a")) & (x["i"] < after)))
    begin = F.greatest(F.col("a") - longest, F.lit(0))
    length = F.element_at("own", -1)["i"] + N + longest - begin
    moved = F.transform("own", lambda x: F.struct((x["i"] - begin).alias("i"), x["h"].alias("h"), x["w"].alias("w")))
    return found.select(F.monotonically_increasing_id().alias("cut"), "row", "doc_id", begin.alias("begin"), F.slice("words", begin + 1, length).alias("words"), moved.alias("hits"))


def _windows(cuts: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(cut, n_words, at): the windows that hold shingles of an item of `similarity` of its weight. Whatever is as similar
    as that holds them."""
    shingles = known.select("item_id", "n_words", "weight", F.explode("shingles").alias("s")).select("item_id", "n_words", "weight", F.col("s.h").alias("h"))
    hits = cuts.select("cut", F.size("words").alias("size"), F.explode("hits").alias("x")).select("cut", "size", F.col("x.i").alias("i"), F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    item = ["cut", "size", "item_id", "n_words", "weight"]
    once = hits.join(shingles, "h").groupBy(*item, "h").agg(F.first("w").alias("w"), F.collect_list("i").alias("at"))  # of one document
    both = once.groupBy(*item).agg(F.sum("w").alias("both"), F.flatten(F.collect_list(F.transform("at", lambda i: F.struct(i.alias("i"), F.col("w").alias("w"))))).alias("held")).where(F.col("both") >= similarity * F.col("weight"))
    place = lambda least: F.array_min(F.transform("held", lambda x: x["i"])) if least else F.array_max(F.transform("held", lambda x: x["i"]))
    inside = F.col("n_words") - F.least("n_words", F.lit(N))  # from a window's first place to its last
    low, high = F.greatest(place(True) - inside, F.lit(0)), F.least(place(False), F.greatest(F.col("size") - F.col("n_words"), F.lit(0)))
    weighs = lambda s: _total(F.filter("held", lambda x: (x["i"] >= s) & (x["i"] <= s + inside))) >= similarity * F.col("weight")
    starts = F.filter(F.sequence(F.least(low, high), high), weighs)
    return both.select("cut", "n_words", F.explode(starts).alias("at")).distinct()


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.75) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity, n_windows): the items of items(item_id, text, ...) that
    rows of docs(doc_id, text, ...) leak, with the most similar window (the first of them) and the number of windows
    that leak it.

    Null and empty texts leak nothing and are leaked by nothing; a null doc_id stays null, items of a null item_id are
    not searched; repeated rows count once; other columns are ignored; with no documents or no items the result is
    empty.
    """
    words = word_array(F.lower(F.coalesce("text", F.lit(""))))
    known = materialize(items.select("item_id", words.alias("words")).where("item_id is not null and size(words) > 0").distinct(), "items")
    about = known.agg(F.max(F.size("words")).alias("longest"), F.collect_set(F.when(F.size("words") < N, F.size("words"))).alias("short")).first()
    short = sorted(about["short"])
    known = known.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("n_words"), _weighted(F.col("words"), F.size("words"), short).alias("shingles"))
    known = materialize(known.withColumn("weight", _total(F.col("shingles"))), "shingles")
    marks = _map_of(known.select(F.explode("shingles.h").alias("h")).distinct())
    cuts = materialize(_cuts(docs.select("doc_id", "text"), marks, short, about["longest"] or 1), "cuts")
    at = _windows(cuts, known, similarity)
    windows = at.join(cuts.select("cut", "row", "doc_id", "begin", "words"), "cut")
    windows = windows.select("row", "doc_id", (F.col("begin") + F.col("at")).alias("start_word"), "n_words", F.slice("words", F.col("at") + 1, F.col("n_words")).alias("words"))
    windows = materialize(windows.withColumn("content", F.xxhash64("words", "n_words")), "windows")
    contents = windows.select("content", "n_words", "words").dropDuplicates(["content"])
    contents = materialize(contents.select("content", "n_words", _weighted(F.col("words"), F.col("n_words"), short).alias("shingles")), "contents")
    item_prints = _prints(known, "item").join(known.select("item", "item_id", "n_words"), "item").select("item", "n_words", F.col("low").alias("item_low"), F.col("high").alias("item_high"), "low", "high", _blocks())
    index = item_prints.select("item", "n_words", "item_low", "item_high", F.col("b.k").alias("k"), _near_values(F.col("b.v")).alias("v"))
    prints = _prints(contents, "content").join(contents.select("content", "n_words"), "content").select("content", "n_words", "low", "high", _blocks())
    probes = prints.select("content", "n_words", "low", "high", F.col("b.k").alias("k"), F.col("b.v").alias("v"))
    distance = F.bit_count(F.col("low").bitwiseXOR(F.col("item_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("item_high")))
    # shuffled, the index has so few bytes that it would be broadcast, with all its rows
    near = probes.join(index.hint("merge"), ["n_words", "k", "v"]).where(distance <= RADIUS).select("content", "item", distance.cast("long").alias("distance")).distinct()
    scored = near.join(contents.select("content", "shingles"), "content").join(known.select("item", "item_id", F.col("shingles").alias("item_shingles")), "item")
    scored = scored.withColumn("similarity", _similarity(F.col("shingles"), F.col("item_shingles"))).where(F.col("similarity") >= similarity)
    out = windows.select("row", "doc_id", F.col("start_word").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "content").join(scored.select("content", "item_id", "distance", "similarity"), "content")
    best = F.min(F.struct(-F.col("similarity"), "start_word", "n_words", "distance", "similarity")).alias("x")
    out = out.groupBy("row", "doc_id", "item_id").agg(best, F.count_distinct("start_word", "n_words").alias("n_windows"))
    return out.select("doc_id", "item_id", "x.start_word", "x.n_words", "x.distance", "x.similarity", "n_windows")
