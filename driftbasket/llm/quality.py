r"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared with references of its
language by the Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). Short texts
say little, so each rule has a guard of minimum length. Beside these stand plain counts: words
[^\x20\x09-\x0D]+, symbols, repeated lines and repeated five-word windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

WHITE = r"\x20\x09-\x0D"
#: Character classes, in this order: a-z, A-Z, 0-9, white space, other ASCII, the rest.
N_CLASSES = 6
SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes; the common words and their shares of all words."""

    classes: dict[str, list[float]] = field(default_factory=dict)
    words: dict[str, list[tuple[str, float]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Limits:
    """Either distance alone beyond its limit, or both beyond their joint limits, reject a document."""

    class_distance: float = 0.25
    word_distance: float = 0.31
    joint_class_distance: float = 0.12
    joint_word_distance: float = 0.24
    min_chars: int = 200
    min_words: int = 60


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WHITE}]+"), "")


def char_counts(text: Column) -> Column:
    """Array of the classes' counts, then that of SYMBOLS. Only the first pattern reads the whole text, the others
    what is left of it."""
    without = lambda x, p: F.regexp_replace(x, p, "")

    def rest(r: Column) -> Column:  # neither lower case nor white space
        def last(o: Column) -> Column:
            upper, digit, other = (F.length(r) - F.length(without(r, p)) for p in ("[A-Z]+", "[0-9]+", r"[!-/:-@\[-`{-~]+"))
            return F.array(F.length(text) - F.length(o), upper, digit, F.length(o) - F.length(r), other, F.length(r) - upper - digit - other, F.length(r) - F.length(without(r, SYMBOLS)))

        return last

    return let(without(text, "[a-z]+"), lambda o: let(without(o, f"[{WHITE}]+"), lambda r: rest(r)(o)))


def js_distance(p: list[Column], q: list[float]) -> Column:
    """Of shares p (columns) from shares q (numbers); both sum to 1."""
    total = F.lit(0.0)
    for x, y in zip(p, q, strict=True):
        m = (x + F.lit(float(y))) / 2
        if y > 0:
            total += F.lit(float(y)) * F.log2(F.lit(float(y)) / m)
        total += F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window that occurs twice or more."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
            return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.get(s, k + 1)["h"] == e["h"], F.get(s, k - 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"]))

        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        cover = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(let(tagged, places), cover)).otherwise(F.lit(0))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda hw: F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(hw, i, 5)))
    return F.when(n >= 6, let(let(hashed, windows), covered)).otherwise(F.lit(0)).cast("long")


def fit_references(docs: DataFrame, labels: DataFrame, sample: int = 4000, common_words: int = 16, least_words: int = 500) -> References:
    """From at most `sample` labelled good documents (quality 1), chosen by a hash of their id; of each language with
    at least `least_words` words in them."""
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").join(F.broadcast(good), "doc_id").select("lang", "text")
    per_class = rows.select("lang", char_counts(F.col("text")).alias("c"), F.size(word_array(F.col("text"))).alias("n"))
    sums = per_class.groupBy("lang").agg(F.sum("n").alias("n"), *(F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(N_CLASSES)))
    classes = {}
    for r in sums.where(F.col("n") >= least_words).orderBy("lang").collect():
        total = sum(r[f"c{k}"] for k in range(N_CLASSES))
        if total:
            classes[r["lang"]] = [r[f"c{k}"] / total for k in range(N_CLASSES)]
    seen = rows.where(F.col("lang").isin(list(classes))).select("lang", F.explode(word_array(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    total = {r["lang"]: r["n"] for r in sums.select("lang", "n").collect()}
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("count"), "word"))
    parted = seen.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))  # a language may have most of the words
    top = parted.withColumn("k", rank("part")).where(F.col("k") <= common_words).withColumn("k", rank())
    words: dict[str, list[tuple[str, float]]] = {}
    for r in top.where(F.col("k") <= common_words).orderBy("lang", "k").collect():
        words.setdefault(r["lang"], []).append((r["word"], r["count"] / total[r["lang"]]))
    return References(classes, words)


def _word_distance(words: Column, n: Column, common: list[tuple[str, float]]) -> Column:
    known = F.array(*(F.lit(w) for w, _ in common))
    held = F.filter(words, lambda w: F.array_contains(known, w))
    q = [s for _, s in common]

    def distance(found: Column) -> Column:
        def measured(shares: Column) -> Column:
            p = [F.element_at(shares, k + 1) for k in range(len(common))]
            return js_distance([*p, F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))], [*q, max(0.0, 1 - sum(q))])

        return let(F.transform(known, lambda c: F.size(F.filter(found, lambda w: w == c)) / n), measured)

    return let(held, distance)


def _by_language(lang: Column, per: dict[str, Column]) -> Column:
    """The document's own language's, or for one without a reference 0."""
    out = None
    for name, value in per.items():
        out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


def _line_copies(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{WHITE}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _class_distance(text: Column, counts: Column, lang: Column, references: References, limits: Limits) -> Column:
    n = F.length(text)
    shares = F.transform(F.slice(counts, 1, N_CLASSES), lambda x: x / n)
    own = lambda s: _by_language(lang, {name: js_distance([F.element_at(s, k + 1) for k in range(N_CLASSES)], q) for name, q in references.classes.items()})
    return F.when(n >= limits.min_chars, let(shares, own)).otherwise(F.lit(0.0))


def _words_distance(words: Column, lang: Column, references: References, limits: Limits) -> Column:
    n = F.size(words)
    per = {name: _word_distance(words, n, common) for name, common in references.words.items()}
    return F.when(n >= limits.min_words, _by_language(lang, per)).otherwise(F.lit(0.0))


def _near(c: Column, w: Column, limits: Limits) -> Column:
    return (c <= limits.class_distance) & (w <= limits.word_distance) & ((c <= limits.joint_class_distance) | (w <= limits.joint_word_distance))


def quality(docs: DataFrame, references: References, limits: Limits = Limits()) -> DataFrame:
    """docs(doc_id, text, lang, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance and kept; the columns of docs stay in front.

    A null text is an empty one: 0 words, not kept. Where a language is null or has no reference, only the
    plain rules decide. Repeated rows are judged each; columns of
    docs that have the names of results are replaced; an empty table gives an empty one.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    own = "own"  # a column for what is computed once
    while own in docs.columns:
        own += "_"
    t, w, c = (F.col(f"{own}.{x}") for x in "twc")
    lang = F.col("lang")
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*(x for x in docs.columns if x not in made), F.struct(text.alias("t"), word_array(text).alias("w"), char_counts(text).alias("c")).alias(own))
    base = base.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": (F.length(t) - F.get(c, F.lit(3))).cast("long"),
            "n_symbols": F.get(c, F.lit(N_CLASSES)).cast("long"),
            "n_dup_lines": _line_copies(t),
            "n_repeat_words": _repeat_words(w),
            "class_distance": _class_distance(t, c, lang, references, limits),
            "word_distance": _words_distance(w, lang, references, limits),
        }
    )
    base = base.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words"))).drop(own)
    return base.withColumn("kept", ~F.col("base_failed") & _near(F.col("class_distance"), F.col("word_distance"), limits))


def keep(docs: DataFrame, references: References, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that quality() keeps. The verdict is one expression whose parts are bound once, since a
    filter would compute a column anew wherever it is named."""
    t = F.coalesce("text", F.lit(""))
    near = lambda w: let(F.struct(_class_distance(t, char_counts(t), F.col("lang"), references, limits).alias("c"), _words_distance(w, F.col("lang"), references, limits).alias("w")), lambda x: _near(x["c"], x["w"], limits))
    verdict = let(word_array(t), lambda w: F.when(let(_repeat_words(w), lambda r: _failed(F.size(w), r)), F.lit(False)).otherwise(near(w)))
    return docs.where(verdict)
