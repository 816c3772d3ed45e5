"""Quality rules with adaptive thresholds, in DataFrame operations only.

Base rules reject texts of under 50 words and texts of which over half the words lie in
repeated 3-word windows.  The other measures (symbols per thousand characters, repeated
words, repeated lines and the length of words, each in thousandths) have no fixed cutoff:
per language and source, a mergeable quantile sketch gives the threshold.  The sketch is a
histogram of logarithmic buckets (relative error under 1/16): counts add up in any order,
partial counts are merged map-side before the shuffle, its size is bounded by the bucket
rule and not by the data, and the result does not depend on partitioning.

A group's cutoff is where its sketch shows that texts of another kind begin: a valley.  At the upper
side of the valley lie between ``LEAST_PERCENT`` and ``MOST_PERCENT`` of the group's texts, and the ``VALLEY``
buckets below them (a factor of about 1.25) hold fewer than one text for every ``CONTRAST`` of
those; of several such places the one with the clearest contrast is taken.  The valley
reaches down as long as that holds, and its middle is the cutoff.  A measure whose texts thin
out without a valley rejects nothing; there is no fixed cutoff and no floor.  A group of under
``MIN_GROUP`` judged texts, or without a valley, takes the cutoff of its language's merged sketch, and on the
same terms that of all texts.
Groups are few beside texts: they are broadcast if at most
``BROADCAST_GROUPS``, else joined with each group's texts dealt over ``SALTS`` tasks.

Null and empty texts have no words and fail the base rules.  A null language or source is
a group of its own.  Repeated rows count each.  Very long texts are measured whole.  Extra
columns are kept, unless named (in any case) like a result; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import _text as T

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 1_000
VALLEY, CONTRAST = 5, 25
LEAST_PERCENT, MOST_PERCENT = 3, 25
MEASURES = ("symbols", "repeats", "lines", "length")
BROADCAST_GROUPS = 100_000
SALTS = 64
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measures(docs: DataFrame) -> DataFrame:
    """The columns of docs, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    base = docs.select(*T.columns(docs, MADE))
    x = T.unused(base)
    c = lambda name: F.col(x + name)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    bare = F.replace(text, F.lit(" "), F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(space), F.lit(""))
    rest = text
    for s in SYMBOLS:
        rest = F.replace(rest, F.lit(s), F.lit(""))
    out = base.withColumn(x + "words", words).withColumn(x + "lines", lines)
    out = out.withColumn("n_words", F.size(x + "words").cast("long")).withColumn("word_chars", F.char_length(bare).cast("long"))
    out = out.withColumn("n_symbols", (F.char_length(text) - F.char_length(rest)).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size(x + "lines") - F.size(F.array_distinct(x + "lines"))).cast("long")).drop(x + "lines")
    # hash of each 3-word window (a sum of the words' own hashes, each placed by a multiplier)
    out = out.withColumn(x + "h", F.transform(x + "words", lambda w: F.xxhash64(w))).drop(x + "words")
    many = F.greatest(F.size(x + "h") - 2, F.lit(0))
    pairs = F.zip_with(F.slice(c("h"), 1, many), F.slice(c("h"), 2, many), lambda a, b: F.xxhash64(a, b))
    window = F.when(F.size(x + "h") >= 3, F.zip_with(pairs, F.slice(c("h"), 3, many), lambda ab, d: F.xxhash64(ab, d))).otherwise(F.array().cast("array<long>"))
    out = out.withColumn(x + "w", window).drop(x + "h")
    # windows with an equal one, by sorting (hash, place) and looking at neighbours
    placed = F.when(F.size(F.array_distinct(x + "w")) < F.size(x + "w"), F.sort_array(F.transform(x + "w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    out = out.withColumn(x + "s", placed).drop(x + "w")
    twice = F.filter(x + "s", lambda s, k: (s["h"] == F.get(x + "s", k - 1)["h"]) | (s["h"] == F.get(x + "s", k + 1)["h"]))
    out = out.withColumn(x + "p", F.array_sort(F.transform(twice, lambda s: s["i"]))).drop(x + "s")
    covered = F.aggregate(x + "p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])
    out = out.withColumn("n_repeat_words", covered).drop(x + "p")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number: itself below 16, then 16 buckets to each doubling, found
    from the number of binary digits, so that it is exact."""
    digits = F.char_length(F.bin(value))
    return F.when(value < 16, value).otherwise((digits - 5) * 16 + value / F.pow(F.lit(2.0), digits - 5)).cast("long")


def _per_mille() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    div = lambda a, b: F.floor(a * 1000 / b).cast("long")
    return [div(F.col("n_symbols"), chars), div(F.col("n_repeat_words"), words), div(F.col("n_dup_lines"), words), div(F.col("word_chars"), words)]


def thresholds(sketch: DataFrame, least: int = MIN_GROUP) -> DataFrame:
    """l, s, t0 to t3: the last bucket that each group allows, null if it allows all. sketch: l, s, m, b, n."""
    one = sketch.groupBy("l", "s", "m", "b").agg(F.sum("n").alias("n"))
    two = one.groupBy("l", "m", "b").agg(F.sum("n").alias("n")).withColumn("s", F.lit(""))
    all_ = two.groupBy("m", "b").agg(F.sum("n").alias("n")).withColumns({"l": F.lit(""), "s": F.lit("")})
    levels = [x.withColumn("level", F.lit(k)) for k, x in enumerate((one, two, all_))]
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    group = Window.partitionBy("level", "l", "s", "m")  # a sketch's buckets, some hundreds at most
    under = F.coalesce(F.sum("n").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = merged.withColumns({"total": F.sum("n").over(group), "under": under, "near": F.coalesce(F.sum("n").over(group.orderBy("b").rangeBetween(-VALLEY, -1)), F.lit(0))})
    above = F.col("total") - F.col("under")
    begins = (100 * above >= LEAST_PERCENT * F.col("total")) & (100 * above <= MOST_PERCENT * F.col("total")) & (CONTRAST * (F.col("near") + 1) <= above)
    clearest = F.min(F.when(begins, F.struct((CONTRAST * F.col("near") - above).alias("score"), F.col("b").alias("b"), F.col("under").alias("under"), above.alias("above")))).over(group)
    ranked = ranked.withColumn("top", clearest)
    # the highest bucket with which what lies below the top would be too much for a valley
    bottom = F.max(F.when((F.col("b") < F.col("top.b")) & (CONTRAST * (F.col("top.under") - F.col("under")) > F.col("top.above")), F.col("b")))
    found = ranked.groupBy("level", "l", "s", "m").agg(F.max("total").alias("total"), F.max("top.b").alias("b"), bottom.alias("a"))
    cut = F.floor((F.col("a") + F.col("b")) / 2)
    wide = found.groupBy("level", "l", "s").agg(F.max("total").alias("total"), F.array(*(F.max(F.when(F.col("m") == k, cut)) for k in range(len(MEASURES)))).alias("t"))
    own, lang, every = (wide.where(F.col("level") == k) for k in range(3))
    lang = lang.select("l", F.col("total").alias("total_l"), F.col("t").alias("t_l"))
    every = every.select(F.col("t").alias("t_all"))  # one row
    picked = own.join(lang, "l").crossJoin(F.broadcast(every))
    t = lambda k: F.coalesce(F.when(F.col("total") >= least, F.get("t", k)), F.when(F.col("total_l") >= least, F.get("t_l", k)), F.get("t_all", k))
    return picked.select("l", "s", *(t(F.lit(k)).alias(f"t{k}") for k in range(len(MEASURES))))


def judge(measured: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Adds kept: base rules passed, and no measure beyond its group's cutoff."""
    base = measured.select(*T.columns(measured, ("kept",)))
    x = T.unused(base)
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("lang", "source")]
    rated = base.withColumns({f"{x}b{k}": bucket(v) for k, v in enumerate(_per_mille())} | {x + "l": group[0], x + "s": group[1]})
    counted = rated.where("not base_failed").select(F.col(x + "l").alias("l"), F.col(x + "s").alias("s"), F.posexplode(F.array(*(f"{x}b{k}" for k in range(len(MEASURES))))).alias("m", "b"))
    sketch = counted.groupBy("l", "s", "m", "b").agg(F.count("*").alias("n"))
    cut = T.materialize(thresholds(sketch), "thresholds").select(F.col("l").alias(x + "gl"), F.col("s").alias(x + "gs"), *(F.col(f"t{k}").alias(f"{x}t{k}") for k in range(len(MEASURES))))
    on = (F.col(x + "l") == F.col(x + "gl")) & (F.col(x + "s") == F.col(x + "gs"))
    if cut.limit(broadcast_groups + 1).count() <= broadcast_groups:
        cut = F.broadcast(cut)
    else:  # a hot group's texts are dealt over SALTS keys, each of which has the group's cutoffs
        rated = rated.withColumn(x + "salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_repeat_words"), F.lit(SALTS)))
        cut = cut.withColumn(x + "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = on & (F.col(x + "salt") == F.col(x + "part"))
    beyond = [F.coalesce(F.col(f"{x}b{k}") > F.col(f"{x}t{k}"), F.lit(False)) for k in range(len(MEASURES))]
    fails = beyond[0] | beyond[1] | beyond[2] | beyond[3]
    return rated.join(cut, on, "left").select(*T.columns(base), (~F.col("base_failed") & ~fails).alias("kept"))
