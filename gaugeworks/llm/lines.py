"""Operator 4: line dedup by a deletion-neighbourhood join, in DataFrame functions only.

The edit distance counts words put in, left out or changed. Lines of `edit_words` words and more are held against
a bound of 1. Shorter ones have to be equal as they are written, blanks and carriage returns included: one word of few
is what such a line says ("Page 3", "Page 4"), and with fewer than five the similarity would be below 0.8. `edit_words`
1 holds all lines against the bound. A line goes if an earlier one (by doc_id, then place in the text) is within the bound of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored

#: Shorter lines have to be equal.
WORDS_FOR_EDITS = 8


def _words(line: Column) -> Column:
    """Words of a line that has some. Blanks other than single spaces between words are rare: only then are they looked for."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | line.rlike("[\\t\\x0b\\f\\r]")
    return F.split(F.when(odd, F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " "))).otherwise(line), " ")


def _half(n: Column) -> Column:
    """h for lines of n words: at most half of them, in steps that grow with the length, so that most lines share it with those of one word less."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(0)) + 0.5)) - 2))
    return (F.floor(n / (2 * step)) * step).cast("int")


def with_halves(rows: DataFrame, edit_words: int) -> DataFrame:
    """`rows` (w, n) with `halves`: digests of the first and of the last h words, which one edit can't both reach.

    A line at a step has the digests for its own h and for that of one word less.
    """
    part = lambda h, side: F.xxhash64(h, F.lit(side), F.concat_ws(" ", F.slice("w", F.lit(1) if side == 0 else F.col("n") - h + 1, h)))
    keys = lambda h: [part(F.col(h), 0), part(F.col(h), 1)]
    none = F.array().cast("array<long>")
    both = F.when(F.col("n") < edit_words, none).when(F.col("_h1") == F.col("_h0"), F.array(*keys("_h1"))).otherwise(F.array(*keys("_h1"), *keys("_h0")))
    # columns of their own: one method for all of it would be too long for the compiler
    return rows.withColumn("_h1", _half(F.col("n"))).withColumn("_h0", _half(F.col("n") - 1)).withColumn("halves", both).drop("_h1", "_h0")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one word apart: their common beginning and end cover all words but one."""
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
    run = lambda x, y: F.when(same(x, y) == 0, F.greatest(F.size(x), F.size(y)).cast("long")).otherwise(same(x, y) - 1)
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (run(a, b) + run(F.reverse(a), F.reverse(b)) >= longer - 1)


def repeated_lines(docs: DataFrame, edit_words: int = WORDS_FOR_EDITS) -> DataFrame:
    """_d, _h (doc_id and text digest of a row) and _gone: the places of the lines to leave out. Rows that keep all lines are not listed.

    Lines are what newlines part; blank ones are always kept and never compared.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").alias("_d"), F.xxhash64(text).alias("_h"), text.alias("_t"))
    lines = base.select("_d", "_h", F.posexplode(F.split("_t", "\n", -1)).alias("_p", "line")).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    words = lines.withColumn("w", _words(F.col("line"))).withColumn("n", F.size("w"))
    places = stored(with_halves(words, edit_words).select("_d", "_h", "_p", F.unhex(F.md5("line")).alias("id"), "n", "halves"), "places")

    # A line is known by where it first stands
    firsts = places.groupBy("id").agg(F.min(F.struct("_d", "_h", "_p", "n", "halves")).alias("f"), F.count("*").alias("c"))
    firsts = stored(firsts.select("id", "c", F.struct("f._d", "f._h", "f._p").alias("at"), "f.n", "f.halves"), "firsts")

    # A line that shares neither half with another has no partner within one edit; others know of what lengths theirs can be
    halves = firsts.select("at", "n", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).where("c > 1")
    chosen = halves.join(shared, "half").groupBy("at").agg(F.bool_or(F.expr("low = high or c > 2")).alias("same"), F.bool_or(F.expr("low < n")).alias("shorter"), F.bool_or(F.expr("high > n")).alias("longer"))
    wanted = chosen.groupBy(F.col("at._d").alias("_cd"), F.col("at._h").alias("_ch")).agg(F.collect_list(F.struct(F.col("at._p").alias("p"), "same", "shorter", "longer")).alias("lines"))
    # a row has a few bytes for each of its lines, far less than its text: a hash join spares sorting the texts
    texts = base.join(wanted.hint("shuffle_hash"), F.col("_d").eqNullSafe(F.col("_cd")) & (F.col("_h") == F.col("_ch")))
    texts = texts.withColumn("all", F.split("_t", "\n", -1)).select("_d", "_h", F.explode("lines").alias("l"), "all")
    texts = texts.select(F.struct("_d", "_h", F.col("l.p").alias("_p")).alias("at"), "l.same", "l.shorter", "l.longer", _words(F.element_at("all", F.col("l.p") + 1)).alias("w"))
    texts = stored(texts.withColumn("n", F.size("w")).dropDuplicates(["at"]), "compared")

    # Deletion neighbourhood: the digest of a line without word i is the digest of what is before it and, moved up, of what is after it.
    # With the digests of words 0..i in their places (x) and moved up (y), that is x(0..i-1) ^ y(all) ^ y(0..i).
    folded = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))
    whole = folded(F.transform("w", lambda w, i: F.xxhash64(w, i)))
    moved = folded(F.transform("w", lambda w, i: F.xxhash64(w, i - 1)))
    # lines are dealt out before they are taken apart, so that the running digests need no shuffle of words
    one = texts.where("same or shorter").repartition("at").withColumn("moved", moved).select("at", "n", "same", "shorter", "moved", F.posexplode("w").alias("i", "word"))
    upto = Window.partitionBy("at").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = F.xxhash64("word", "i"), F.xxhash64(F.col("word"), F.col("i") - 1)
    one = one.select("at", "n", "same", "shorter", "moved", "i", x.alias("x"), y.alias("y"))
    v = F.bit_xor(F.col("x").bitwiseXOR(F.col("y"))).over(upto).bitwiseXOR(F.col("x")).bitwiseXOR(F.col("moved"))
    variants = one.select("at", "n", "same", "shorter", "i", v.alias("v"))
    # role 0: a line without word i; 1: a line with a word less; 2: a line as it is
    roles = F.array_compact(F.array(F.when(F.col("same"), F.struct(F.xxhash64("n", "i", "v").alias("k"), F.lit(0).alias("role"))), F.when(F.col("shorter"), F.struct(F.xxhash64(F.col("n") - 1, F.lit(-1), "v").alias("k"), F.lit(1).alias("role")))))
    keyed = variants.select("at", F.explode(roles).alias("r")).select("at", "r.k", "r.role")
    keyed = stored(keyed.union(texts.where("longer").select("at", F.xxhash64("n", F.lit(-1), whole), F.lit(2))), "variants")
    # few keys are met by two lines: the others go before anything is compared
    met = keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    keyed = stored(keyed.join(met, "k"), "met")
    mate = lambda r: F.min(F.when(F.col("role") == r, F.col("at")))
    mates = keyed.groupBy("k").agg(mate(0).alias("m0"), mate(1).alias("m1"), mate(2).alias("m2"))
    # Lines changed in the same word all meet the earliest of them; a line and those with a word more meet each other
    earlier = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = keyed.join(mates, "k").select("at", earlier.alias("by")).where("by < at").distinct()
    a, b = texts.select("at", F.col("w").alias("wa")), texts.select(F.col("at").alias("by"), F.col("w").alias("wb"))
    near = stored(pairs.join(a, "at").join(b, "by").where(within_one_edit(F.col("wa"), F.col("wb"))).select("at").distinct(), "near")

    # What goes: every place of a repeated line but its first, and the first ones that are near an earlier line, with their repeats
    near = firsts.select("id", "c", "at").join(near, "at")
    later = firsts.where("c > 1").select("id", "at")
    gone = places.select("_d", "_h", "_p", "id").join(later, "id").where(F.struct("_d", "_h", "_p") != F.col("at")).select("_d", "_h", "_p")
    gone = gone.union(near.select("at.*"))
    return gone.groupBy("_d", "_h").agg(F.collect_set("_p").alias("_gone"))


def deduplicated_lines(docs: DataFrame, drop_repeats: bool = False, edit_words: int = WORDS_FOR_EDITS) -> DataFrame:
    """`docs` with each text reduced to the lines that no earlier line is within the edit bound of.

    A null text stays null, an empty one empty. A text whose lines all go becomes null, or its row goes with
    `drop_repeats`. Rows equal in doc_id and text keep the same lines. Null doc_ids come first.
    Other columns are left as they are, n_chars too, whatever their names. An empty table gives none.
    """
    gone = repeated_lines(docs, edit_words)
    text = F.col("text").cast("string")
    # the caller's columns travel as one, so that none is taken for one of ours
    rows = docs.select(F.col("doc_id").alias("_rd"), F.xxhash64(text).alias("_rh"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(gone.hint("shuffle_hash"), F.col("_rd").eqNullSafe(F.col("_d")) & (F.col("_rh") == F.col("_h")), "left")
    # the lines are bound as one value, so that they are parted once for each text
    left = F.transform(
        F.array(F.split(F.col("row.text").cast("string"), "\n", -1)),
        lambda all_: F.transform(F.array(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("_gone"))), lambda kept: F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda p: F.element_at(all_, p + 1)), "\n")))[0],
    )[0]
    out = joined.withColumn("left", F.when(F.col("_gone").isNull(), F.col("row.text").cast("string")).otherwise(left))
    if drop_repeats:
        out = out.where(F.col("left").isNotNull() | F.col("row.text").isNull())
    return out.select(*[(F.col("left") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
