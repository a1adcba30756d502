"""Line dedup as an exact set-similarity join, in DataFrame functions only.

A line matches another when the Jaccard similarity of their word sets is at least 0.8. Lines are in
the order of doc_id, then line number; every line that matches an earlier line, kept or not, is
removed, so the first of matching lines stays. Every line that has a word takes part.

1. Word counts over all texts are summed in a fixed number of hash buckets; their logarithm is the
   rarity level of a word. (level, hash) is one total order of words, whatever shares a bucket.
2. Lines with the same word set form a class, named by its first line. A class keeps its rarest
   words, the prefix: sets of n and m words can only reach the threshold if their prefixes of
   n - ceil(0.8 n) + 1 words meet. Sets of up to ``ALONE`` words only match equal sets: the class
   settles them, and they have no prefix.
3. Classes of families, that is ``FAMILY`` or more with the same two neighbouring prefix words, are
   first held against the earliest document's; those that match it are no longer open. All open
   classes then meet every class with which they share a prefix word: both are candidates if their lengths fit (m >= 0.8 n), if what can
   still be shared from the meeting positions on reaches the needed overlap, and if their parity
   sketches (64 bits, 128 of large sets, each word flips one) differ in no more bits than their sets
   may differ in words. The join's keys hold a class of lengths besides the word, so that nearly only
   sets whose lengths fit are held together; the smaller set is put into every class its partners may have.
4. Candidates are verified on their words. The lines that this needs are picked out by a bitmap of
   fixed size before anything is shuffled.

Only whether a class has an earlier match decides, so not all pairs are needed, and pairs are listed
for open classes only. A word that at most ``SMALL`` open classes have in their prefix gives all
their pairs: a bounded number for each row. Where more share it, each is held against the earliest
of them, which settles families of copies. What that leaves is split by a second shared word: sets
that reach the threshold share at least two words of prefixes that are longer by one, so pairs of
words are grouped like single ones, and three words after them. Only groups that are still large
after ``DEPTH`` words are held against all their earlier members. No pair is left out at any step, and every step's rows grow with the lines.

Words are told apart by 64 bits of hash up to step 3 (54 where they are sorted), sets of more than
``ALONE`` words by 118 bits in step 2; step 4 compares the words themselves.
"""

from __future__ import annotations

from functools import reduce
from math import floor, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop, let, store

#: Rarity levels for each doubling of a word's count; below 128 for counts under 2^31, so that the JVM has one object for each level.
STEPS = 4
#: Hash buckets of the word counts, a power of two: a table of fixed size, however many words there are.
BUCKETS = 1 << 16
#: White space at the ends of lines.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of the bitmap that picks the lines to verify: at most BITMAP / 64 rows are broadcast.
BITMAP = 1 << 23
#: Sets of at most so many words reach the threshold with equal sets only: 3 of 4 words are less than 4 of 5.
ALONE = 3
#: Sets of more words have a parity sketch of 128 bits; of fewer, 64 tell nearly all apart.
WIDE = 80
#: Greatest ratio of two lengths in a class: a factor of 5/4 twice, so that about half of the smaller sets are in two classes.
SPAN = 25 / 16
#: Jaccard threshold as a fraction, so that all arithmetic is in integers.
NUM, DEN = 4, 5
#: Open classes that may share a signature before it gets another word.
SMALL = 1024
#: Parts in which signatures are shuffled and joined one after the other, so that only one part's shuffle is on disk.
SLICES = 2
#: Parts of a large group that are held against its few open members.
SALTS = 16
#: Most words of a signature.
DEPTH = 3
#: From so many classes on, those that share two neighbouring words of their prefixes are held against their earliest document first.
FAMILY = 8
#: Pairs of neighbouring words of a prefix that tell families.
LINKS = 9

LINE = ("d", "l", "n", "odd", "every")
SIDE = (*LINE, "i")
PAIR = ("ad", "al", "bd", "bl", "both")


def line_key(number: Column, line: Column) -> Column:
    """Line number and, below it, 32 bits of the line's hash: rows that share a doc_id have lines of their own."""
    return F.call_function("shiftleft", number.cast("bigint"), F.lit(32)).bitwiseOR(F.xxhash64(line).bitwiseAND(F.lit((1 << 32) - 1)))


def has_rare(text: Column) -> Column:
    """Whether a text has white space other than spaces and line ends; few have, and the others can be split at single characters."""
    return reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"])


def bare(line: Column, rare: Column) -> Column:
    """A line without white space at its ends; ``rare`` is ``has_rare`` of its text."""
    return F.when(rare, F.trim(line, F.lit(BLANKS))).otherwise(F.trim(line))


def line_keys(text: Column) -> Column:
    """The keys of a text's lines as an array, null where a line has no word."""
    def keys(trim) -> Column:
        return F.transform(F.split(text, "\n", -1), lambda x, i: F.when(trim(x) != "", line_key(i, trim(x))))

    return F.when(has_rare(text), keys(lambda x: F.trim(x, F.lit(BLANKS)))).otherwise(keys(F.trim))


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(d, l, line)``: the lines with a word of every document with an id, l their key, without white space at their ends."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("d"), text.alias("text"), has_rare(text).alias("rare"))
    out = some.select("d", "rare", F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))
    out = out.select("d", "number", bare(F.col("line"), F.col("rare")).alias("line")).where("line <> ''")
    return out.select("d", line_key(F.col("number"), F.col("line")).alias("l"), "line")


def line_words(line: Column) -> Column:
    """Words of a line that has no white space at its ends; single spaces, the usual case, need no pattern."""
    return F.when(F.contains(line, F.lit("  ")) | has_rare(line), F.split(line, f"[{SPACE}]+")).otherwise(F.split(line, " "))


def rarity_levels(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """By hash bucket, ``STEPS`` times the binary logarithm of its word count.

    The counts cover every word of every text; only ``buckets`` numbers come to the driver.
    """
    text = F.col(text_col).cast("string")
    words = F.when(has_rare(text), F.split(text, f"[{SPACE}]+")).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))
    word = docs.select(F.explode(words).alias("w")).where("w <> ''")
    bucket = word.select(F.xxhash64("w").bitwiseAND(F.lit(buckets - 1)).alias("b"))
    counts = bucket.groupBy("b").agg(F.floor(STEPS * F.log2(F.count(F.lit(1)))).cast("int").alias("v")).toPandas()
    level = dict(zip(counts["b"].tolist(), counts["v"].tolist()))
    return [level.get(i, 0) for i in range(buckets)]


def table(numbers: list[int]) -> Column:
    """An array literal of many numbers, folded once when the query is planned."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def shift(n: Column) -> Column:
    """1 shifted left by the low six bits of a long."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.bitwiseAND(F.lit(63)).cast("int"))


def least_sig(count: int) -> int:
    """A prefix word below this number is in fewer than ``count`` lines: its bucket counts no fewer words. One level is left for rounding."""
    return max(0, floor(STEPS * log2(count)) - 1) << 54


def by_rarity(line: Column, levels: list[int]) -> Column:
    """The distinct words of a line as longs in the order of rarity: level in the top bits, then 54 bits of hash."""
    known, mask = table(levels), len(levels) - 1
    level = lambda x: F.coalesce(F.get(known, x.bitwiseAND(F.lit(mask)).cast("int")), F.lit(0).cast("bigint"))
    at = lambda x: F.call_function("shiftleft", level(x), F.lit(54))
    hashes = F.array_distinct(F.transform(line_words(line), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda x: at(x).bitwiseOR(x.bitwiseAND(F.lit((1 << 54) - 1)))))


def prefix_length(n: Column) -> Column:
    return (n - F.floor((n * NUM + DEN - 1) / DEN) + 1).cast("int")


def classes(lines: DataFrame, levels: list[int]) -> DataFrame:
    """``(d, l, n, odd, every, prefix)``: the first line of each word set, with a prefix that is longer by ``DEPTH`` - 1."""
    made = lines.select("d", "l", "line", by_rarity(F.col("line"), levels).alias("w"))
    alone = F.size("w") <= ALONE
    words = F.xxhash64(F.lit(9), F.array_sort(F.array_distinct(line_words(F.col("line")))))
    parity = lambda w: F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(shift(x)))
    half = F.filter("w", lambda x: x.bitwiseAND(F.lit(64)) != 0)
    odd = F.when(F.size("w") > WIDE, parity(half)).otherwise(F.lit(0).cast("bigint"))
    length = F.when(alone, 0).otherwise(prefix_length(F.size("w")) + DEPTH - 1)
    keyed = made.select(
        F.xxhash64("w").alias("s"), F.when(alone, words).otherwise(F.xxhash64(F.lit(7), "w")).alias("t"),
        F.size("w").alias("n"), odd.alias("odd"), parity(F.col("w")).alias("every"), "d", "l", F.slice("w", F.lit(1), length).alias("prefix"),
    )
    first = keyed.groupBy("s", "t", "n").agg(F.min(F.struct("d", "l", "odd", "every", "prefix")).alias("m"))
    return first.select("m.d", "m.l", "n", "m.odd", "m.every", "m.prefix")


def _before(x: str, y: str) -> Column:
    c = F.col
    return (c(x + "d") < c(y + "d")) | ((c(x + "d") == c(y + "d")) & (c(x + "l") < c(y + "l")))


def close(short: DataFrame, long: DataFrame, depth: int) -> DataFrame:
    """``PAIR`` of rows ``short`` and ``long`` that share a signature and pass the length, positional and parity filters.

    The sets of ``short`` are not larger; only pairs whose later class is open are wanted.
    """
    c, names = F.col, [*SIDE, "open"]
    s, t = (x.select("sig", *[c(n).alias(k + n) for n in names]) for x, k in ((short, "s"), (long, "t")))
    both = c("sn") + c("tn")
    left = F.least(c("sn") - c("si"), c("tn") - c("ti")) + (depth - 1)  # i is the place of the last word; J >= 4/5: 9 * overlap >= 4 * (n + m)
    odd, every = c("sodd").bitwiseXOR(c("todd")), c("severy").bitwiseXOR(c("tevery"))
    apart = F.when(c("sn") > WIDE, F.bit_count(odd) + F.bit_count(odd.bitwiseXOR(every))).otherwise(F.bit_count(every))  # 9 * words in one set only <= n + m
    first = _before("s", "t")
    fits = (c("sn") <= c("tn")) & (c("sn") * DEN >= c("tn") * NUM) & (apart * (NUM + DEN) <= both * (DEN - NUM)) & (left * (NUM + DEN) >= both * NUM)
    once = (c("sn") < c("tn")) | first
    pick = lambda n: (F.when(first, c("s" + n)).otherwise(c("t" + n)), F.when(first, c("t" + n)).otherwise(c("s" + n)))
    (ad, bd), (al, bl), (_, open_) = pick("d"), pick("l"), pick("open")
    same = (c("sd") == c("td")) & (c("sl") == c("tl"))
    out = s.join(t, "sig").where(fits & once & ~same & open_)
    return out.select(ad.alias("ad"), al.alias("al"), bd.alias("bd"), bl.alias("bl"), both.alias("both"))


def length_class(n: Column) -> Column:
    """Lengths in classes that grow with them; never falls as n grows."""
    return F.floor(F.log(n) / log(SPAN)).cast("int")


def colliding(items: DataFrame, depth: int) -> list[DataFrame]:
    """Candidates among ``items``, as stored tables of one slice of signatures each.

    Of two sets the smaller one can't share less than 8/9 of its words, so its prefix is shorter. It
    meets the length classes of all lengths from its own to 5/4 of it, which are two at most; with the
    sets of the later one, all larger, it shares even more.
    """
    n, i = F.col("n"), F.col("i")
    reach = lambda m: n - F.floor(((n + m) * NUM + NUM + DEN - 1) / (NUM + DEN)) + depth
    own, last = length_class(n), length_class(F.floor(n * DEN / NUM))
    later = (last > own) & (i < reach(F.floor(F.pow(F.lit(SPAN), last))))
    met = F.explode(F.when(later, F.array(own, last)).otherwise(F.array(own)))
    classed = lambda x, k: x.withColumn("class", k).withColumn("sig", F.xxhash64("sig", "class")).drop("class")
    parts = [items.where(F.pmod("sig", F.lit(SLICES)) == k) for k in range(SLICES)]
    return [store(close(classed(x.where(i < reach(n)), met), classed(x, own), depth).distinct()) for x in parts]


def signatures(reps: DataFrame) -> DataFrame:
    """One row for each class and word of its prefix; ``reps`` tells which classes are open."""
    own = F.slice("prefix", F.lit(1), prefix_length(F.col("n")))
    out = reps.where(f"n > {ALONE}").select(*LINE, "open", F.posexplode(own).alias("i", "sig"))
    return out.select("sig", *SIDE, "open")


def longer(items: DataFrame, reps: DataFrame, depth: int) -> DataFrame:
    """Signatures with one more word, the last of ``depth``: any later word of a prefix that is longer by ``depth`` - 1."""
    more = F.slice("prefix", F.col("i") + 2, F.greatest(prefix_length(F.col("n")) + (depth - 2) - F.col("i"), F.lit(0)))
    out = items.join(reps.select("d", "l", "prefix"), ["d", "l"]).select("sig", *SIDE, "open", F.posexplode(more).alias("j", "w"))
    return out.select(F.xxhash64("sig", "w").alias("sig"), *LINE, (F.col("i") + 1 + F.col("j")).alias("i"), "open")


def marked(rows: DataFrame, needed: DataFrame, keys: list[str], hit: bool = True) -> DataFrame:
    """The rows whose ``keys`` may be in ``needed``, or all others, by a bitmap of fixed size that is broadcast."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(BITMAP))
    bits = needed.select(F.shiftright(bit, 6).alias("_at"), shift(bit).alias("on")).groupBy("_at").agg(F.bit_or("on").alias("_bits"))
    some = rows.withColumns({"_at": F.shiftright(bit, 6), "_on": shift(bit)}).join(F.broadcast(bits), "_at", "inner" if hit else "left")
    on = F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(F.col("_on")) != 0
    return some.where(on if hit else ~on).drop("_at", "_on", "_bits")


def picked(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``(d, l, line)`` of the lines whose (d, l) is in ``needed``, once: documents and lines are first picked by bitmaps.

    An inner join, as Spark would move a semi join below the second bitmap.
    """
    some = marked(docs.withColumn("d", F.col("doc_id").cast("long")), needed, ["d"]).drop("d")
    return marked(lines_of(some), needed, ["d", "l"]).join(needed, ["d", "l"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(d, l)`` of the later classes of pairs whose words reach the threshold; ``texts`` has both sides' lines."""
    a = texts.select(F.col("d").alias("ad"), F.col("l").alias("al"), F.col("line").alias("aline"))
    b = texts.select(F.col("d").alias("bd"), F.col("l").alias("bl"), F.col("line").alias("bline"))
    shared = F.size(F.array_intersect(line_words(F.col("aline")), line_words(F.col("bline"))))
    both = pairs.join(a, ["ad", "al"]).join(b, ["bd", "bl"])
    return both.where(shared * (NUM + DEN) >= F.col("both") * NUM).select(F.col("bd").alias("d"), F.col("bl").alias("l")).distinct()


def fetched(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines of both sides of ``pairs``, as a stored table."""
    sides = [pairs.select(F.col(s + "d").alias("d"), F.col(s + "l").alias("l")).distinct() for s in "ab"]
    needed = store(sides[0].unionByName(sides[1]).distinct())
    texts = store(picked(docs, needed))
    drop(needed)
    return texts


def settled(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``(d, l)`` of the later classes that match any class they are paired with.

    Each is first verified with the earliest of its candidates, which nearly always decides; its
    other pairs are verified only where that one failed. The lines of all are fetched in one pass over
    the texts: a line is fetched once, however many pairs it has.
    """
    first = store(pairs.groupBy("bd", "bl").agg(F.min(F.struct("ad", "al", "both")).alias("m")).select("m.ad", "m.al", "bd", "bl", "m.both"))
    texts = fetched(pairs, docs)
    done = store(verified(first, texts))
    failed = first.join(done.select(F.col("d").alias("bd"), F.col("l").alias("bl")), ["bd", "bl"], "left_anti")
    failed = failed.select("bd", "bl", F.col("ad").alias("fd"), F.col("al").alias("fl"))
    late = store(pairs.join(failed, ["bd", "bl"]).where("ad <> fd or al <> fl").select(*PAIR))
    if late.isEmpty():
        drop(texts, first, late)
        return done
    out = store(done.unionByName(verified(late, texts)))
    drop(texts, done, first, late)
    return out


def leaders(reps: DataFrame) -> DataFrame:
    """``PAIR`` of classes and the first line with the same two neighbouring prefix words in the group's earliest document.

    Near copies of one line share most such words, so one pair each settles nearly all of a family,
    whatever its size. Links whose hash is odd are left out, the same ones in every line, which halves
    the rows. The pairs only save others: what they don't settle stays open.
    """
    at = lambda i: F.get("prefix", F.lit(i))
    links = F.array(*[F.when(at(i + 1).isNotNull(), F.xxhash64(at(i), at(i + 1))) for i in range(LINKS)])
    keyed = reps.where(f"n > {ALONE}").select(*LINE, F.explode(links).alias("sig")).where("sig & 1 = 0")
    groups = store(keyed.groupBy("sig").agg(F.count(F.lit(1)).alias("o"), F.min("d").alias("d")).where(f"o >= {FAMILY}").select("sig", "d"))
    rows = store(marked(keyed, groups, ["sig"]).withColumns({"i": F.lit(0), "open": F.lit(True)}))
    first = store(rows.join(groups, ["sig", "d"]).groupBy("sig").agg(F.min(F.struct(*SIDE)).alias("p")))
    pivots = first.select("sig", "p.*", F.lit(False).alias("open"))
    out = store(close(pivots, rows, 1).unionByName(close(rows, pivots, 1)).distinct())
    drop(groups, rows, first)
    return out


def opened(reps: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reps`` with whether each is open, that is not in ``gone``, and a stored table that the result reads."""
    few = marked(reps, gone, ["d", "l"]).join(gone.withColumn("gone", F.lit(True)), ["d", "l"], "left")
    few = store(few.withColumn("open", F.col("gone").isNull()).drop("gone"))
    rest = marked(reps, gone, ["d", "l"], hit=False).withColumn("open", F.lit(True))
    return rest.unionByName(few), few


def against_few(hot: DataFrame, depth: int) -> DataFrame:
    """Candidates of groups with few open members, whatever the size of the group: its members are dealt to salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    some = hot.where("open").withColumn("salt", salts).withColumn("sig", F.xxhash64("sig", "salt"))
    every = hot.withColumn("sig", F.xxhash64("sig", F.pmod(F.xxhash64("d", "l"), F.lit(SALTS)).cast("int")))
    return close(some, every, depth).unionByName(close(every, some, depth))


def matched(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``(d, l)`` of the classes in ``reps`` that match an earlier one."""
    led = leaders(reps)
    texts = fetched(led, docs)
    found = [store(verified(led, texts))]
    drop(led, texts)
    classed, few = opened(reps, found[0])
    items, parts, used = signatures(classed), [], [few]

    def settle() -> None:
        candidates = store(reduce(DataFrame.unionByName, parts).distinct())
        found.append(settled(candidates, docs))
        drop(candidates)
        parts.clear()

    for depth in range(1, DEPTH + 1):
        many = items.where(F.col("sig") >= least_sig(SMALL + 1)) if depth == 1 else items
        groups = many.groupBy("sig").agg(F.count_if("open").alias("o"))
        big = store(groups.where(f"o > {SMALL}").select("sig"))
        used.append(big)
        slices = colliding(items.join(big, "sig", "left_anti"), depth)
        parts += slices
        if big.isEmpty():
            break
        hot = store(items.join(big, "sig"))
        first = store(hot.groupBy("sig").agg(F.min(F.struct(*SIDE)).alias("p")))
        pivots = first.select("sig", "p.*", F.lit(False).alias("open"))
        parts += [close(pivots, hot.where("open"), depth), close(hot.where("open"), pivots, depth)]
        settle()
        drop(*slices)
        # What the earliest of a large group doesn't match is open still, and has all the group's earlier members to meet.
        gone = reduce(DataFrame.unionByName, found).select("d", "l", F.lit(True).alias("gone"))
        hot = hot.drop("open").join(gone, ["d", "l"], "left").withColumn("open", F.col("gone").isNull()).drop("gone")
        left = hot.where("open").join(first.select("sig", F.col("p.d").alias("pd"), F.col("p.l").alias("pl")), "sig")
        left = store(left.where("d <> pd or l <> pl").groupBy("sig").agg(F.count(F.lit(1)).alias("o")))
        used += [first, left]
        many = left.where(f"o > {SMALL}").select("sig")
        goes_on = depth < DEPTH and not many.isEmpty()
        few = left.where(f"o <= {SMALL}" if goes_on else "true").select("sig")
        parts.append(against_few(hot.join(few, "sig", "left_semi"), depth))
        if not goes_on:
            break
        items = longer(hot.join(many, "sig", "left_semi"), reps, depth + 1)
    settle()
    drop(*used)
    return reduce(DataFrame.unionByName, found)


def first_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(d, l)`` of the lines that stay."""
    docs = docs.select("doc_id", F.col(f"`{text_col}`").alias("text"))
    reps = store(classes(lines_of(docs), rarity_levels(docs)))
    return reps.select("d", "l").join(matched(reps, docs), ["d", "l"], "left_anti")


def with_gone(docs: DataFrame, own: list[Column], text_col: str) -> DataFrame:
    """Columns ``own`` of ``docs`` and ``_gone``, the numbers of the lines to remove in their order."""
    kept = first_lines(docs, text_col).groupBy("d").agg(F.collect_list("l").alias("_kept"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = F.when(F.col("doc_id").isNull(), F.array().cast("array<bigint>")).otherwise(line_keys(text))
    some = docs.select(*own, F.col("doc_id").cast("long").alias("_d"), keys.alias("_keys"))
    none = F.array(F.lit(None).cast("bigint"))  # the key of a line without a word
    gone = F.array_sort(F.array_except("_keys", F.coalesce(F.concat("_kept", none), none)))
    both = some.join(kept, F.col("_d") == F.col("d"), "left")
    return both.withColumn("_gone", F.transform(gone, lambda k: F.shiftright(k, 32).cast("int"))).drop("_keys", "_kept", "d", "_d")


def removed_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` for every row of ``docs``; removed lists line numbers, comma-joined.

    Lines count from 0 and include empty ones. A null text counts as empty. Rows with a null doc_id
    are not compared and lose nothing. Rows that repeat a doc_id keep lines of their own, in the
    order of line number; where both have the same line with the same number, it is one line. An
    empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = with_gone(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines")], text_col)
    return out.select("doc_id", "n_lines", F.size("_gone").cast("long").alias("n_removed"), F.array_join("_gone", ",").alias("removed"))


def without(text: Column, gone: Column) -> Column:
    """A text without the lines of the sorted numbers ``gone``: the stretches between them, so long texts take linear time."""
    def stretches(lines: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
        return F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1))

    return F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.flatten(let(F.split(text, "\n", -1), stretches)), "\n"))


def dedup(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with matching later lines taken out of the text; n_chars, where there is one, follows.

    Rows, ids and other columns stay; a document whose lines are all copies keeps an empty text. A
    null text stays null. Edge cases are as in ``removed_lines``.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    out = with_gone(docs, [row], text_col).select("_row.*", "_gone")
    text = without(F.col(f"`{text_col}`"), F.col("_gone"))
    out = out.withColumn(text_col, text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in names])


ORACLE_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text, len(string_split(coalesce(text, ''), chr(10))) as n_lines from documents),
x as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, n_lines)) as l from docs),
s as (select doc_id, l, list_distinct(regexp_extract_all(line, '[^ \t-\r]+')) as w from x),
e as (select * from s where len(w) >= 1),
c as (select list_sort(w) as w, min((doc_id, l)) as first from e group by list_sort(w)),
ci as (select row_number() over (order by first) as k, w, first, len(w) as n from c),
t as (select k, n, unnest(w) as word from ci),
o as (select a.k as a, b.k as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n
      from t a join t b on a.word = b.word and a.k < b.k and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4 group by a.k, b.k),
gone as (select distinct b as k from o where n * 9 >= (na + nb) * 4),
kept as (select ci.first[1] as doc_id, ci.first[2] as l from ci where k not in (select k from gone)),
r as (select e.doc_id, e.l from e anti join kept on kept.doc_id = e.doc_id and kept.l = e.l),
j as (select doc_id, count(*) as n, string_agg(cast(l as varchar), ',' order by l) as removed from r group by doc_id)
select docs.doc_id, cast(n_lines as bigint) as n_lines, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(removed, '') as removed
from docs left join j using (doc_id)
"""
