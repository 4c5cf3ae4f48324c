"""Spelling variants of a vocabulary by permuterm rotations.

A word of L letters, marked by a terminator, has L + 1 rotations.  Two words that differ by one
replaced letter have rotations that agree in all but the last letter, the edited one; a word's
whole rotation is the prefix of the rotation of each word with one letter more.  So rotations are
keyed by their first L letters, with the last one as an extra, and whole rotations by themselves:
all words within one edit of each other meet under a key.  A key's words differ in one letter at
one place, so a group is no larger than the alphabet, whatever the corpus.  Groups are scanned, and each word
gets its number of neighbours there and the best of them; no pairs are formed.

Rotations of words beyond `longest` letters would take space quadratic in the word.  These are
keyed by hashes of their rotations, found in one pass over prefix hashes, and the pairs that meet are
compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlake.plans.scratch import Scratch
from fernlake.plans.skew import dealt_anew

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"


def words(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of whole texts with A-Z lower-cased, as often as they occur.

    Of one in `every` (id, run), drawn by a checksum, one letter is deleted, so that spelling errors
    are known to be there.  A null id counts as an empty one there, a null text has no words.
    Words below `least_length` letters or `least_count` occurrences are left out.
    """
    # deletion only shortens, so shorter runs cannot become words
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % least_length), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    draw = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.withColumn("draw", draw)
    at = (F.col("draw") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("draw") % every == 0, less).otherwise(F.col("run"))
    out = rows.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least_count)


def _best(n: Column, word: Column) -> Column:
    """Orders neighbours: greatest n first, then the smallest word."""
    return F.struct((-n).alias("less"), word.alias("word"))


def _short_neighbours(vocab: DataFrame, longest: int) -> DataFrame:
    """(word, n_near, best) per group of rotations, for words of at most `longest` letters among themselves."""
    short = vocab.where(F.length("word") <= longest)
    size = F.length("word")
    rotated = lambda skip: F.transform(
        F.sequence(F.lit(1), size + (0 if skip else 1)),
        lambda i: F.struct(
            F.concat(F.substring(F.col("word"), i + (1 if skip else 0), size), F.lit(END), F.substring(F.col("word"), F.lit(1), i - 1)).alias("key"),
            (F.substring(F.col("word"), i, F.lit(1)) if skip else F.lit("")).alias("last"),
            # of a run of equal letters only the first one's deletion counts, so that an indel is met once
            (((i == 1) | (F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("word"), i - 1, F.lit(1)))) if skip else F.lit(False)).alias("first"),
        ),
    )
    rows = short.select("n", F.inline(F.concat(rotated(True), rotated(False))))
    group = rows.groupBy("key").agg(F.collect_list(F.struct("last", "n", "first")).alias("members")).where(F.size("members") > 1)
    # a key with the last letter put back before the terminator gives the word again
    group = group.withColumn("tail", F.substring_index("key", END, 1)).withColumn("head", F.substring_index("key", END, -1))
    member = F.transform("members", lambda m: F.struct(F.concat("head", m["last"], "tail").alias("word"), m["last"].alias("last"), m["n"].alias("n"), m["first"].alias("first")))
    group = group.select(member.alias("members"))
    near = lambda a, b: (a["last"] != b["last"]) & ((a["last"] != "") | b["first"]) & ((b["last"] != "") | a["first"])

    def seen(a):
        others = F.filter("members", lambda b: near(a, b))
        return F.struct(a["word"].alias("word"), F.size(others).cast("long").alias("n_near"), F.array_min(F.transform(others, lambda b: _best(b["n"], b["word"]))).alias("best"))

    return group.select(F.inline(F.transform("members", seen))).where("n_near > 0")


def _rotation_hashes(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of all keys of a word: of its L rotations without their last letter, then of the L + 1 whole ones."""
    u = np.uint64
    code = np.append(np.frombuffer(word.encode("utf-32-le"), "<u4").astype(u), u(ord(END)))
    n, out = len(code), []
    skip, whole = np.arange(1, n), np.arange(n)
    for base, factor in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xBF58476D1CE4E5B9, 0x9FB21C651E98DF25)):
        value = (code + u(1)) * u(factor)
        value ^= value >> u(29)
        power = np.cumprod(np.append(u(1), np.full(2 * n - 1, u(base))))
        back = np.cumprod(np.append(u(1), np.full(n - 1, u(pow(base, -1, 1 << 64)))))
        # a sum over a window of the word written twice, divided by the power at its start, depends on its letters alone
        total = np.append(u(0), np.cumsum(np.concatenate([value, value]) * power))
        h = np.concatenate([(total[skip + n - 1] - total[skip]) * back[skip], (total[whole + n] - total[whole]) * back[whole]])
        h ^= h >> u(31)
        h *= u(0xD6E8FEB86659FD93)
        out.append((h ^ (h >> u(32))).view(np.int64))
    return out[0], out[1]


def _keys_of_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key with the place of the letter it leaves out, from 1; null for whole rotations."""
    for batch in batches:
        for ref, word in zip(batch.column(0), batch.column(1), strict=True):
            a, b = _rotation_hashes(word.as_py())
            at, length = np.arange(1, len(a) + 1), len(word.as_py())
            for k in range(0, len(a), 1 << 16):
                m = slice(k, k + (1 << 16))
                columns = [pa.array(a[m]), pa.array(b[m]), pa.array([ref.as_py()] * len(a[m]), pa.string()), pa.array(at[m], mask=at[m] > length)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "word_id", "at"])


def _long_neighbours(vocab: DataFrame, longest: int) -> DataFrame:
    """(word, n_near, best) per pair in which a word has more than `longest` letters."""
    long = vocab.where(F.length("word") >= longest).withColumn("word_id", F.sha2(F.col("word").cast("binary"), 256))
    keys = long.select("word_id", "word").mapInArrow(_keys_of_long, "a long, b long, word_id string, at long")
    # a key's words differ in one letter at one place, or are one without it: no more of them than letters
    group = keys.groupBy("a", "b").agg(F.collect_list(F.struct("word_id", "at")).alias("members")).where(F.size("members") > 1)
    each = group.select("members", F.explode("members").alias("x"))
    pairs = each.select(F.col("x.word_id").alias("word_id"), F.col("x.at").alias("at"), F.explode("members").alias("y"))
    pairs = pairs.select("word_id", "at", F.col("y.word_id").alias("other_id"), F.col("y.at").alias("other_at")).where("word_id != other_id")
    mine = long.select("word_id", "word")
    theirs = long.select(F.col("word_id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = pairs.join(mine, "word_id").join(theirs, "other_id").where((F.length("word") > longest) | (F.length("other") > longest))
    less = lambda w, at: F.when(F.col(at).isNull(), F.col(w)).otherwise(F.concat(F.substring(F.col(w), F.lit(1), F.col(at).cast("int") - 1), F.substring(F.col(w), F.col(at).cast("int") + 1, F.length(w))))
    both = both.where(less("word", "at") == less("other", "other_at")).dropDuplicates(["word_id", "other_id"])
    return both.select("word", F.lit(1).cast("long").alias("n_near"), _best(F.col("other_n"), F.col("other")).alias("best"))


def neighbours(vocab: DataFrame, longest: int = 48) -> DataFrame:
    """(word, n_near, near, near_n) of each word with a near one: how many, and the best of them by n, then code points."""
    met = _short_neighbours(vocab, longest)
    if not vocab.where(F.length("word") > longest).limit(1).isEmpty():
        met = met.union(_long_neighbours(vocab, longest))
    out = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(vocab: DataFrame, ratio: int = 10, longest: int = 48) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of `vocab` (word, n), whose words are distinct.

    Two words are near if they differ by one inserted, deleted or replaced code point.  A word's form is its best near
    word if that is `ratio` times as frequent.  Forms are followed by doubling; since n grows by
    `ratio` at each step, a few rounds end it.  An empty table gives an empty result.
    """
    with Scratch(vocab.sparkSession) as scratch:
        vocab = scratch.keep(vocab.select("word", "n"), "vocabulary")
        near = scratch.keep(neighbours(vocab, longest), "near")
        rows = scratch.keep(vocab.join(near, "word", "left").withColumn("good", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))), "rows")
        link = scratch.keep(rows.where("good").select("word", F.col("near").alias("to")), "links")
        while True:
            ahead = dealt_anew(link.select(F.col("word").alias("to"), F.col("to").alias("beyond")), "to")
            new = scratch.keep(link.join(ahead, "to", "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "links")
            settled = new.where("moved").limit(1).isEmpty()
            link = new.select("word", "to")
            if settled:
                break
        out = rows.join(link, "word", "left")
        form = F.when(F.col("good"), F.col("near"))
        out = out.select("word", form.alias("form"), F.coalesce("to", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), F.col("near_n")).alias("form_n"))
        return scratch.keep(out, "variants", last=True)
