"""Spelling variants of words: a rare-first prefix filter on positional bigrams, and a check of each candidate.

One edit touches at most two bigrams of a word. So if the bigrams of all words are put in one global
order, rarest first, two words at one edit share one of their three rarest, untouched, at places that
differ by at most one. Only these three are joined. As there is one edit, the words also agree outside
one quarter of their length; what they agree in is part of the join's key, which keeps the groups small
however common a bigram or an ending is. Levenshtein distance decides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_empty
from .line_dedup import lower_ascii

#: Letters that runs are made of: after lowering A-Z, 26 and the 64 from U+00C0 to U+00FF.
LETTERS = 26 + 64


def word_counts(docs: DataFrame, least_len: int = 7, least_n: int = 2, drop_each: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``least_len`` code points and ``least_n`` occurrences in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lowered. With ``drop_each``, where
    it divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code point h % length. Null and empty
    texts have no words; a null doc_id is written as nothing; rows that repeat count again; further
    columns are ignored. An empty table gives an empty result.
    """
    # a shorter run gives no word, so only whole runs of that length or more are taken out
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_len},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", lower_ascii(F.col("run")).alias("run"))
    if drop_each:
        each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        shorter = F.concat(F.substring("run", 1, at), F.substring(F.col("run"), at + 2, F.char_length("run")))
        each = each.select(F.when(F.col("h") % drop_each == 0, shorter).otherwise(F.col("run")).alias("run")).where(F.char_length("run") >= least_len)
    return each.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _letter(word: Column, i: Column) -> Column:
    c = F.ascii(F.substring(word, i, F.lit(1)))
    return F.when(c < 128, c - 97).otherwise(c - 192 + 26)


def _grams(word: Column) -> Column:
    """The number of each bigram, in order of place."""
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: _letter(word, i) * LETTERS + _letter(word, i + 1))


def gram_ranks(words: DataFrame) -> list[int]:
    """The place of each of the LETTERS**2 bigrams in the global order: by occurrences in distinct words, then by number."""
    counts = words.select(F.explode(_grams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    order = sorted((r["n"], r["gram"]) for r in counts.collect())  # at most LETTERS**2 rows
    ranks = [len(order)] * LETTERS**2
    for rank, (_, gram) in enumerate(order):
        ranks[gram] = rank
    return ranks


def _tokens(words: DataFrame, ranks: list[int]) -> DataFrame:
    """(word, n, key, pos, own): for each of the three rarest bigrams and each quarter that an edit may lie in.

    A pair is met by the length of its shorter word: a word is met as the shorter or equal one (``own``)
    and as the longer one. The quarters are those of that length; what stands before a quarter is equal
    from the left, what stands after it from the right.
    """
    rank = F.from_json(F.lit(json.dumps(ranks)), "array<int>")  # a constant of the plan
    placed = F.transform(_grams(F.col("word")), lambda g, i: F.struct(F.get(rank, g).alias("rank"), i.alias("pos")))
    rare = words.select("word", "n", F.char_length("word").alias("len"), F.explode(F.slice(F.array_sort(placed), 1, 3)).alias("gram"))
    ways = []
    for own in (True, False):
        size = F.col("len") if own else F.col("len") - 1
        cut = lambda k, size=size: F.floor(size * k / 4).cast("int")
        for k in range(4):
            after = size - cut(k + 1)
            same = F.substring(F.col("word"), F.lit(1), cut(k)), F.substring(F.col("word"), F.col("len") - after + 1, after)
            ways.append(F.struct(F.lit(own).alias("own"), F.xxhash64(size, F.lit(k), "gram.rank", *same).alias("key")))
    return rare.select("word", "n", F.col("gram.pos").alias("pos"), F.explode(F.array(*ways)).alias("way")).select("word", "n", "pos", "way.own", "way.key")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of ``words`` (word, n) at exactly one inserted, deleted or replaced code point, each once."""
    tokens = _tokens(words, gram_ranks(words))
    x = tokens.where("own").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"))
    y = tokens.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"), "own")
    near = (~F.col("own") | (F.col("a") < F.col("b"))) & (F.abs(F.col("a_pos") - F.col("b_pos")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return x.join(y, "key").where(near).select("a", "a_n", "b", "b_n").distinct()


def spelling_forms(words: DataFrame, scratch: Scratch, times: int = 10) -> DataFrame:
    """One row per row of ``words`` (word, n), whose words have at least seven letters and are distinct: word, form, root, n, n_near, form_n.

    Two words are near at exactly one edit. A word's form is its near word of greatest n (of equal ones
    the least by code points), if that n is at least ``times`` its own; ``root`` follows forms to the
    last. A word without near words has n_near 0, no form, and itself as root.
    """
    pairs = scratch.table(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("low"), F.col("b").alias("word"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.word").alias("to"), (-F.col("best.low")).alias("to_n"))
    far = F.col("to_n") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("to")).alias("form"), F.when(far, F.col("to_n")).alias("form_n"))
    found = scratch.table(found, "forms")
    # forms grow in n by ``times`` a step, so chains are short; each round doubles what a link spans
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.table(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = step.select("word", "root")
        if is_empty(step.where("moved")):
            break
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
