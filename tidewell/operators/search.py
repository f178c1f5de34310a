"""BM25 search over notes, with a usage prior and relaxation from all terms to any."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet, tokenize
from ..sources.scratch import Scratch

# The ranking's constants.
K1, B, NAME_BOOST, DESC_BOOST, PREFIX, PHRASE, PRIOR = 1.2, 0.75, 3.0, 2.0, 0.45, 1.8, 0.35


def terms_of(spark, query: str) -> list[str]:
    """Terms of a query, in order, repeated ones repeated."""
    return spark.range(1).select(tokenize(F.lit(query)).alias("t")).first()["t"]


def prior(sessions):
    return F.lit(1.0) + F.lit(PRIOR) * F.least(F.sqrt(F.coalesce(sessions, F.lit(0)).cast("double")), F.lit(3.6)) / F.lit(3.6)


def _tf(tokens: list, term: str):
    """Weighted frequency of a term in the three token lists; a longer token that begins with it counts in part."""

    def hit(col):
        exact = F.size(F.filter(col, lambda x: x == term))
        return exact + F.lit(PREFIX) * (F.size(F.filter(col, lambda x: x.startswith(term))) - exact)

    return hit(tokens[0]) * F.lit(NAME_BOOST) + hit(tokens[1]) * F.lit(DESC_BOOST) + hit(tokens[2])


def _numbers(notes: DataFrame, terms: list[str], phrase: str) -> DataFrame:
    """Per note: name, sessions, whether it holds each term (``h``), length and term frequencies of those that hold any.

    Texts are read and tokenised once here, whatever is asked of the numbers afterwards.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("name", "description", "body")}
    hay = F.lower(F.concat_ws(" ", text["name"], text["description"], text["body"]))
    flat = F.regexp_replace(hay, "-", "")
    held = F.array(*[hay.contains(t) | flat.contains(t) for t in terms])
    near = F.lower(text["name"]).contains(phrase) | F.lower(text["description"]).contains(phrase) | F.lower(text["body"]).contains(phrase)
    sessions = F.coalesce("sessions", F.lit(0)) if "sessions" in notes.columns else F.lit(0)
    # generators, so that nothing is pushed below them and made again for each term
    seen = notes.select("name", sessions.alias("sessions"), near.alias("near"), *[text[c].alias(f"_{c}") for c in text], F.inline(F.array(F.struct(held.alias("h")))))
    some = F.exists("h", lambda x: x)
    lists = F.struct(*[F.when(some, tokenize(F.col(f"_{c}"))).alias(f"t{i}") for i, c in enumerate(text)])
    cut = seen.select("name", "sessions", "near", "h", F.inline(F.array(lists)))
    tokens = [F.col(f"t{i}") for i in range(3)]
    size = sum((F.size(t) for t in tokens[1:]), F.size(tokens[0]))
    return cut.select("name", "sessions", "near", "h", F.when(some, size).alias("size"), F.when(some, F.array(*[_tf(tokens, t).cast("double") for t in terms])).alias("tf"))


def scored(numbers: DataFrame, terms: list[str], times: dict[str, int], require_all: bool, n: int | None = None) -> DataFrame:
    """(name, score), best first, from the numbers of all notes, or of those that hold any term where ``n`` says how many there are."""
    matched = (F.forall if require_all else F.exists)("h", lambda x: x)
    totals = numbers.agg(F.count("*").alias("n"), F.avg(F.when(matched, F.col("size"))).alias("mean"), *[(F.count_if(F.col("h")[i]) * k).alias(f"d{i}") for i, k in enumerate(times.values())]).first()
    n, mean = float(totals["n"] if n is None else n), max(totals["mean"] or 0.0, 1.0)
    score, some = F.lit(0.0), F.lit(False)
    for i, k in enumerate(times.values()):
        d = float(totals[f"d{i}"])
        inside = (n - d + 0.5) / (d + 0.5) + 1.0
        idf = max(0.0, math.log(inside)) if inside > 0 else 0.0
        tf = F.col("tf")[i]
        part = F.lit(idf) * (tf * F.lit(K1 + 1.0)) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * (F.col("size") / F.lit(mean))))
        score = score + F.when(tf > 0, part * k).otherwise(0.0)
        some = some | (tf > 0)
    if sum(times.values()) > 1:
        score = score * F.when(F.col("near"), PHRASE).otherwise(1.0)
    return numbers.where(matched & some).select("name", (score * prior(F.col("sessions"))).alias("score")).orderBy(F.desc("score"), "name")


def rank(notes: DataFrame, query: str, require_all: bool = True, save=None) -> DataFrame:
    """(name, score) of notes (name, description, body, sessions) that match, best first.

    A term's document frequency counts notes that hold it as a substring (hyphens kept or dropped),
    over the whole corpus; the mean length is of the candidates only. A repeated term counts each
    time, in the frequency too. The query is a short list of terms on the driver; the corpus is read
    once into a narrow table of numbers, which gives one row of totals and then the scores.
    """
    return _search(notes, query, [require_all], save)[0]


def _search(notes: DataFrame, query: str, ways: list[bool], save) -> tuple[DataFrame, bool]:
    terms = terms_of(notes.sparkSession, query)
    if not terms:
        return notes.select("name", F.lit(0.0).alias("score")).where("false"), ways[-1]
    times = {t: terms.count(t) for t in terms}
    save = save or Scratch(notes.sparkSession, "search").table
    numbers = save(_numbers(notes, list(times), query.strip().lower()))
    for every in ways:
        found = scored(numbers, terms, times, every)
        if every == ways[-1] or not found.isEmpty():
            return found, every


def search(notes: DataFrame, query: str, save=None) -> tuple[DataFrame, bool]:
    """All terms first; if nothing matches, any term, and true."""
    found, every = _search(notes, query, [True, False], save)
    return found, not every


def shaped(found: DataFrame, notes: DataFrame, query: str) -> DataFrame:
    """Hits (name, score) with their description, a snippet and the score to two decimals.

    The snippet is at the longest term that the body holds (the last of equally long ones) and as
    wide as the query asks; without such a term there is none.
    """
    terms = terms_of(notes.sparkSession, query)
    body = F.coalesce("body", F.lit(""))
    at = F.lit(None).cast("string")
    for t in sorted(set(terms), key=lambda t: (len(t), terms[::-1].index(t) * -1)):  # the longest, and of those the last, is asked first
        at = F.when(F.lower(body).contains(t), F.lit(t)).otherwise(at)
    texts = notes.select("name", F.coalesce("description", F.lit("")).alias("description"), body.alias("body"), at.alias("_at"))
    cut = F.when(F.col("_at").isNotNull(), snippet(F.col("body"), F.col("_at"), length=F.lit(len(query))))
    return found.join(texts, "name").select("name", "description", cut.alias("snippet"), rounded(F.col("score")).alias("score"))


def rounded(score):
    """Two decimals the arithmetic way: times 100, half up, and back."""
    return F.floor(score * 100 + 0.5) / 100
