"""Quality rules by weak supervision: rules vote or abstain, EM estimates how far to trust each, a posterior decides.

Every document gets plain counts by built-in functions; each rule turns them into 1 (good), 0 (bad) or null
(abstains). Documents are counted by their pattern of votes, of which there are at most 3 ^ rules whatever the
corpus, and expectation-maximisation runs on that table: the E-step is a column expression, the M-step an
aggregate, and one accuracy for each rule with the share of good documents is all that comes back between steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stash

GRAM = 5
ROUNDS = 20
#: Common words of English, French, German and Spanish prose.
STOP_WORDS = ["a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with", "au", "avec", "dans", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une", "das", "dem", "den", "der", "die", "ein", "für", "mit", "nicht", "sich", "und", "von", "zu", "de", "del", "el", "las", "los", "no", "por", "se", "y"]
#: Rule, when it votes bad, when it votes good; else it abstains. Most rules only know what speaks
#: against a text, and several of them see each kind of junk, so that EM can hold them against each other.
RULES = [
    ("length", "n_words < 10", "n_words >= 100"),
    ("word_length", "n_words > 0 and (word_chars > 12 * n_words or word_chars < 2 * n_words)", "false"),
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("letters", "4 * n_letters < 3 * word_chars", "10 * n_letters >= 9 * word_chars and n_words >= 10"),
    ("table", "10 * n_bars > n_words", "false"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    ("repetition", "100 * n_repeat_words > 20 * n_words", "false"),
    ("vocabulary", "n_words >= 50 and 4 * n_distinct_words < n_words", "false"),
    ("capitals", "4 * n_capitals > word_chars", "false"),
    ("exclamations", "10 * n_exclamations > n_words", "false"),
    ("stop_words", "n_words >= 20 and 20 * n_stop_words < n_words", "n_words >= 10 and 8 * n_stop_words >= n_words"),
]
NAMES = [name for name, _, _ in RULES]


def _count(text: Column, characters: str) -> Column:
    """How many characters of the text are in this class."""
    return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """Counts of each row of docs(doc_id, text); a null text is empty. Repeats are found by 64-bit hashes of word windows."""
    rows = id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("solid", F.array_join("words", ""))
    at = lambda i, k: F.get("hashes", i + k)
    grams = F.transform(F.sequence(F.lit(0), F.size("hashes") - GRAM), lambda i: F.xxhash64(*[at(i, k) for k in range(GRAM)]))
    rows = rows.withColumn("grams", F.when(F.size("hashes") >= GRAM, grams))
    # only texts with a repeated window are looked at by position
    repeats = F.size("grams") > F.size(F.array_distinct("grams"))
    placed = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("h"), i.alias("p"))))
    rows = rows.withColumn("placed", F.when(repeats, placed))
    near = lambda k, d: F.get("placed", k)["h"] == F.get("placed", k + d)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size("placed") - 1), lambda k: F.coalesce((k > 0) & near(k, -1), F.lit(False)) | F.coalesce(near(k, 1), F.lit(False)))
    rows = rows.withColumn("starts", F.when(F.col("placed").isNotNull(), F.sort_array(F.transform(again, lambda k: F.get("placed", k)["p"]))))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("starts") - 1), F.lit(0), lambda n, k: n + F.coalesce(F.least(F.lit(GRAM), F.get("starts", k + 1) - F.get("starts", k)), F.lit(GRAM)))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        _count(F.col("solid"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("starts").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("solid") - _count(F.col("solid"), r"[^\p{L}]+")).alias("n_letters"),
        F.size(F.filter("words", lambda w: w == "|")).cast("long").alias("n_bars"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct_words"),
        _count(F.col("solid"), r"[A-Z]+").alias("n_capitals"),
        _count(F.col("solid"), r"!+").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def votes(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.expr(f"case when {bad} then 0 when {good} then 1 end").alias(f"vote_{name}") for name, bad, good in RULES])


def _votes() -> Column:
    return F.array(*[F.col(f"vote_{n}") for n in NAMES])


def posterior(votes_: Column, model: dict) -> Column:
    """Of a document being good, given the array of its votes; an abstaining rule says nothing.

    The model enters as an array, not as numbers in the plan, so all rounds share their compiled code.
    """
    weights = F.lit([math.log(right / (1 - right)) for right in model["rules"].values()])
    prior = F.lit(math.log(model["good"] / (1 - model["good"])))
    said = F.zip_with(votes_, weights, lambda v, w: F.coalesce((2 * v - 1) * w, F.lit(0.0)))
    return 1 / (1 + F.exp(-F.aggregate(said, prior, lambda total, x: total + x)))


#: Before the first round: most documents are good, and a rule that votes is right four times in five.
START = {"good": 0.8, "rules": {name: 0.8 for name in NAMES}}


def fit(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """The share of good documents and each rule's accuracy, the share of its votes that are right.

    Accuracies are smoothed by one vote each way, and none falls under a half: a rule is at least as good as a coin, which
    tells the two classes apart. Without documents START comes back unchanged.
    """
    patterns = stash(voted.groupBy(_votes().alias("votes")).agg(F.count("*").alias("n")).coalesce(1))
    model = START
    for _ in range(rounds):
        p = posterior(F.col("votes"), model)
        # the share of good documents is counted like a rule that always votes good
        cast = patterns.select("n", p.alias("p"), F.posexplode(F.array_append("votes", F.lit(1))).alias("rule", "vote")).where("vote is not null")
        right = F.sum(F.when(F.col("vote") == 1, F.col("n") * F.col("p")).otherwise(F.col("n") * (1 - F.col("p"))))
        got = {r["rule"]: r for r in cast.groupBy("rule").agg(right.alias("right"), F.sum("n").alias("cast")).collect()}
        if not got:
            break
        share = lambda i: (got[i]["right"] + 1) / (got[i]["cast"] + 2) if i in got else 0.5
        model = {"good": share(len(NAMES)), "rules": {n: max(0.5, share(i)) for i, n in enumerate(NAMES)}}
    return model


def judge_quality(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The verdict on each row of docs(doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 10 words, or over a
    fifth of the words in repeated windows), quality (posterior probability of being good) and kept (not
    base_failed and quality of a half or more). A null text is empty, and empty texts fail; null doc_ids and repeated rows
    are judged like others; other columns are ignored; an empty table gives no rows.
    """
    voted = stash(votes(features(docs)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    p = posterior(_votes(), fit(voted, rounds))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), p.alias("quality"), (~failed & (p >= 0.5)).alias("kept"))
