"""Text functions of the evaluators, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .redaction import without_personal_data, without_secrets

def normalized(text: Column, mode: str = "all") -> Column:
    """Modes none, case, whitespace, punctuation and all; null stays null.

    `punctuation` drops the marks and leaves one space between the words that are left; letters are lower-cased one by one, so that
    those that casefolding makes two of (like a sharp s) stay one.
    """
    if mode not in ("none", "case", "whitespace", "punctuation", "all"):
        raise ValueError(f"unknown mode {mode}")
    if mode in ("punctuation", "all"):
        text = F.regexp_replace(text, r"\p{P}", "")
    if mode in ("case", "all"):
        text = F.lower(text)
    return F.trim(F.regexp_replace(text, r"\s+", " ")) if mode in ("whitespace", "punctuation", "all") else text


def exact_match(actual: Column, expected: Column, mode: str = "none") -> Column:
    return normalized(actual, mode).eqNullSafe(normalized(expected, mode))


def contains(text: Column, needles: list[str], every: bool = True, ignore_case: bool = True) -> Column:
    """Whether all (or any) of the needles occur; a null text holds none."""
    where = F.lower(text) if ignore_case else text
    found = [F.coalesce(where.contains(n.lower() if ignore_case else n), F.lit(False)) for n in needles]
    out = F.lit(every)
    for x in found:
        out = out & x if every else out | x
    return out


def n_words(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def length_within(size: Column, least: int | None = None, most: int | None = None) -> Column:
    out = F.lit(True)
    if least is not None:
        out &= size >= least
    if most is not None:
        out &= size <= most
    return out


def regex_rules(text: Column, allow: list[str] = (), deny: list[str] = ()) -> Column:
    """All patterns of `allow` match and none of `deny`."""
    out = F.lit(True)
    for p in allow:
        out &= F.coalesce(text.rlike(p), F.lit(False))
    for p in deny:
        out &= ~F.coalesce(text.rlike(p), F.lit(False))
    return out


def redacted(text: Column) -> Column:
    """Secrets and e-mail addresses replaced by marks."""
    return without_personal_data(without_secrets(text), ("email",))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar_pairs(rows: DataFrame, keys: list[str], id_: str, tokens_: str, least: float) -> DataFrame:
    """keys, a, b (a < b): rows of one key whose token sets have a Jaccard similarity of `least` (more than 0) or more.

    Equal sets are compared once and their rows paired at the end, which is no more work than there are pairs. Two sets must share one of the first
    n - ceil(least * n) + 1 tokens of each, rarest first, so only such are met, and only if their sizes and what follows that token allow enough common
    ones. A row without tokens is like none. Rows with one id are one row with each of its sets.
    """
    by = lambda *more: [*keys, *more]
    held = rows.select(*by(id_), F.array_sort(F.array_distinct(tokens_)).alias("_set")).where(F.size("_set") > 0).distinct()
    sets = held.groupBy(*by("_set")).agg(F.count("*").alias("_copies")).withColumn("_n", F.size("_set"))
    members = held.join(sets, by("_set")).select(*by("_set", "_copies"), F.col(id_).alias("_id"))
    each = sets.select(*by("_set", "_n"), F.explode("_set").alias("_token")).withColumn("_key", F.sha2(F.to_json("_set"), 256)).drop("_set")
    often = each.groupBy(*by("_token")).agg(F.count("*").alias("_often"))
    ranked = each.join(often, by("_token")).withColumn("_place", F.row_number().over(Window.partitionBy(*by("_key")).orderBy("_often", "_token")))
    prefix = ranked.where((F.col("_place") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1) & (F.col("_often") > 1))
    side = lambda x: prefix.select(*by("_token"), *[F.col(f"_{c}").alias(f"{c}_{x}") for c in ("key", "n", "place")])
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    sizes = (F.col("n_a") >= least * F.col("n_b") - 1e-9) & (F.col("n_b") >= least * F.col("n_a") - 1e-9)
    met = side("a").join(side("b"), by("_token")).where((F.col("key_a") < F.col("key_b")) & sizes & (rest * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-9))
    whole = lambda x: sets.select(*keys, F.sha2(F.to_json("_set"), 256).alias(f"key_{x}"), F.col("_set").alias(f"_{x}"))
    near = met.select(*by("key_a", "key_b")).distinct().join(whole("a"), by("key_a")).join(whole("b"), by("key_b")).where(jaccard(F.col("_a"), F.col("_b")) >= least).select(*by("_a", "_b"))
    of = lambda x: members.select(*keys, F.col("_set").alias(f"_{x}"), F.col("_id").alias(f"id_{x}"))
    across = near.join(of("a"), by("_a")).join(of("b"), by("_b"))
    copies = members.where("_copies > 1")
    within = copies.select(*by("_set"), F.col("_id").alias("id_a")).join(copies.select(*by("_set"), F.col("_id").alias("id_b")), by("_set")).where("id_a < id_b")
    pairs = across.select(*by("id_a", "id_b")).unionByName(within.select(*by("id_a", "id_b")))
    return pairs.where("id_a <> id_b").select(*keys, F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
