"""Saved searches over listings, result order, rating batches and run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions.fields import query_key, tier_rank
from ..functions.text import WIDE_SPACE, plural, trim
from ..plans.once import computed
from ..plans.scan import global_position, running
from ..plans.skew import fits_broadcast, salted_join
from ..session import cut

GRAM = 3


def _plain_gaps(text: Column) -> Column:
    """Every kind of white space as one that a short pattern knows."""
    return F.translate(text, WIDE_SPACE, " " * len(WIDE_SPACE))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_plain_gaps(text), F.lit(r"\S+"), F.lit(0))


def _grams(text: Column, size: int) -> Column:
    """The stretches of ``size`` characters inside the words of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(_plain_gaps(text), F.lit(rf"(?=(\S{{{size}}}))"), F.lit(1)))


def _haystack() -> Column:
    return F.lower(
        F.concat_ws(" ", F.col("title"), F.col("company"), F.coalesce("description", F.lit("")))
    )


def matches(keywords: Column, location: Column, remote_only: Column, haystack: Column | None = None) -> Column:
    """The search predicate against the current listing row, whose searched text may be given."""
    needle = F.lower(trim(F.coalesce(keywords, F.lit(""))))
    place = F.lower(trim(F.coalesce(location, F.lit(""))))
    return (
        ((needle == "") | F.contains(_haystack() if haystack is None else haystack, needle))
        & ((place == "") | F.contains(F.lower(F.coalesce(F.col("location"), F.lit(""))), place))
        & (~F.coalesce(remote_only, F.lit(False)) | F.coalesce(F.col("remote"), F.lit(False)))
    )


#: What an anchor is taken from: a whole word, else a gram of the keywords, else of the place, else nothing.
_ANY, _WHOLE, _PART, _PLACE = "a", "w", "k", "p"


def _inner(phrase: Column) -> Column:
    """The words between the first and the last, which every text with the phrase has as whole words."""
    words = _words(phrase)
    return F.array_distinct(F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(F.array().cast("array<string>")))


def _gram(phrase: Column) -> Column:
    """A gram of the longest word, whole when it is short; null without words.

    The words of a phrase may be cut at its ends but each lies inside one word of a
    matching text, so every text that contains the phrase contains the anchor.
    """
    by_length = F.array_sort(
        F.transform(_words(phrase), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    )
    return F.substr(F.get(by_length, 0)["w"], F.lit(1), F.lit(GRAM))


def _anchored(queries: DataFrame, listings: DataFrame, max_searches: int) -> DataFrame:
    """The search's own columns under free names and its one anchor as ``__gram``.

    A phrase is looked up by the one of its inner words that the fewest listings have; which one it
    is changes what is tested, not what is found.
    """
    words, place = F.lower(trim(F.coalesce("keywords", F.lit("")))), F.lower(trim(F.coalesce("location", F.lit(""))))
    own = queries.select(
        F.col("query_id").alias("__query"), F.col("keywords").alias("__keywords"), F.col("location").alias("__place"),
        F.col("remote_only").alias("__remote"), _inner(words).alias("__inner"),
        F.coalesce(F.concat(F.lit(_PART), _gram(words)), F.concat(F.lit(_PLACE), _gram(place)), F.lit(_ANY)).alias("__other"),
    )
    asked = own.select(F.explode("__inner").alias("__word")).distinct()
    held = listings.select(F.explode(F.array_distinct(_words(_haystack()))).alias("__word"))
    if fits_broadcast(asked, max_rows=max_searches):
        asked = F.broadcast(asked)
    counts = held.join(asked, "__word").groupBy("__word").agg(F.count(F.lit(1)).alias("__n"))
    numbered = own.select(F.xxhash64("__keywords").alias("__phrase"), F.explode("__inner").alias("__word")).distinct()
    rarest = numbered.join(counts, "__word", "left").groupBy("__phrase").agg(
        F.min_by("__word", F.struct(F.coalesce("__n", F.lit(0)), -F.length("__word"), "__word")).alias("__rare")
    )
    joined = own.withColumn("__phrase", F.xxhash64("__keywords")).join(rarest, "__phrase", "left")
    # of two phrases with one hash the word may be the other's
    fits = F.array_contains("__inner", F.col("__rare"))
    word = F.when(fits, F.col("__rare")).otherwise(F.get("__inner", 0))
    return joined.select(
        "__query", "__keywords", "__place", "__remote", F.coalesce(F.concat(F.lit(_WHOLE), word), "__other").alias("__gram")
    )


def _grams_asked_for(asked: DataFrame, hay: Column) -> Column:
    """Every anchor of a kind and length in use that can lead to a listing, once."""
    mark, size = F.left("__gram", F.lit(1)), F.length("__gram") - 1
    whole = mark == _WHOLE
    kinds = sorted(tuple(r) for r in asked.select(mark, F.when(whole, 0).otherwise(size)).distinct().collect())  # at most eight
    texts = {_PART: hay, _PLACE: F.lower(F.coalesce(F.col("location"), F.lit("")))}
    parts = [F.array(F.lit(_ANY)).cast("array<string>")] if any(k == _ANY for k, _ in kinds) else [F.array().cast("array<string>")]
    if any(k == _WHOLE for k, _ in kinds):
        parts.append(F.transform(F.array_distinct(_words(hay)), lambda w: F.concat(F.lit(_WHOLE), w)))
    for kind, text in texts.items():
        sizes = [n for k, n in kinds if k == kind]
        parts += [F.transform(_grams(text, n), lambda g: F.concat(F.lit(kind), g)) for n in sizes]
    return F.concat(*parts)


def saved_search_hits(queries: DataFrame, listings: DataFrame, max_searches: int = 100_000) -> DataFrame:
    """All (query, listing) matches for many queries at once, one row per query and listing row.

    Substring search as an equi-join: each query brings one anchor, its rarest whole word or a gram of a
    short phrase, each listing its distinct words and grams, and only pairs that share the anchor are tested. Up to
    ``max_searches`` searches of a checked size travel to the listings, and text is never shuffled.
    Otherwise listings are named by a digest of all their columns; only digests and grams are
    shuffled to find candidates, and a candidate is joined back to all listing rows of its digest.
    Equal listing rows are hits each, null columns or not; both ways give the same rows.
    """
    asked = cut(_anchored(queries, listings, max_searches))
    grams = F.explode(_grams_asked_for(asked, F.col("__hay")))
    predicate = matches(F.col("__keywords"), F.col("__place"), F.col("__remote"), F.col("__hay"))
    if fits_broadcast(asked, max_rows=max_searches):
        met = computed(listings, __hay=_haystack()).withColumn("__gram", grams).join(F.broadcast(asked), "__gram")
    else:
        digest = F.sha2(F.to_json(F.struct(*listings.columns), {"ignoreNullFields": "false"}), 256)
        named = listings.withColumn("__digest", digest)
        keys = computed(named, __hay=_haystack()).select("__digest", grams.alias("__gram")).distinct()
        candidates = salted_join(keys, asked, ["__gram"], ["__digest"], "inner")
        met = salted_join(candidates, named, ["__digest"], ["__query"], "inner").withColumn("__hay", _haystack())
    return met.where(predicate).select(F.col("__query").alias("query_id"), *listings.columns)


def adapter_labels(hits: DataFrame, queries: DataFrame, asked: Column) -> DataFrame:
    """Sources that answered, sorted and comma-joined; who was asked when none did.

    Distinct sources per query are a closed set, so the list stays short.
    """
    per_source = hits.select("query_id", "source").distinct()
    answered = per_source.groupBy("query_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("answered")
    )
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"))
    return (
        queries.select("query_id")
        .join(answered, "query_id", "left")
        .join(counts, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("answered", asked).alias("adapter"),
            F.coalesce("result_count", F.lit(0).cast("long")).alias("result_count"),
        )
    )


def run_history(history: DataFrame, labels: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """Previous runs plus one row per query of this run, also for queries that found nothing."""
    run = queries.join(labels, "query_id").select(
        "query_id",
        query_key(F.col("keywords"), F.col("location"), F.col("remote_only")).alias("query"),
        "adapter", "result_count", at.alias("created_at"),
    )
    return history.unionByName(run)


def save_searches(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new searches with one row per query key, the oldest kept."""
    key = query_key(F.col("keywords"), F.col("location"), F.col("remote_only"))
    both = stored.unionByName(new)
    rest = F.struct(*both.columns)
    return (
        both.groupBy(key.alias("query_key"))
        .agg(F.min_by(rest, F.struct("created_at", "query_id")).alias("r"))
        .select("r.*", "query_key")
    )


def newest_searches(saved: DataFrame, order: Sequence[str]) -> DataFrame:
    """Saved searches newest first; ties by ``order``. Adds ``place``."""
    return global_position(saved, [F.col("created_at").desc_nulls_last(), *order], "place")


def result_summary(results: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``18 results · 5 rated · jsearch`` per search; sources in first-seen order."""
    per_source = results.groupBy(*by, "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("tier").alias("rated"),
        F.min(F.struct(*order)).alias("first"),
    )
    totals = per_source.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("rated").alias("rated"),
        F.array_sort(F.collect_list(F.struct("first", "source"))).alias("s"),
    )
    n, rated = F.col("n"), F.col("rated")
    rated_part = F.when(rated == 0, F.lit(None).cast("string")).when(
        rated == n, "rated for fit"
    ).otherwise(F.concat(rated.cast("string"), F.lit(" rated")))
    return totals.select(
        *by,
        F.concat_ws(
            " · ",
            F.concat(n.cast("string"), F.lit(" "), plural(n, "result")),
            rated_part,
            F.array_join(F.transform("s", lambda x: x["source"]), " · "),
        ).alias("summary"),
    )


def with_ratings(listings: DataFrame, ratings: DataFrame, id_column: str = "external_id") -> DataFrame:
    """Every listing with its rating, or none; ratings of unknown listings are dropped.

    Of several ratings of one listing the best tier is taken, then the smallest reasons, so a
    listing stays one row.
    """
    one = ratings.groupBy(id_column).agg(F.min(F.struct(tier_rank(F.col("tier")).alias("rank"), "tier", "reasons")).alias("__r"))
    return listings.join(one.select(id_column, "__r.tier", "__r.reasons"), id_column, "left")


def best_fit_order(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Strong, possible, reach, then unrated; ties keep the merge order. Adds ``place``."""
    ranked = results.withColumn("tier_rank", tier_rank(F.col("tier")))
    return global_position(ranked, ["tier_rank", *order], "place")


def newest_order(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Newest first, undated last; ties keep the merge order. Adds ``place``."""
    return global_position(results, [F.col("posted_at").desc_nulls_last(), *order], "place")


def positions(df: DataFrame, keys: Sequence[str], blocks: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position within ``keys`` without gathering a large key in one task."""
    return running(df, keys, blocks, order, position=name)


def rating_batches(listings: DataFrame, keys: Sequence[str], blocks: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Chunks of listings per model call, in order. Adds ``batch`` from 0."""
    placed = positions(listings, keys, blocks, order, "__at")
    return placed.withColumn(
        "batch", F.floor((F.col("__at") - 1) / vocab.RATING_BATCH_SIZE).cast("long")
    ).drop("__at")


def batch_budgets(batched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size and reply token budget per batch."""
    return batched.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("listings")).withColumn(
        "max_tokens",
        (F.lit(vocab.RATING_TOKENS_BASE) + F.col("listings") * vocab.RATING_TOKENS_PER_LISTING).cast("long"),
    )
