"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each
failed rule; a policy is a set of rules under a version name, applied with a bitwise AND. What a
policy would keep without one of its rules follows from counts per bit pattern, without reading
a text again. All of it is column expressions on the document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.once import computed
from .common import free, own_columns, words

WINDOW = 8
#: Rule names by bit. Positions are never reused, so stored ledgers stay readable.
RULES = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "few_letters", "stutter")
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length", "few_letters", "stutter"),
    "strict": RULES,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_stutter", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window occurring twice or more, from the windows' hashes in order.

    Sorted by hash, a repeated window has an equal neighbour. Of the sorted positions of repeated
    windows each covers its own words up to the next one's first, the last one all of its own.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.get(s, k - 1)["h"] == x["h"]
            after = F.get(s, k + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return _let(_let(ordered, repeated), covered)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a ``ledger`` struct: all measurements and ``failed``, a bit for each failed rule.

    A column of that name is replaced. A null text counts as empty: no words, so ``few_words`` fails. A text of fewer than eight words
    has no window. Words and windows are compared by 64-bit hashes within one text. ``n_stutter`` counts
    words equal to the word before.
    """
    own, q = own_columns(docs, "ledger"), free(docs)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = computed(docs, **{f"{q}words": words(F.col(text)), f"{q}lines": lines})
    word, line = F.col(f"{q}words"), F.col(f"{q}lines")
    step = computed(
        step,
        **{f"{q}keys": F.transform(word, lambda w: F.xxhash64(w))},
        **{f"{q}plain": F.struct(
            F.size(word).cast("long").alias("n_words"),
            F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            F.size(line).cast("long").alias("n_lines"),
            (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
            (F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long").alias("n_letters"),
        )},
    ).select(*own, f"{q}keys", f"{q}plain")
    keys = F.col(f"{q}keys")
    n = F.size(keys)
    window = lambda i: F.xxhash64(*[F.get(keys, i + k) for k in range(WINDOW)])
    step = computed(
        step,
        **{
            f"{q}stutter": F.size(F.filter(keys, lambda k, i: k == F.get(keys, i - 1))).cast("long"),
            f"{q}hashes": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(
                F.array().cast("array<bigint>")
            ),
        },
    ).select(*own, f"{q}plain", f"{q}stutter", f"{q}hashes")
    hashes = F.col(f"{q}hashes")
    repeats = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _repeat_words(hashes)).otherwise(F.lit(0))
    plain = [F.col(f"{q}plain")[c].alias(c) for c in MEASURES[:-2]]
    step = computed(
        step, **{f"{q}m": F.struct(*plain, F.col(f"{q}stutter").alias("n_stutter"), repeats.cast("long").alias("n_repeat_words"))}
    )
    m = F.col(f"{q}m")
    fails = {
        "few_words": m["n_words"] < 20,
        "repeated_windows": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "duplicate_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
        "few_letters": 10 * m["n_letters"] < 6 * m["word_chars"],
        "stutter": 2 * m["n_stutter"] > m["n_words"],
    }
    failed = F.lit(0)
    for bit, name in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(fails[name], F.lit(1 << bit)).otherwise(F.lit(0)))
    return step.select(
        *own,
        F.struct(*[m[c].alias(c) for c in MEASURES], failed.alias("failed")).alias("ledger"),
    )


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether a ledger row passes a policy version."""
    bits = F.col("ledger")["failed"] if failed is None else failed
    return bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledgers: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, kept without it.

    Counts per bit pattern come first, at most one per combination of rules, so the rest is small.
    """
    patterns = ledgers.groupBy(F.col("ledger")["failed"].bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bits = {r: 1 << RULES.index(r) for r in POLICIES[policy]}
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rows = F.array(
        *[
            F.struct(
                F.lit(policy).alias("policy"), F.lit(r).alias("rule"),
                count(F.col("bits").bitwiseAND(F.lit(b)) != 0).alias("n_failed"),
                count(F.col("bits") == b).alias("n_only"),
                count(F.col("bits").bitwiseAND(F.lit(mask(policy) & ~b)) == 0).alias("n_kept_without"),
            )
            for r, b in bits.items()
        ]
    )
    return patterns.agg(rows.alias("r")).select(F.inline("r"))


def rejected_out(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    q = free(docs)
    names = [f"{q}{i}" for i in range(len(docs.columns))]
    kept = ledger(docs.toDF(*names), names[docs.columns.index(text)]).where(passes(policy))
    return kept.select(*names).toDF(*docs.columns)
