"""Document checks: posting terms, coverage, phrasing, lint, fidelity, confidence.

Each check returns counts and named items, never one quality number. Work on one
document's lines or leaves stays inside the row or groups by document only after
the rows have been reduced to findings.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import dates as D
from ..functions import text as T
from ..plans.once import computed
from ..plans.skew import lookup_join, salted_join
from . import leaves as L

# --- posting terms ----------------------------------------------------------


_TOKEN = T.listed(vocab.TECH_TOKEN)


def _token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TOKEN))


_CANDIDATES = "array<struct<ord:int,rank:int,text:string,gap:string>>"


def _candidate(ord_: Column, rank: int, text: Column, gap: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        ord_.cast("int").alias("ord"), F.lit(rank).alias("rank"), text.alias("text"),
        (none if gap is None else gap).alias("gap"),
    )


def _plain_words() -> str:
    """From the end of a token over all that names no technology: gaps, and words of small letters alone."""
    tails: dict[str, list[str]] = {}
    for name in filter(str.isalpha, vocab.KNOWN_TECH):
        tails.setdefault(name[0], []).append(name[1:])
    known = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(tails.items()))
    return T.listed(rf"\G(?:(?![A-Za-z]).|(?!(?:{known})(?![A-Za-z0-9]))[a-z]++(?![A-Z0-9+#]|[./][A-Za-z0-9+#]))*+")


def _sums(counts: Column) -> Column:
    """The sum up to each element, by blocks: a sum is appended to a short list."""
    block = 16
    ints = "array<int>"

    def summed(of: Column) -> Column:
        return F.aggregate(
            of, F.array().cast(ints), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n))
        )

    def joined(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), (F.size(all_) - 1).cast("int"), F.lit(block))).otherwise(F.array().cast(ints))
        blocks = F.transform(starts, lambda s: summed(F.slice(all_, s + 1, block)))
        return F.flatten(F.transform(F.array(blocks), lambda bs: F.flatten(F.transform(
            F.array(summed(F.transform(bs, lambda b: F.get(b, F.size(b) - 1)))),
            lambda ends: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda n: n + F.coalesce(F.get(ends, i - 1), F.lit(0))))),
        ))))

    return F.flatten(F.transform(F.array(counts), lambda all_: F.when(F.size(all_) <= block, summed(all_)).otherwise(joined(all_))))


def _tech_tokens(line: Column) -> Column:
    """The tokens that name a technology, with their ordinals among all tokens.

    Most tokens are plain lower-case words, which only their name can tell. They are passed over
    and counted together with what stands between them, not taken out one by one.
    """
    free = F.replace(F.replace(line, F.lit("\1"), F.lit("\3")), F.lit("\2"), F.lit("\3"))
    marked = F.regexp_replace(free, f"(?s)({_plain_words()})({_TOKEN})", "$1\1$2\2")
    def parts(p: Column) -> Column:
        two = F.split(p, "\1")
        return F.struct(F.get(two, 1).alias("t"), F.get(two, 0).alias("gap"))

    # after the last token only plain words are left
    pairs = F.filter(F.transform(F.split(marked, "\2"), parts), lambda p: p["t"].isNotNull())
    split = F.transform(pairs, lambda p: F.struct(p["t"].alias("t"), F.split(p["gap"], "[a-z]+", -1).alias("around")))
    # what is around the words of a gap has one piece more than these, which stands for the token
    cut = F.transform(
        split, lambda p: F.struct(p["t"].alias("t"), F.get(p["around"], F.size(p["around"]) - 1).alias("gap"), F.size(p["around"]).alias("n"))
    )

    def judged(all_: Column) -> Column:
        placed = F.zip_with(
            all_, _sums(F.transform(all_, lambda c: c["n"])),
            lambda c, end: F.struct(_candidate(end - 1, 2, c["t"]).alias("c"), c["gap"].alias("gap")),
        )
        return F.transform(F.filter(placed, lambda x: _is_tech(x["c"]["text"], x["c"]["ord"], x["gap"])), lambda x: x["c"])

    return F.flatten(F.transform(F.array(cut), judged))


def _is_tech(token: Column, ordinal: Column, gap: Column) -> Column:
    """Technology by name, or by shape; a capital that starts a sentence says nothing."""
    lower = F.lower(token)
    starts = (ordinal == 0) | gap.rlike(vocab.SENTENCE_GAP)
    shaped = (
        token.rlike(r"^.[^A-Z]*[A-Z]|[0-9+#./]")
        | (F.length(token).between(2, 6) & (token == F.upper(token)))
        | (token.rlike(r"^[A-Z][a-z]") & ~starts)
    )
    # most tokens are plain lower-case words, which only their name can tell
    named = lower.isin(*vocab.KNOWN_TECH) | (token.rlike("[A-Z0-9+#./]") & shaped)
    return named & ~lower.isin(*vocab.TERM_STOPWORDS) & ~lower.isin(*vocab.COMMON_CAPITALISED)


def _any_phrase() -> str:
    """Where a known skill of several words begins, with the skill itself captured.

    The match has no width, so that skills may overlap; no skill is the beginning of another.
    """
    parts = ["".join(ch if ch.isalnum() else " " for ch in p.lower()).split() for p in vocab.KNOWN_SKILL_PHRASES]
    either = "|".join(r"[\s\-]+".join(words) for words in parts)
    initials = "".join(sorted({words[0][0] for words in parts}))  # most letters begin no skill
    next_ = "".join(sorted({words[0][1] for words in parts}))
    return T.listed(rf"(?i)(?=[{initials}][{next_}])(?<![A-Za-z0-9])(?=({either})(?![A-Za-z0-9]))")


def _known_phrases(line: Column) -> Column:
    """Known skills of several words where they stand, in the line's casing."""
    padded = F.concat(F.lit(" "), line)  # a match without width would cut nothing off a line it begins
    pieces = F.split(padded, _any_phrase(), -1)

    def placed(all_: Column) -> Column:
        found = F.regexp_extract_all(padded, F.lit(_any_phrase()), 1)
        starts = F.slice(_sums(F.transform(all_, lambda piece: F.length(piece))), 1, F.size(all_) - 1)
        return F.when(
            F.size(all_) > 1, F.zip_with(found, starts, lambda text, start: _candidate(_token_count(F.left(padded, start)), 1, text))
        ).otherwise(F.array().cast(_CANDIDATES))

    return F.flatten(F.transform(F.array(pieces), placed))


#: What is left of a token that began before.
_TOKEN_REST = T.listed(r"\A[A-Za-z0-9+#]*(?:[./][A-Za-z0-9+#]+)*")


def _requirement_clauses(line: Column) -> Column:
    """The clause after each "experience with" and its kin, and where it starts."""
    # each piece ends with a trigger, and a trigger with a letter
    pieces = F.regexp_extract_all(line, F.lit(T.listed(rf"(?s)(\G.*?{vocab.REQUIREMENT_TRIGGER})")), 1)
    clauses = F.regexp_extract_all(line, F.lit(T.listed(vocab.REQUIREMENT_CLAUSE.replace("[^,;:.!?()]", T.besides(",;:.!?()")))), 1)

    def placed(all_: Column) -> Column:
        counts = F.transform(all_, lambda p, i: _token_count(F.when(i == 0, p).otherwise(F.regexp_replace(p, _TOKEN_REST, ""))).cast("int"))
        return F.when(F.size(all_) > 0, F.zip_with(_sums(counts), clauses, lambda end, c: _candidate(end, 0, c))).otherwise(F.array().cast(_CANDIDATES))

    return F.flatten(F.transform(F.array(pieces), placed))


def _requirement_phrase(clause: Column) -> Column:
    """Up to three words of a clause, leading stopwords dropped."""
    word = f"{T.besides(T.WHITE)}+"
    says_nothing = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "").isin(*vocab.TERM_STOPWORDS)
    words = F.regexp_extract_all(clause, F.lit(word), F.lit(0))
    first = F.array_position(F.transform(words, says_nothing), F.lit(False)).cast("int")
    # what is left without plain stopwords in front nearly always starts with a word that says something
    rest = F.regexp_replace(clause, rf"(?i)^(?:{T.SPACE}*(?:{'|'.join(vocab.TERM_STOPWORDS)})(?={T.SPACE}|\z))*+{T.SPACE}*", "")
    three = F.regexp_extract(rest, f"^({word}(?:{T.SPACE}+{word}){{0,2}})", 1)

    def kept(t: Column) -> Column:
        return (
            F.when(~says_nothing(F.regexp_extract(t, f"^({word})", 1)), t)
            .when(first > 0, F.array_join(F.slice(words, first, 3), " "))
            .otherwise("")
        )

    # bound once, as the element of an array
    return F.regexp_replace(F.get(F.transform(F.array(three), kept), 0), r"[^A-Za-z0-9+#./\s\-]+$", "")


_TERM = "struct<line_no:int,ord:int,rank:int,term_key:string,term:string>"


def _line_terms(line: Column, line_no: Column) -> Column:
    """Candidate terms of one line, with their keys first."""
    tech = _tech_tokens(line)
    asked = F.transform(_requirement_clauses(line), lambda c: _candidate(c["ord"], 0, _requirement_phrase(c["text"])))
    phrases = F.transform(
        F.concat(asked, _known_phrases(line)),
        lambda c: F.struct(c["ord"], c["rank"], F.regexp_replace(T.trim(c["text"]), f"{T.SPACE}+", " ").alias("text"), c["gap"]),
    )
    return F.transform(
        F.concat(phrases, tech),
        lambda c: F.struct(
            T.term_key(c["text"]).alias("term_key"), line_no.alias("line_no"), c["ord"].alias("ord"), c["rank"].alias("rank"),
            c["text"].alias("term"),
        ),
    )


def term_lists(postings: DataFrame, key: str, body: str, keep: Sequence[str] = ()) -> DataFrame:
    """What each posting asks for, in its own row: ``key``, the ``keep`` columns and ``terms`` in posting order.

    A term has ``line_no, ord, rank, term_key, term``. Candidates of all lines are one array of the
    row; sorted by their keys, the first of each is its first sighting, whose casing stays. Nothing
    is shuffled, and a posting's terms are bounded by its own text.
    """
    found = F.flatten(F.transform(F.split(F.col(body), r"\r?\n"), _line_terms))
    good = F.filter(
        found, lambda c: c["term"].rlike("[A-Za-z]") & F.exists(T.tokens(c["term"]), lambda t: ~t.isin(*vocab.TERM_STOPWORDS))
    )
    rows = computed(postings.select(key, *keep, body), __found=F.sort_array(good))
    first = F.filter("__found", lambda c, i: (i == 0) | (c["term_key"] != F.get("__found", i - 1)["term_key"]))
    placed = F.transform(first, lambda c: F.struct(*[c[x].alias(x) for x in ("line_no", "ord", "rank", "term_key", "term")]))
    return rows.select(key, *keep, F.sort_array(placed).alias("terms"))


def posting_terms(postings: DataFrame, key: str, body: str) -> DataFrame:
    """What each posting asks for: ``key, line_no, ord, rank, term_key, term``.

    Order in the posting is ``(line_no, ord, rank)``. Terms are unique per key, in their first casing.
    """
    return term_lists(postings, key, body).select(key, F.inline("terms")).select(key, "line_no", "ord", "rank", "term_key", "term")


# --- coverage ---------------------------------------------------------------


def folded_text(fields: Column) -> Column:
    """Fields as folded tokens, one per line and space-padded.

    A phrase is in a field exactly when its padded key is a substring, and no
    phrase can span two fields.
    """
    # the fields are folded together: a line end stays where one field ends
    joined = F.array_join(F.transform(fields, lambda f: F.replace(F.coalesce(f, F.lit("")), F.lit("\n"), F.lit(" "))), "\n")
    folded = T.fold_plural(F.regexp_replace(F.lower(joined), T.besides(string.ascii_lowercase + string.digits + "\n") + "+", " "))
    return F.concat(F.lit(" "), F.regexp_replace(F.trim(folded), " ?\n ?", " \n "), F.lit(" "))


def coverage(
    pairs: DataFrame, terms: DataFrame, posting_key: str, documents: DataFrame, document_key: str, postings: DataFrame | None = None
) -> DataFrame:
    """Matched and missing terms per ``pairs`` row (``pair_id``, posting and document keys).

    ``terms`` has one row per posting with its ``terms`` (``term_lists``), or one per posting and
    term; ``documents`` has ``folded`` text. A popular posting or document may appear in many
    pairs, so both lookups are salted. Returns ``term_list, matched, missing`` arrays in posting
    order; a pair without terms keeps its row. ``described``, whether a posting has any text, is
    taken from ``terms`` or from ``postings`` (posting key and ``described``), if either has it; a
    posting that is not there has none.
    """
    lists = terms
    if "terms" not in terms.columns:
        lists = terms.groupBy(posting_key).agg(
            F.array_sort(F.collect_list(F.struct("line_no", "ord", "rank", "term_key", "term"))).alias("terms")
        )
    if postings is not None:
        lists = postings.select(posting_key, "described").join(lists, posting_key, "left")
    described = [F.col("described").alias("__described")] if "described" in lists.columns else []
    lists = lists.select(posting_key, F.col("terms").alias("__terms"), *described)
    joined = salted_join(pairs, lists, [posting_key], ["pair_id"], "left")
    joined = salted_join(joined, documents.select(document_key, "folded"), [document_key], ["pair_id"], "left", counted=pairs)
    # one-token terms are looked up among the document's tokens, the few longer ones in its text
    tokens = F.split(F.coalesce("folded", F.lit("")), "[ \n]+")
    of = F.coalesce("__terms", F.array().cast(f"array<{_TERM}>"))
    keyed = computed(joined.withColumn("__terms", of), __own=F.array_intersect(F.transform("__terms", lambda t: t["term_key"]), tokens))

    def hit(t: Column) -> Column:
        inside = F.contains(F.col("folded"), F.concat(F.lit(" "), t["term_key"], F.lit(" ")))
        return F.array_contains("__own", t["term_key"]) | F.coalesce(F.contains(t["term_key"], F.lit(" ")) & inside, F.lit(False))

    names = lambda arr: F.transform(arr, lambda t: t["term"])
    measured = computed(keyed, __hits=F.transform("__terms", lambda t: F.struct(hit(t).alias("hit"), t["term"].alias("term"))))
    return measured.select(
        *pairs.columns,
        names(F.col("__terms")).alias("term_list"),
        names(F.filter("__hits", lambda t: t["hit"])).alias("matched"),
        names(F.filter("__hits", lambda t: ~t["hit"])).alias("missing"),
        *([F.coalesce("__described", F.lit(False)).alias("described")] if described else []),
    )


def coverage_outcome(covered: DataFrame) -> DataFrame:
    """``kind, verdict, summary, error`` per pair; no posting text or no terms is "not measured"."""
    total, hit = F.size("term_list"), F.size("matched")
    described = F.col("described") if "described" in covered.columns else F.lit(True)
    measured = total > 0
    return covered.select(
        "pair_id",
        F.lit("keyword_coverage").alias("kind"),
        F.when(measured & (F.size("missing") == 0), "pass").otherwise("warn").alias("verdict"),
        F.when(measured, F.concat(hit.cast("string"), F.lit(" / "), total.cast("string"), F.lit(" JD terms")))
        .otherwise("Not measured")
        .alias("summary"),
        F.when(~described, "No job description attached, so there are no terms to cover.").when(~measured, "No terms could be read out of this job description.").alias("error"),
    )


# --- phrasing ---------------------------------------------------------------


_STOCK = "array<struct<pattern_no:int,phrase:string,suggestion:string>>"


def _may_be_stock(lower: Column) -> list[Column]:
    """Per pattern, whether the lower-cased text holds the letters one of its choices begins with."""
    def may_have(pattern: str) -> Column:
        stems = [re.match("[a-z ]+", choice)[0] for choice in pattern.removeprefix("{B}").split("|{B}")]
        return reduce(Column.__or__, [F.contains(lower, F.lit(stem)) for stem in stems])

    return [may_have(pattern) for pattern, _ in vocab.BOILERPLATE]


def _stock_phrases(text: Column, lower: Column) -> Column:
    """Every stock phrase of a text."""
    def found(i: int, pattern: str, suggestion: str) -> Column:
        regex = pattern.replace("{B}", T.EDGE_BEFORE).replace("{E}", T.EDGE_AFTER)
        return F.transform(
            F.regexp_extract_all(text, F.lit(f"(?i)({regex})"), 1),
            lambda m: F.struct(
                F.lit(i).alias("pattern_no"), m.alias("phrase"), F.lit(suggestion).alias("suggestion")
            ),
        )

    none = F.array().cast(_STOCK)
    return F.concat(*[F.when(may, found(i, *entry)).otherwise(none) for i, (may, entry) in enumerate(zip(_may_be_stock(lower), vocab.BOILERPLATE))])


def boilerplate(units: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Every stock phrase with its suggestion: ``keys, pattern_no, phrase, suggestion``."""
    rows = computed(units.select(*keys, text), __lower=F.lower(F.col(text)))
    maybe = reduce(Column.__or__, _may_be_stock(F.col("__lower")))
    return rows.where(maybe).select(*keys, F.inline(_stock_phrases(F.col(text), F.col("__lower"))))


def _may_stack(lower: Column) -> Column:
    endings = F.length(lower) - F.length(F.replace(lower, F.lit("ly"), F.lit("")))
    return endings >= 2 * vocab.ADVERB_STACK_THRESHOLD


def _adverbs(sentence: Column) -> Column:
    return F.filter(
        F.regexp_extract_all(sentence, F.lit(rf"(?i)({T.EDGE_BEFORE}[a-z]{{4,}}ly{T.EDGE_AFTER})"), 1),
        lambda w: ~F.lower(w).isin(*vocab.NOT_MANNER_ADVERBS),
    )


def _sentences(text: Column) -> Column:
    return F.split(text, rf"(?<=[.!?]){T.SPACE}+")


def adverb_stacks(units: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Sentences with three or more manner adverbs: ``keys, sentence_no, phrase, adverbs``."""
    sentences = units.where(_may_stack(F.lower(F.col(text)))).select(
        *keys, F.posexplode(_sentences(F.col(text))).alias("sentence_no", "sentence")
    )
    return (
        sentences.where(_may_stack(F.lower(F.col("sentence")))).withColumn("adverbs", _adverbs(F.col("sentence")))
        .where(F.size("adverbs") >= vocab.ADVERB_STACK_THRESHOLD)
        .select(*keys, "sentence_no", T.trim(F.col("sentence")).alias("phrase"), "adverbs")
    )


def phrase_flags(resumes: DataFrame, key: str) -> DataFrame:
    """All phrasing flags of a document: ``key, path, phrase, suggestion``.

    Both kinds are looked for in one pass over the prose.
    """
    units = L.prose_leaves(resumes, key).select(key, "path", "value")
    rows = computed(units, __lower=F.lower(F.col("value")))
    stacked = _may_stack(F.col("__lower"))
    stacks = F.transform(
        F.filter(
            F.transform(
                F.filter(_sentences(F.col("value")), lambda s: _may_stack(F.lower(s))),
                lambda s: F.struct(s.alias("s"), _adverbs(s).alias("adverbs")),
            ),
            lambda x: F.size(x["adverbs"]) >= vocab.ADVERB_STACK_THRESHOLD,
        ),
        lambda x: F.struct(
            F.lit(-1).alias("pattern_no"), T.trim(x["s"]).alias("phrase"),
            F.concat(
                F.lit("Three adverbs in one sentence ("), F.array_join(x["adverbs"], ", "),
                F.lit(") — keep the strongest verb and drop the rest."),
            ).alias("suggestion"),
        ),
    )
    maybe = reduce(Column.__or__, _may_be_stock(F.col("__lower")), stacked)
    found = F.concat(_stock_phrases(F.col("value"), F.col("__lower")), F.when(stacked, stacks).otherwise(F.array().cast(_STOCK)))
    return rows.where(maybe).select(key, "path", F.inline(found)).select(key, "path", "phrase", "suggestion")


# --- lint -------------------------------------------------------------------


def long_bullets(bullets: DataFrame, key: str) -> DataFrame:
    n = T.word_count(F.col("text"))
    return bullets.where(n > vocab.MAX_BULLET_WORDS).select(
        key, "leaf_no", F.lit("bullet-too-long").alias("code"), "path",
        F.concat(
            F.col("path"), F.lit(" runs "), n.cast("string"),
            F.lit(f" words; past {vocab.MAX_BULLET_WORDS} a bullet wraps to three or more lines on the page."),
        ).alias("detail"),
    )


def first_person(bullets: DataFrame, key: str) -> DataFrame:
    opener = F.regexp_extract(T.trim(F.col("text")), vocab.FIRST_PERSON, 0)
    return bullets.where(opener != "").select(
        key, "leaf_no", F.lit("first-person").alias("code"), "path",
        F.concat(
            F.col("path"), F.lit(" opens with “"), opener,
            F.lit("”; every other bullet starts with a verb."),
        ).alias("detail"),
    )


def repeated_bullets(bullets: DataFrame, key: str) -> DataFrame:
    """Bullets whose normalised text came before in the same document.

    The group is one text inside one document, so it is bounded by that document's row.
    """
    seen = Window.partitionBy(key, "__k").orderBy("leaf_no")
    return (
        bullets.withColumn("__k", T.bullet_key(F.col("text")))
        .where(F.col("__k") != "")
        .withColumn("__first", F.first("path").over(seen))
        .where(F.col("path") != F.col("__first"))
        .select(
            key, "leaf_no", F.lit("duplicate-bullet").alias("code"), "path",
            F.concat(F.col("path"), F.lit(" repeats the text already at "), F.col("__first"), F.lit(", word for word.")).alias("detail"),
        )
    )


def mixed_punctuation(bullets: DataFrame, key: str) -> DataFrame:
    """Bullets on the smaller side of full stop or none; a tie names the side with stops."""
    stop = T.trim(F.col("text")).endswith(".")
    doc = Window.partitionBy(key)
    counted = bullets.withColumn("__stop", stop).withColumns(
        {
            "__with": F.sum(F.col("__stop").cast("int")).over(doc),
            "__without": F.sum((~F.col("__stop")).cast("int")).over(doc),
        }
    )
    flag_with = F.col("__with") <= F.col("__without")
    majority = F.greatest("__with", "__without")
    return counted.where(
        (F.col("__with") > 0) & (F.col("__without") > 0) & (F.col("__stop") == flag_with)
    ).select(
        key, "leaf_no", F.lit("trailing-punctuation-mixed").alias("code"), "path",
        F.concat(
            F.col("path"), F.lit(" "),
            F.when(flag_with, "ends with a period").otherwise("ends without a period"),
            F.lit(", while "), majority.cast("string"), F.lit(" other "), T.plural(majority, "bullet"),
            F.lit(" end "), F.when(flag_with, "without one").otherwise("with one"), F.lit("."),
        ).alias("detail"),
    )


def mixed_dates(date_rows: DataFrame, key: str) -> DataFrame:
    """Dates not in the document's commonest shape; the earliest shape wins a tie.

    ``date_rows`` has ``key, leaf_no, path, text``. Only counts per shape meet per document.
    """
    shaped = date_rows.withColumn("__shape", D.date_shape(F.col("text")))
    per_shape = shaped.groupBy(key, "__shape").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("leaf_no", "text")).alias("first")
    )
    main = per_shape.groupBy(key).agg(
        F.max_by(F.struct("__shape", "n", "first.text"), F.struct("n", -F.col("first.leaf_no"))).alias("m"),
        F.count(F.lit(1)).alias("shapes"),
    ).where(F.col("shapes") > 1)
    return shaped.join(main, key).where(F.col("__shape") != F.col("m.__shape")).select(
        key, "leaf_no", F.lit("date-format-mixed").alias("code"), "path",
        F.concat(
            F.col("path"), F.lit(" reads “"), F.col("text"), F.lit("” while "), F.col("m.n").cast("string"),
            F.lit(" other dates use the “"), F.col("m.text"), F.lit("” form."),
        ).alias("detail"),
    )


def stale_end(ends: DataFrame, key: str, now: Column) -> DataFrame:
    """Documents whose newest job ended long ago.

    ``ends`` has one row per job: ``key, entry, end`` with ``end`` null when absent. One
    ongoing or unreadable end silences the document.
    """
    blank = F.coalesce(T.trim(F.col("end")), F.lit("")) == ""
    ongoing = blank | D.is_ongoing(F.col("end"))
    month = D.end_month_index(F.col("end"))
    folded = ends.withColumn("__m", month).groupBy(key).agg(
        F.max(F.coalesce(ongoing, F.lit(True)) | F.col("__m").isNull()).alias("silent"),
        F.max_by(F.struct("entry", "end"), F.struct("__m", -F.col("entry"))).alias("last"),
        F.max("__m").alias("__m"),
    )
    months = D.month_index(F.year(now), F.month(now)) - F.col("__m")
    years = F.floor(months / 12).cast("int")
    path = F.concat(F.lit("experience["), F.col("last.entry").cast("string"), F.lit("].end"))
    return folded.where(~F.col("silent") & (months > vocab.STALE_END_MONTHS)).select(
        key, F.col("last.entry").alias("leaf_no"), F.lit("stale-end-date").alias("code"), path.alias("path"),
        F.concat(
            path, F.lit(" reads “"), T.trim(F.col("last.end")), F.lit("”, about "), years.cast("string"), F.lit(" "),
            T.plural(years, "year"),
            F.lit(" ago, and no role is marked current. If it is current, say Present; if not, one line naming the break saves the reader guessing."),
        ).alias("detail"),
    )


def _issue(rule: int, leaf_no: Column, path: Column, *detail: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), leaf_no.cast("int").alias("leaf_no"), F.lit(vocab.LINT_RULES[rule]).alias("code"),
        path.alias("path"), F.concat(*detail).alias("detail"),
    )


def _bullet_issues(bullets: Column) -> list[Column]:
    """Rules on one bullet at a time."""
    def long(b: Column) -> Column:
        def judge(n: Column) -> Column:
            return F.when(
                n > vocab.MAX_BULLET_WORDS,
                _issue(0, b["leaf_no"], b["path"], b["path"], F.lit(" runs "), n.cast("string"),
                       F.lit(f" words; past {vocab.MAX_BULLET_WORDS} a bullet wraps to three or more lines on the page.")),
            )

        # a shorter text has no room for so many words; the blanks between them count
        n = F.when(F.length(b["text"]) > 2 * vocab.MAX_BULLET_WORDS, T.word_count(b["text"]))
        return F.get(F.transform(F.array(n), judge), 0)

    def opener(b: Column) -> Column:
        # the longest opener has four characters, and what follows it decides
        found = F.regexp_extract(F.left(F.ltrim(b["text"], F.lit(T.WHITE)), F.lit(8)), vocab.FIRST_PERSON, 0)
        return F.when(
            found != "",
            _issue(1, b["leaf_no"], b["path"], b["path"], F.lit(" opens with “"), found,
                   F.lit("”; every other bullet starts with a verb.")),
        )

    return [F.transform(bullets, long), F.transform(bullets, opener)]


def _repeat_issues(ranked: Column, keys: Column) -> Column:
    """``ranked`` holds (key, leaf_no, path) in order, ``keys`` its keys: equal keys are neighbours."""
    def repeat(b: Column, i: Column) -> Column:
        same = (b["k"] != "") & (i > 0) & (F.get(keys, i - 1) == b["k"])
        first = F.get(ranked, F.array_position(keys, b["k"]).cast("int") - 1)["path"]
        return F.when(
            same,
            _issue(2, b["leaf_no"], b["path"], b["path"], F.lit(" repeats the text already at "), first,
                   F.lit(", word for word.")),
        )

    return F.transform(ranked, repeat)


def _punctuation_issues(stops: Column, with_stop: Column, without: Column) -> Column:
    flag_with = with_stop <= without
    majority = F.greatest(with_stop, without)

    def mixed(b: Column) -> Column:
        return F.when(
            (with_stop > 0) & (without > 0) & (b["stop"] == flag_with),
            _issue(3, b["leaf_no"], b["path"], b["path"], F.lit(" "),
                   F.when(flag_with, "ends with a period").otherwise("ends without a period"),
                   F.lit(", while "), majority.cast("string"), F.lit(" other "), T.plural(majority, "bullet"),
                   F.lit(" end "), F.when(flag_with, "without one").otherwise("with one"), F.lit(".")),
        )

    return F.transform(stops, mixed)


def _date_issues(shaped: Column) -> Column:
    """Dates whose shape is not the commonest; the earliest shape wins a tie."""
    names = [name for name, _, _ in vocab.DATE_SHAPES] + ["other"]
    counts = F.transform(
        F.array(*[F.lit(n) for n in names]),
        lambda n: F.struct(
            F.size(F.filter(shaped, lambda d: d["shape"] == n)).alias("n"),
            (-F.get(F.filter(shaped, lambda d: d["shape"] == n), 0)["leaf_no"]).alias("first"),
            F.get(F.filter(shaped, lambda d: d["shape"] == n), 0)["text"].alias("text"),
            n.alias("shape"),
        ),
    )
    main = F.array_max(F.filter(counts, lambda c: c["n"] > 0))
    # Bound once: an array of one element carries the winner into the inner function.
    return F.flatten(
        F.transform(
            F.array(main),
            lambda m: F.transform(
                shaped,
                lambda d: F.when(
                    d["shape"] != m["shape"],
                    _issue(4, d["leaf_no"], d["path"], d["path"], F.lit(" reads “"), d["text"], F.lit("” while "),
                           m["n"].cast("string"), F.lit(" other dates use the “"), m["text"], F.lit("” form.")),
                ),
            ),
        )
    )


def _stale_issue(ends: Column, now: Column) -> Column:
    """``ends`` has ``i, text, month, silent`` per job; one silent job silences the rule."""
    latest = F.array_max(F.transform(ends, lambda e: F.struct(e["month"].alias("m"), (-e["i"]).alias("i"), e["text"].alias("t"))))

    def judge(e: Column) -> Column:
        months = D.month_index(F.year(now), F.month(now)) - e["m"]
        years = F.floor(months / 12).cast("int")
        path = F.concat(F.lit("experience["), (-e["i"]).cast("string"), F.lit("].end"))
        return F.when(
            e["m"].isNotNull() & ~F.exists(ends, lambda x: x["silent"]) & (months > vocab.STALE_END_MONTHS),
            _issue(5, -e["i"], path, path, F.lit(" reads “"), e["t"], F.lit("”, about "), years.cast("string"), F.lit(" "),
                   T.plural(years, "year"),
                   F.lit(" ago, and no role is marked current. If it is current, say Present; if not, one line naming the break saves the reader guessing.")),
        )

    return F.transform(F.array(latest), judge)


def _skill_issues(skills: Column) -> Column:
    def crowded(g: Column, i: Column) -> Column:
        at = F.concat(F.lit("skills["), i.cast("string"), F.lit("]"))
        return F.when(
            F.size(g["items"]) > vocab.MAX_SKILL_GROUP_ITEMS,
            _issue(6, i, at, at, F.lit(" ("), F.coalesce(F.nullif(g["category"], F.lit("")), F.lit("untitled group")),
                   F.lit(") lists "), F.size(g["items"]).cast("string"),
                   F.lit(" items in one group; splitting it, or cutting to the ones this role is about, tells a reader which ones you would be hired for.")),
        )

    return F.transform(skills, crowded)


def lint(resumes: DataFrame, key: str, now: Column) -> DataFrame:
    """All lint issues: ``key, rule, leaf_no, code, path, detail``; order by rule, leaf_no.

    A document's bullets and dates are all in its own row, so every rule is evaluated
    there, in one pass, and nothing is shuffled.
    """
    content = F.col("content")
    rows = computed(
        resumes.select(key, "content"),
        all_leaves=L.leaf_array(content, sections=[s for s in L.SECTIONS if s != "skills"]),
        skill_leaves=F.array_size(F.flatten(F.transform(content["skills"], lambda g: g["items"]))) + F.array_size(content["skills"]),
        ends=F.transform(
            content["experience"],
            lambda e, i: F.struct(
                i.alias("i"), T.trim(e["end"]).alias("text"), D.end_month_index(e["end"]).alias("month"),
                (
                    (F.coalesce(T.trim(e["end"]), F.lit("")) == "")
                    | F.coalesce(D.is_ongoing(e["end"]), F.lit(True))
                    | D.end_month_index(e["end"]).isNull()
                ).alias("silent"),
            ),
        ),
        crowded=_skill_issues(content["skills"]),
        empty=F.transform(
            L.empty_entries(content),
            lambda m, n: F.struct(
                F.lit(7).alias("rule"), n.cast("int").alias("leaf_no"), F.lit(vocab.LINT_RULES[7]).alias("code"),
                m["path"].alias("path"), m["detail"].alias("detail"),
            ),
        ),
    ).drop("content")
    # leaf_no counts every leaf, blank ones and the items of skills included; no rule reads the text of these.
    numbered = F.transform(
        "all_leaves",
        lambda l, i: F.struct(
            (i + F.when(l["section"].isin("projects", "custom"), F.col("skill_leaves")).otherwise(0)).alias("leaf_no"),
            l["section"].alias("section"), l["key"].alias("key"), l["path"].alias("path"), F.coalesce(l["value"], F.lit("")).alias("text"),
        ),
    )
    read = F.filter(numbered, lambda l: l["key"].isin("bullets", "start", "end") & T.filled(l["text"]))
    rows = computed(rows, leaves=F.when(F.col("skill_leaves").isNotNull(), read)).drop("all_leaves", "skill_leaves")
    dated = F.filter(
        "leaves",
        lambda l: l["section"].isin("experience", "education") & l["key"].isin("start", "end") & ~D.is_ongoing(l["text"]),
    )
    rows = computed(
        rows,
        bullets=F.filter("leaves", lambda l: l["key"] == "bullets"),
        dates=F.transform(
            dated,
            lambda d: F.struct(
                d["leaf_no"].alias("leaf_no"), d["path"].alias("path"), T.trim(d["text"]).alias("text"),
                D.date_shape(T.trim(d["text"])).alias("shape"),
            ),
        ),
    ).drop("leaves")
    rows = computed(
        rows,
        ranked=F.array_sort(
            F.transform(
                "bullets",
                lambda b: F.struct(T.bullet_key(b["text"]).alias("k"), b["leaf_no"].alias("leaf_no"), b["path"].alias("path")),
            )
        ),
        stops=F.transform(
            "bullets",
            lambda b: F.struct(b["leaf_no"].alias("leaf_no"), b["path"].alias("path"), F.rtrim(b["text"], F.lit(T.WHITE)).endswith(".").alias("stop")),
        ),
    )
    rows = computed(
        rows,
        ranked_keys=F.transform("ranked", lambda r: r["k"]),
        with_stop=F.size(F.filter("stops", lambda b: b["stop"])),
        without=F.size(F.filter("stops", lambda b: ~b["stop"])),
    )
    found = F.concat(
        *_bullet_issues(F.col("bullets")),
        _repeat_issues(F.col("ranked"), F.col("ranked_keys")),
        _punctuation_issues(F.col("stops"), F.col("with_stop"), F.col("without")),
        _date_issues(F.col("dates")),
        _stale_issue(F.col("ends"), now),
        F.col("crowded"),
    )
    none = F.array().cast("array<struct<rule:int,leaf_no:int,code:string,path:string,detail:string>>")
    issues = F.concat(F.coalesce(F.filter(found, lambda i: i.isNotNull()), none), F.coalesce("empty", none))
    return rows.select(key, F.inline(issues))


def _counted(documents: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Documents with ``n`` findings; a clean document keeps its row with 0."""
    counts = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return documents.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def lint_outcome(documents: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    n = F.col("n")
    return _counted(documents, issues, key).select(
        key, F.lit("format_lint").alias("kind"),
        F.when(n == 0, "pass").otherwise("warn").alias("verdict"),
        F.when(n == 0, "clean").otherwise(F.concat(n.cast("string"), F.lit(" "), T.plural(n, "issue"))).alias("summary"),
        F.lit(None).cast("string").alias("error"),
    )


def phrasing_outcome(documents: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    n = F.col("n")
    return _counted(documents, flags, key).select(
        key, F.lit("ai_tell").alias("kind"),
        F.when(n == 0, "pass").otherwise("warn").alias("verdict"),
        F.when(n == 0, "clean").otherwise(
            F.concat(n.cast("string"), F.lit(" "), T.plural(n, "phrase"), F.lit(" flagged"))
        ).alias("summary"),
        F.lit(None).cast("string").alias("error"),
    )


# --- fidelity and confidence ------------------------------------------------


def _beside(resumes: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """``key, content, back``: each document with its re-parsed one, or null; the one join here."""
    return resumes.select(key, "content").join(parsed.select(key, F.col("content").alias("back")), key, "left")


def _survived() -> Column:
    value, back = F.col("value"), F.col("back")
    return T.filled(value) & F.coalesce((value == back) | (T.filled(back) & (T.plain(value) == T.plain(back))), F.lit(False))


def dropped_leaves(resumes: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Leaves with ``survived``: the re-parsed document has the same text at the same path."""
    rows = _beside(resumes, parsed, key).select(key, F.posexplode(L.leaf_array(F.col("content"), F.col("back"))).alias("leaf_no", "l"))
    return rows.select(key, "leaf_no", "l.*").where(T.filled(F.col("value"))).withColumn("survived", _survived()).drop("back")


def _marks(content: Column, strict: bool) -> Column:
    """Per section and entry the digests of its texts, plain fields first; null where a text is blank.

    ``basics`` is a section of one entry. With ``strict`` a list that is null makes its entry null; otherwise the texts beside it stay.
    """
    mark = lambda v: F.when(T.filled(v), F.xxhash64(T.plain(v)))

    def section(name: str) -> Column:
        fields, items = L.SECTIONS[name]

        def entry(e: Column) -> Column:
            listed = F.transform(e[items], mark)
            return F.concat(F.array(*[mark(e[f]) for f in fields]), listed if strict else F.coalesce(listed, F.array().cast("array<bigint>")))

        return F.transform(content[name], entry)

    return F.array(F.array(F.array(*[mark(content["basics"][k]) for k in L.BASICS])), *[section(s) for s in L.SECTIONS])


def fidelity(resumes: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """``key, dropped, checked, structural_loss, verdict, summary``.

    A document the parser could not read has no row in ``parsed`` and is "not measured". The two
    meet as 64-bit digests of their plain texts, address by address, and not as texts.
    """
    def sizes(content: str) -> Column:
        return F.array(*[F.size(F.col(f"{content}.{section}")) for section in L.SECTIONS])

    before = computed(resumes.select(key, "content"), marks=_marks(F.col("content"), True), sizes=sizes("content")).select(key, "marks", "sizes")
    after = computed(
        parsed.select(key, "content"), back=F.when(F.col("content").isNotNull(), _marks(F.col("content"), False)), back_sizes=sizes("content")
    ).select(key, "back", "back_sizes")
    pair = before.join(after, key, "left")
    lost = F.lit(False)
    for n in range(len(L.SECTIONS)):
        was, now = F.get("sizes", F.lit(n)), F.get("back_sizes", F.lit(n))
        lost = lost | ((was > 0) & (now < was))
    measured = F.col("back").isNotNull()

    def beside(s: Column, n: Column) -> Column:
        other = F.get("back", n)
        return F.flatten(F.transform(s, lambda e, i: F.transform(e, lambda m, j: F.struct(m.alias("m"), F.get(F.get(other, i), j).alias("o")))))

    # null if any list of the document is
    filled = F.filter(F.flatten(F.transform("marks", beside)), lambda x: x["m"].isNotNull())
    counted = pair.select(
        key, measured.alias("measured"), (measured & F.coalesce(lost, F.lit(False))).alias("structural_loss"),
        F.coalesce(F.size(filled), F.lit(0)).alias("checked"),
        F.coalesce(F.size(F.filter(filled, lambda x: ~F.coalesce(x["m"] == x["o"], F.lit(False)))), F.lit(0)).alias("dropped"),
    )
    joined = counted.groupBy(key, "measured", "structural_loss").agg(
        F.sum(F.greatest("checked", F.lit(0))).alias("checked"), F.sum(F.greatest("dropped", F.lit(0))).alias("dropped")
    )
    dropped = F.when(F.col("measured"), F.coalesce("dropped", F.lit(0))).otherwise(F.lit(0).cast("long"))
    checked = F.when(F.col("measured"), F.coalesce("checked", F.lit(0))).otherwise(F.lit(0).cast("long"))
    ratio = dropped / F.greatest(checked, F.lit(1))
    return joined.select(
        key,
        dropped.alias("dropped"),
        checked.alias("checked"),
        "structural_loss",
        F.when(~F.col("measured"), "warn")
        .when(dropped == 0, "pass")
        .when(F.col("structural_loss"), "fail")
        .when(ratio > vocab.FIDELITY_FAIL_RATIO, "fail")
        .otherwise("warn")
        .alias("verdict"),
        F.when(
            F.col("measured"),
            F.concat(dropped.cast("string"), F.lit(" of "), checked.cast("string"), F.lit(" fields dropped")),
        ).otherwise("Not measured").alias("summary"),
        F.when(~F.col("measured"), "The ATS parser could not read this résumé.").alias("error"),
    )


def import_confidence(resumes: DataFrame, key: str, source_text: str) -> DataFrame:
    """Each leaf with 1.0 when it is in the source text, else a lower, fixed confidence.

    ``resumes`` carries its source text, so the text is searched in place and only leaves leave the row.
    """
    rows = resumes.withColumn("__hay", T.plain(F.col(source_text))).select(
        key, "__hay", F.posexplode(L.leaf_array(F.col("content"))).alias("leaf_no", "l")
    )
    value = F.col("l.value")
    return rows.where(F.coalesce(value, F.lit("")) != "").select(
        key, "leaf_no", F.col("l.path").alias("path"), value.alias("value"),
        F.when(F.contains(F.col("__hay"), T.plain(value)), F.lit(1.0))
        .when(F.col("l.key").isin("start", "end"), F.lit(vocab.REFORMATTED_CONFIDENCE))
        .otherwise(F.lit(vocab.INFERRED_CONFIDENCE))
        .alias("confidence"),
    )


def low_confidence(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("confidence") < 1)


def field_recall(labelled: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Per document, how many labelled leaves were read back exactly."""
    rows = _beside(labelled, parsed, key).select(key, F.explode(L.leaf_array(F.col("content"), F.col("back"))).alias("l"))
    return rows.select(key, "l.value", "l.back").where(T.filled(F.col("value"))).groupBy(key).agg(
        F.count(F.lit(1)).alias("labelled"), F.count_if(F.coalesce(F.col("value") == F.col("back"), F.lit(False))).alias("found")
    ).withColumn("recall", F.col("found") / F.col("labelled"))


# --- all checks -------------------------------------------------------------


def rating_outcome(documents: DataFrame, ratings: DataFrame, key: str) -> DataFrame:
    """Tier and number of reasons as a check; unrated is "not measured"."""
    from ..functions.fields import tier_verdict, tier_word

    joined = documents.select(key).join(ratings.select(key, "tier", "reason_count"), key, "left")
    rated, n = F.col("tier").isNotNull(), F.col("reason_count")
    return joined.select(
        key, F.lit("match_rating").alias("kind"),
        F.coalesce(tier_verdict(F.col("tier")), F.lit("warn")).alias("verdict"),
        F.when(rated, F.concat(tier_word(F.col("tier")), F.lit(" — "), n.cast("string"), F.lit(" "), T.plural(n, "reason")))
        .otherwise("Not measured — no model configured").alias("summary"),
        F.when(~rated, "No rating was returned.").alias("error"),
    )


def all_checks(documents: DataFrame, outcomes: Sequence[DataFrame], key: str) -> DataFrame:
    """Exactly five rows per document in fixed kind order; a missing check is "not measured"."""
    kinds = F.array(
        *[F.struct(F.lit(i).alias("kind_no"), F.lit(k).alias("kind")) for i, k in enumerate(vocab.CHECK_KINDS)]
    )
    wanted = documents.select(key, F.inline(kinds))
    columns = [key, "kind", "verdict", "summary", "error"]
    got = None
    for outcome in outcomes:
        part = outcome.select(*columns)
        got = part if got is None else got.unionByName(part)
    joined = wanted.join(got, [key, "kind"], "left")
    absent = F.col("verdict").isNull()
    return joined.select(
        key, "kind_no", "kind",
        F.coalesce("verdict", F.lit("warn")).alias("verdict"),
        F.coalesce("summary", F.lit("Not measured")).alias("summary"),
        F.when(absent, "This check failed to run.").otherwise(F.col("error")).alias("error"),
    )


def latest_checks(results: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest reading per key and kind."""
    rest = [c for c in results.columns if c not in (*keys, "kind")]
    return results.groupBy(*keys, "kind").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    ).select(*keys, "kind", "__r.*")
