"""Secret scans behind a trigram index.

Each rule's regular expression is turned into a Boolean query over the three-character strings that
every match must contain. An inverted index lists the texts with each of those trigrams; queries
intersect and unite the lists, and only the remaining texts are matched against the expression. A
rule without mandatory trigrams is matched against all texts. Everything on the data is column
expressions; only the rules, which are a fixed list, are taken apart on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.once import computed
from ..plans.skew import fits_broadcast
from ..session import cut
from .common import free, own_columns

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The contract's kinds in its order; positions break ties between spans.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Published token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{20,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A rule's alternatives are multiplied out up to this many strings.
_STRINGS = 64


# A query is True (no condition), a trigram, or ("and" | "or", frozenset of queries).
def _all(*parts):
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts):
    parts = frozenset(parts)
    return True if True in parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _holds(strings: set[str]):
    """What a text has to contain if it contains one of ``strings``."""
    grams = [{s[i : i + 3] for i in range(len(s) - 2)} for s in strings]
    return _any(_all(*g) for g in grams)


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(all strings that match, if few; what a match must contain) of a parsed expression."""
    run, need, exact = {""}, True, True

    def close():
        nonlocal run, need, exact
        need, run, exact = _all(need, _holds(run)), {""}, False

    for op, arg in nodes:
        strings, inner = None, True
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            found = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    found.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < _STRINGS:
                    found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    found = None
                    break
            strings = found
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            each = [_walk(b) for b in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*[s for s, _ in each])
            inner = _any(_all(q, True if s is None else _holds(s)) for s, q in each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            some, inside = _walk(body)
            if some is not None and (low, high) in ((0, 1), (1, 1)):
                strings = some | ({""} if low == 0 else set())
            elif low:
                inner = _all(inside, True if some is None else _holds(some))
        elif op is sre.AT:
            strings = {""}
        if strings is None or len(run) * len(strings) > _STRINGS:
            close()
            need = _all(need, inner)
            if strings is not None and len(strings) <= _STRINGS and op is not sre.IN:
                run = set(strings)
        else:
            run = {a + b for a in run for b in strings}
    return (run, need) if exact else (None, _all(need, _holds(run)))


def trigram_query(pattern: str):
    """The Boolean trigram query of an expression, over texts with A-Z as a-z; True if it has none."""
    strings, need = _walk(sre_parse.parse(pattern))
    return _all(need, True if strings is None else _holds(strings))


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams(q) for q in query[1]])


def _node(text: Column) -> Column:
    """The text's identity in the index: equal texts share their postings."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(3), text).alias("b"))


def postings(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """The inverted index: (trigram, node) for each wanted trigram and text that contains it."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = computed(docs.select(_node(t).alias("node"), t.alias("t")), low=F.lower("t"))
    here = F.filter(F.array(*[F.lit(g) for g in wanted]), lambda g: F.col("low").contains(g))
    return low.select(F.explode(here).alias("trigram"), "node")


def candidates(index: DataFrame, rules: tuple[Rule, ...], wanted: list[str]) -> DataFrame:
    """(node, rules): which rules' queries a text's trigrams satisfy, a bit each. Lists are intersected by text."""
    bit = {g: i for i, g in enumerate(wanted)}
    words = 1 + len(wanted) // 63
    marks = []
    for k in range(words):
        values = [x for g, i in bit.items() if i // 63 == k for x in (F.lit(g), F.lit(1 << i % 63).cast("long"))]
        mark = F.create_map(*values)[F.col("trigram")] if values else F.lit(None).cast("long")
        marks.append(F.coalesce(mark, F.lit(0).cast("long")))
    marked = index.select("node", *[m.alias(f"m{k}") for k, m in enumerate(marks)])
    met = marked.groupBy("node").agg(*[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(words)])

    def test(query) -> Column:
        if isinstance(query, str):
            k, i = divmod(bit[query], 63)
            return F.col(f"m{k}").bitwiseAND(F.lit(1 << i)) != 0
        out = None
        for q in sorted(query[1], key=repr):
            out = test(q) if out is None else out & test(q) if query[0] == "and" else out | test(q)
        return out

    bits = F.lit(0)
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query is not True:
            bits = bits.bitwiseOR(F.when(test(query), F.lit(1 << i)).otherwise(F.lit(0)))
    return met.select("node", bits.alias("rules")).where("rules <> 0")


def _spans(text: Column, rule: Rule, rank: int, wanted: Column) -> Column:
    """The rule's spans in a text: (start, rank, kind, end) in code points.

    Splitting at the matches gives the stretches between them; a match begins after all stretches
    and matches before it.
    """
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    pattern = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(
        F.slice(F.transform(between, F.length), 1, F.size(whole)), F.transform(whole, F.length),
        lambda a, b: F.struct(a.alias("gap"), b.alias("size")),
    )
    sizes = F.zip_with(sizes, part, lambda s, p: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(p).alias("len")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + s["gap"]
        end = begin + s["size"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        more = F.when(s["len"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    found = F.aggregate(sizes, start, step, lambda s: s["out"])
    return F.when(wanted, found).otherwise(F.array().cast(kind))


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``__spans``: an array of (start, rank, kind, end), by start and then rule.

    Candidates are copied to the executors if their checked size allows and joined otherwise. A null
    text counts as empty and has no spans. Equal texts have equal spans; repeated rows stay.
    """
    q = free(docs)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*[trigrams(q) for q in queries]))
    t = F.coalesce(F.col(text), F.lit(""))
    found = candidates(postings(docs, wanted, text), rules, wanted)
    found = cut(found.select(F.col("node.a").alias(f"{q}a"), F.col("node.b").alias(f"{q}b"), F.col("rules").alias(f"{q}rules")))
    if fits_broadcast(found):
        found = F.broadcast(found)
    key = _node(t)
    keyed = docs.withColumns({f"{q}ka": key["a"], f"{q}kb": key["b"]})
    joined = keyed.join(found, (F.col(f"{q}ka") == F.col(f"{q}a")) & (F.col(f"{q}kb") == F.col(f"{q}b")), "left")
    each = []
    for i, (rule, query) in enumerate(zip(rules, queries)):
        asked = t.rlike(rule.pattern) if query is True else F.coalesce(F.col(f"{q}rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        each.append(_spans(t, rule, i, asked))
    out = computed(joined, **{f"{q}spans": F.array_sort(F.concat(*each))})
    return out.select(*own_columns(docs, "__spans"), F.col(f"{q}spans").alias("__spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


