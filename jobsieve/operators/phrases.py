"""Many phrases in many lines: one automaton over token numbers, run once along each line.

The phrase table, if its size allows a copy to every task, becomes an automaton whose states are the
beginnings of phrases; a line's folded tokens are followed through it, so a line costs its length and
what is found, however many phrases there are and however they overlap. A larger phrase table is
looked up by an equi-join of grams, which are hashes with the line's key: the text itself is joined
back only for lines that hold the beginning of a phrase.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..plans.skew import fits_broadcast

#: Tokens of the part of a phrase by which lines are looked up in the join.
ANCHOR_TOKENS = 3


class Automaton:
    """Finds all of the given token lists in a token list in one pass."""

    def __init__(self, phrases: Sequence[Sequence[str]]) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for number, phrase in enumerate(phrases):
            state = 0
            for token in phrase:
                after = self.steps[state].get(token)
                if after is None:
                    after = self.steps[state][token] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(-1)
                state = after
            self.ends[state] = number
        # Where to go on when no longer beginning fits, and the next shorter phrase that ends here.
        self.shorter, self.inner = [0] * len(self.steps), [-1] * len(self.steps)
        queue = deque(self.steps[0].values())
        while queue:
            state = queue.popleft()
            for token, after in self.steps[state].items():
                back = self.shorter[state]
                while back and token not in self.steps[back]:
                    back = self.shorter[back]
                fall = self.steps[back].get(token, 0)
                self.shorter[after] = fall if fall != after else 0
                queue.append(after)
            fall = self.shorter[state]
            self.inner[state] = fall if self.ends[fall] >= 0 else self.inner[fall]

    def found(self, tokens: Sequence[str]) -> set[int]:
        """Numbers of the phrases that occur."""
        out: set[int] = set()
        state, steps, shorter, inner, ends = 0, self.steps, self.shorter, self.inner, self.ends
        for token in tokens:
            after = steps[state].get(token)
            while after is None and state:
                state = shorter[state]
                after = steps[state].get(token)
            state = after or 0
            if not state:
                continue
            at = state if ends[state] >= 0 else inner[state]
            while at > 0 and ends[at] not in out:
                out.add(ends[at])
                at = inner[at]
        return out


def _follow(phrases: Sequence[str]):
    """Counts, per document and batch, the lines in which each phrase occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([p.split(" ") for p in phrases])
        for batch in batches:
            found: Counter[tuple[int, int]] = Counter()
            docs = batch.column(0).dictionary_encode()
            for doc, line in zip(docs.indices.to_pylist(), batch.column(1).to_pylist()):
                for number in automaton.found(line.split(" ")) if line else ():
                    found[doc, number] += 1
            if found:
                at = pa.array([doc for doc, _ in found], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.DictionaryArray.from_arrays(at, docs.dictionary).dictionary_decode(),
                        pa.array([phrases[n] for _, n in found]), pa.array(list(found.values()), pa.int64()),
                    ],
                    names=["doc_id", "term_key", "lines"],
                )

    return run


def phrase_hits(phrases: DataFrame, lines: DataFrame, **limits) -> DataFrame:
    """Which documents contain which phrases of any length: ``phrase_id, doc_id, lines``.

    ``phrases`` has ``phrase_id, term_key``; ``lines`` has ``doc_id, line_no, text``, once per line. A phrase is in a
    line if its folded tokens stand there one after the other; none crosses from one line into the next.
    ``limits`` bound the phrase table that is copied to the tasks.
    """
    asked = phrases.where(F.col("term_key") != "").select("phrase_id", "term_key")
    if not fits_broadcast(asked, **limits):
        return _joined(asked, lines)
    keys = sorted({r[0] for r in asked.select("term_key").distinct().collect()})  # its size was checked
    kind = lines.schema["doc_id"].dataType.simpleString()
    folded = lines.where(F.col("text").isNotNull()).select("doc_id", T.term_key(F.col("text")).alias("key"))
    found = folded.mapInArrow(_follow(keys), f"doc_id {kind}, term_key string, lines long")
    return (
        found.groupBy("term_key", "doc_id").agg(F.sum("lines").alias("lines"))
        .join(F.broadcast(asked), "term_key").select("phrase_id", "doc_id", "lines")
    )


def _joined(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """The same for a phrase table of any size."""
    words = F.split("key", " ")
    folded = lines.select("doc_id", "line_no", T.term_key(F.col("text")).alias("key")).where(F.col("key") != "")
    anchor = lambda toks, i, n: F.xxhash64(F.array_join(F.slice(toks, i, n), " "))

    def grams(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: anchor(words, i, n))

    places = folded.select("doc_id", "line_no", F.explode(F.array_distinct(F.concat(*[grams(n + 1) for n in range(ANCHOR_TOKENS)]))).alias("gram"))
    parts = F.split("term_key", " ")
    by = asked.select("term_key", anchor(parts, 1, ANCHOR_TOKENS).alias("gram")).distinct()
    # an anchor shared by very many lines or phrases is split by the adaptive skew join
    met = places.join(by, "gram").select(F.col("doc_id").alias("__doc"), F.col("line_no").alias("__line"), "term_key")
    whole, phrase = (F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in ("key", "term_key"))
    same = F.col("__doc").eqNullSafe(F.col("doc_id")) & F.col("__line").eqNullSafe(F.col("line_no"))
    hits = met.join(folded, same).where(F.contains(whole, phrase))
    return hits.groupBy("term_key", "doc_id").agg(F.count(F.lit(1)).alias("lines")).join(asked, "term_key").select("phrase_id", "doc_id", "lines")
