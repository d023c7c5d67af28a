"""Roles of transcript lines by a hidden Markov model, and turns in one canonical form.

Transcripts are lines whose speaker is marked in many ways or not at all. Roles are hidden states;
a line shows its speaker marker and a few features of its text. Viterbi finds the best sequence of
roles, then lines of one speaker become turns.

A transcript of any length is decoded in blocks: lines are put in one order and numbered, a block
is a fixed count of lines. A conversation that crosses block borders sends one matrix per block, its
best score from each first to each last role. Chaining these fixes the roles at the borders, and each
block is then decoded by itself. The path has exactly the undivided path's score; of paths with equal
scores the one that enters a block by the first role of the list is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.once import computed
from ..plans.scan import global_position, running

ROLES = ("system", "user", "assistant")
#: Usual speaker markers at the start of a line.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model"),
}
_ANY = "|".join(w for words in MARKERS.values() for w in words)
_MARKER = rf"^\s*(?:#{{1,4}}\s*|\*\*|<\|?(?:im_start\|>)?|\[)?(?i:({_ANY}))(?:\*\*:|:\*\*|\|?>|\]:?|\s*:)\s*"
BLOCK_LINES = 4096
#: Labelled turns, at most, from which the model is fitted.
FIT_TURNS = 20_000
N_FEATURES = 16


def observed(text: Column) -> tuple[Column, Column, Column]:
    """(marker: 0 or the role's number from 1, feature class, text without its marker) of a line."""
    word = F.lower(F.regexp_extract(text, _MARKER, 1))
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(word.isin(*MARKERS[role]), F.lit(i + 1)).otherwise(marker)
    bare = F.when(marker > 0, F.regexp_replace(text, _MARKER, "")).otherwise(text)
    size = F.length(bare)
    length = F.when(size < 40, 0).when(size < 120, 1).when(size < 400, 2).otherwise(3)
    asks = bare.rlike(r"[?？]\s*$").cast("int")
    listed = bare.rlike(r"^\s*(?:[-*•]\s|\d+[.)]\s|```)").cast("int")
    return marker, length * 4 + asks * 2 + listed, bare


def lines_of(turns: DataFrame, conv: str, order: list[str], text: str) -> DataFrame:
    """One row per line: conv, __turn (the row's order columns), __line, text. A null text is one empty line."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    # ties between repeated rows are ordered by content; equal rows are interchangeable
    rows = turns.select(
        F.col(conv).alias("conv"), F.struct(*[F.col(c) for c in order], F.xxhash64(text)).alias("at"), F.posexplode(split).alias("line", "text")
    )
    return rows


def fit(turns: DataFrame, conv: str, turn: str, role: str, text: str, most: int = FIT_TURNS) -> dict[str, np.ndarray]:
    """Log probabilities of starts, transitions between lines, markers and features, from labelled turns.

    Of the turns with a known role the ``most`` with the smallest hashed conversation are used. Counts
    start at one, so nothing is impossible. Markers are taken to be right nine times in ten.
    """
    known = turns.where(F.col(role).isin(*ROLES)).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    some = known.orderBy(F.xxhash64("conv"), "conv", "turn", F.xxhash64("role", "text")).limit(most)
    lines = some.select("conv", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "piece"))
    feature = observed(F.col("piece"))[1]
    along = Window.partitionBy("conv").orderBy("turn", "role", "line")
    seen = lines.select("role", feature.alias("feature"), F.lag("role").over(along).alias("before"))
    counts = seen.groupBy("before", "role", "feature").agg(F.count(F.lit(1)).alias("n")).collect()
    number = {r: i for i, r in enumerate(ROLES)}
    k = len(ROLES)
    start, move, emit = np.ones(k), np.ones((k, k)), np.ones((k, N_FEATURES))
    for r in counts:
        j = number[r.role]
        emit[j, r.feature] += r.n
        if r.before is None:
            start[j] += r.n
        else:
            move[number[r.before], j] += r.n
    mark = np.full((k, k + 1), 0.1 / k)
    mark[:, 0] = 1.0
    mark[np.arange(k), np.arange(k) + 1] = 0.9
    return {
        "start": np.log(start / start.sum()), "move": np.log(move / move.sum(1, keepdims=True)),
        "emit": np.log(emit / emit.sum(1, keepdims=True)), "mark": np.log(mark),
    }


def _moves(model: dict, marker: np.ndarray) -> np.ndarray:
    """Transition scores into each line: a marked line begins a turn, from any role alike but the same."""
    fresh = np.log((1 - np.eye(len(ROLES))) * 0.45 + np.eye(len(ROLES)) * 0.1)
    return np.where((marker > 0)[:, None, None], fresh[None], model["move"][None])


def _shown(model: dict, marker: np.ndarray, feature: np.ndarray) -> np.ndarray:
    return model["emit"][:, feature].T + model["mark"][:, marker].T


def _segments(conv: np.ndarray) -> np.ndarray:
    """Where runs of equal conversations begin, with the end. Nulls are one conversation."""
    same = np.array([a == b or (a is None and b is None) for a, b in zip(conv[1:], conv[:-1])], bool)
    return np.concatenate(([0], np.flatnonzero(~same) + 1, [len(conv)]))


def _matrix(model: dict, marker: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Best score of a run of lines from each role of its first line to each of its last."""
    shown, moves = _shown(model, marker, feature), _moves(model, marker)
    k = len(ROLES)
    best = np.where(np.eye(k, dtype=bool), shown[0][None], -np.inf)
    for s, m in zip(shown[1:], moves[1:]):
        best = (best[:, :, None] + m[None]).max(axis=1) + s[None]
    return best


def _path(model: dict, marker: np.ndarray, feature: np.ndarray, first: int | None, last: int | None) -> np.ndarray:
    """The best roles of a run of lines, with its first and last role given where known."""
    shown, moves = _shown(model, marker, feature), _moves(model, marker)
    score = model["start"] + shown[0] if first is None else np.where(np.arange(len(ROLES)) == first, shown[0], -np.inf)
    back = np.zeros((len(marker), len(ROLES)), np.int64)
    for i in range(1, len(marker)):
        way = score[:, None] + moves[i]
        back[i] = way.argmax(axis=0)
        score = way.max(axis=0) + shown[i]
    role = np.zeros(len(marker), np.int64)
    role[-1] = score.argmax() if last is None else last
    for i in range(len(marker) - 1, 0, -1):
        role[i - 1] = back[i, role[i]]
    return role


def decode(lines: DataFrame, model: dict[str, np.ndarray], block_lines: int = BLOCK_LINES) -> DataFrame:
    """``lines`` (conv, at, line, text) with pos, block, marker, role, starts, and the text without its marker.

    ``starts`` is 1 where a turn begins: at a marker, a change of role or the first line.
    """
    marker, feature, bare = observed(F.col("text"))
    seen = computed(lines, m=F.struct(marker.alias("marker"), feature.alias("feature"), bare.alias("bare")))
    original = lines.schema["conv"].dataType
    seen = seen.select(F.col("conv").cast("string").alias("conv"), "at", "line", "m.*")  # pandas has no null numbers
    placed = global_position(seen, ["conv", "at", "line"], "pos")
    placed = placed.select("conv", "marker", "feature", "bare", "pos", F.floor((F.col("pos") - 1) / block_lines).alias("block"))
    k = len(ROLES)

    def borders(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos")
        at = _segments(df["conv"].to_numpy(object))
        rows = []
        for i in {0, len(at) - 2}:
            part = df.iloc[at[i] : at[i + 1]]
            m = _matrix(model, part["marker"].to_numpy(), part["feature"].to_numpy())
            rows.append((part["conv"].iloc[0], int(df["block"].iloc[0]), m.ravel().tolist(), int(part["marker"].iloc[0]), i == 0))
        return pd.DataFrame(rows, columns=["conv", "block", "best", "marker", "head"])

    slim = placed.select("conv", "marker", "feature", "pos", "block")
    border = slim.groupBy("block").applyInPandas(borders, "conv string, block bigint, best array<double>, marker int, head boolean")

    def chain(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("block")
        score, ways, before = None, [], None
        for m, mark in zip(df["best"], df["marker"]):
            m = np.array(m).reshape(k, k)
            enter = model["start"] if score is None else (score[:, None] + _moves(model, np.array([mark]))[0]).max(axis=0)
            back = None if score is None else (score[:, None] + _moves(model, np.array([mark]))[0]).argmax(axis=0)
            both = enter[:, None] + m
            ways.append((both.argmax(axis=0), back))
            score = both.max(axis=0)
        last, rows = int(score.argmax()), []
        for (first_of, back), block in zip(reversed(ways), reversed(df["block"].tolist())):
            first = int(first_of[last])
            before = -1 if back is None else int(back[first])
            rows.append((df["conv"].iloc[0], block, first, last, before))
            last = before
        return pd.DataFrame(rows, columns=["conv", "block", "first", "last", "before"])

    # one small row per block and conversation at its edges
    fixed = border.groupBy("conv").applyInPandas(chain, "conv string, block bigint, first int, last int, before int")

    def roles(df: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("pos").reset_index(drop=True)
        known = {c: (int(f), int(z), int(b)) for c, f, z, b in zip(edge["conv"].astype(object), edge["first"], edge["last"], edge["before"])}
        at = _segments(df["conv"].to_numpy(object))
        role, starts = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
        for i, (a, z) in enumerate(zip(at[:-1], at[1:])):
            mark, feat = df["marker"].to_numpy()[a:z], df["feature"].to_numpy()[a:z]
            first, last, before = known[df["conv"].iloc[a]] if i in (0, len(at) - 2) else (None, None, -1)
            role[a:z] = _path(model, mark, feat, first, last)
            prior = np.concatenate(([before], role[a : z - 1]))
            starts[a:z] = (prior != role[a:z]) | (mark > 0)
        return pd.DataFrame({"conv": df["conv"], "pos": df["pos"], "block": df["block"], "role": [ROLES[r] for r in role], "starts": starts, "bare": df["bare"]})

    return (
        placed.groupBy("block").cogroup(fixed.groupBy("block"))
        .applyInPandas(roles, "conv string, pos bigint, block bigint, role string, starts bigint, bare string")
        .withColumn("conv", F.col("conv").cast(original))
    )


def turns_of(decoded: DataFrame) -> DataFrame:
    """One row per turn: conv, turn_no from 1, role, n_lines, text, and ``rendered`` in the canonical form."""
    numbered = running(decoded, ["conv"], ["block"], ["pos"], sums={"turn_no": F.col("starts")})
    turns = numbered.groupBy("conv", "turn_no").agg(
        F.min("role").alias("role"), F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("pos", "bare"))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["bare"]), "\n")
    out = turns.select("conv", "turn_no", "role", "n_lines", text.alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")))


def parse_transcripts(turns: DataFrame, model: dict, conv: str = "conv_id", order: list[str] | None = None, text: str = "text") -> DataFrame:
    """Turns of raw transcripts: conv_id, turn_no, role, n_lines, text, rendered.

    A transcript's text may come in several rows, in ``order``. Rows with a null conversation are one
    transcript. Empty tables give no rows; an empty text is an empty line. Repeated rows are repeated
    lines.
    """
    return turns_of(decode(lines_of(turns, conv, order or ["turn"], text), model)).withColumnRenamed("conv", conv)


def marked(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Raw transcripts of labelled turns: each conversation marks speakers in its own way, one turn in three not at all."""
    styles = [
        {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
        {"system": "[sys] ", "user": "Human: ", "assistant": "AI: "},
        {"system": "### System: ", "user": "### Question: ", "assistant": "### Answer: "},
        {"system": "**Instructions:** ", "user": "Q: ", "assistant": "A: "},
    ]
    style = F.pmod(F.xxhash64(conv), F.lit(len(styles)))
    sign = F.lit("")
    for i, s in enumerate(styles):
        for r, word in s.items():
            sign = F.when((style == i) & (F.col(role) == r), F.lit(word)).otherwise(sign)
    bare = F.pmod(F.xxhash64(conv, turn), F.lit(3)) == 0
    return turns.select(conv, turn, F.concat(F.when(bare, F.lit("")).otherwise(sign), F.coalesce(F.col(text), F.lit(""))).alias(text))
