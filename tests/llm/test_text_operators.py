"""The text operators against brute force on small and awkward tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from jobsieve.llm import bpe, chat, decontaminate, html_text, katz, near_duplicates, quality, secrets, site_lines, warc
from jobsieve.llm.common import hashed_words

GAP = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, __keys string, ledger_note string"


def made(spark, texts, source="s"):
    rows = [(i if i != 3 else None, t, source if i % 2 else None, "k", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=60):
    return " ".join("".join(rng.choice(["th", "on", "er", "an", "ti"]) for _ in range(rng.randrange(1, 5))) + str(rng.randrange(words)) for _ in range(n))


AWKWARD = ["", None, " \t\n", "one", "one", "a b c d e f g h " * 30, "ü ß x\n\n\nü ß x\r\n", "x" * 5000, "# | <> $$ " * 12, "\x1c\x85   𝔘𝔫𝔦"]


@pytest.fixture(scope="module")
def docs(spark):
    return made(spark, AWKWARD).cache()


# ---- quality rules


def repeated(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_ledger_counts(spark):
    rng = random.Random(1)
    texts = AWKWARD + [" ".join(rng.choices("a b c".split(), k=rng.randrange(60))) for _ in range(60)] + [prose(rng, 300)]
    got = quality.ledger(made(spark, texts)).select("text", "ledger.*").collect()
    assert len(got) == len(texts)
    for r in got:
        t = r.text or ""
        w, lines = GAP.findall(t), [x for x in t.split("\n") if GAP.search(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated(w), t[:60]
        assert bool(r.failed & 1) == (len(w) < 20)


def test_ablations_follow_from_bits(spark, docs):
    led = quality.ledger(docs).cache()
    bits = [r.failed for r in led.select("ledger.failed").collect()]
    for r in quality.ablations(led, "v1").collect():
        bit = 1 << quality.RULES.index(r.rule)
        m = quality.mask("v1")
        assert r.n_failed == sum(bool(b & bit) for b in bits)
        assert r.n_only == sum(b & m == bit for b in bits)
        assert r.n_kept_without == sum(b & m & ~bit == 0 for b in bits)
    assert quality.rejected_out(docs).columns == docs.columns


# ---- line dedup


def test_site_lines(spark):
    pages = [(i, f"menu\nunique {i}\n\nmenu", "a", None, None) for i in range(8)] + [(9, "menu\nkeep", "b", None, None), (10, None, None, None, None), (11, "", "a", None, None)]
    out = {r.doc_id: r for r in site_lines.drop_site_lines(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert out[0].text == "unique 0\n" and out[0]["__lines"].n_dropped == 2
    assert out[9].text == "menu\nkeep" and out[10].text is None and out[11].text == ""


def test_copies_of_a_page_are_one_page(spark):
    pages = [(i, "same\ntext", "a", None, None) for i in range(50)] + [(i, f"other {i}", "a", None, None) for i in range(50, 90)]
    out = site_lines.drop_site_lines(spark.createDataFrame(pages, SCHEMA))
    assert out.where("text = 'same\ntext'").count() == 50


def test_near_copies_of_a_page_are_one_page(spark):
    import corpus_pipeline

    rng = random.Random(9)
    shared = "\n".join(prose(rng, 12, 10**6) for _ in range(6))
    texts = [f"menu\n{shared}\nlast words {i}" for i in range(12)] + [f"menu\n{prose(rng, 20, 10**6)}" for _ in range(40)]
    pages = [(i, t, "a", None, None) for i, t in enumerate([*texts, None, ""])]
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(pages, SCHEMA), "").collect()}
    assert out == {i: t and t.removeprefix("menu\n") for i, t, *_ in pages}


# ---- near duplicates


def grams(t):
    w = GAP.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(texts):
    sets = [grams(t) for t in texts]
    links = defaultdict(set)
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            links[i].add(j), links[j].add(i)
    return links


@pytest.mark.parametrize("block", [1024, 7])
def test_links_and_classes(spark, block):
    rng = random.Random(block)
    texts = []
    for _ in range(12):
        w = prose(rng, 80, 10**6).split()
        for _ in range(rng.randrange(1, 9)):
            v = list(w)
            for _ in range(rng.randrange(0, 3)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
            texts += [" ".join(v)] * rng.randrange(1, 3)
    texts += ["", "", None, "a b", "a  b", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in near_duplicates.similar_texts(rows, block_texts=block).collect()}
    kinds = list(dict.fromkeys(t or "" for t in texts))
    links = brute_links(kinds)
    low = {k: min(i for i, t in enumerate(texts) if (t or "") == kinds[k]) for k in range(len(kinds))}
    group = {k: {k} for k in range(len(kinds))}
    for i, js in links.items():
        for j in js:
            if group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[i]:
                    group[k] = group[i]
    for i, t in enumerate(texts):
        k = kinds.index(t or "")
        assert got[i].n_links == len(links[k])
        assert got[i].class_id == min(low[x] for x in group[k])
        assert got[i].n_copies == sum((x or "") == (t or "") for x in texts)
    kept = near_duplicates.one_of_each(rows)
    assert kept.count() == len({id(g) for g in group.values()})


def test_links_with_more_blocks_than_texts(spark):
    rng = random.Random(8)
    texts = []
    for size in (2, 2, 3, 6):
        w = prose(rng, 80, 10**6).split()
        texts += [" ".join([*w, f"end{k}"]) for k in range(size)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    links = brute_links(texts)
    for block_bytes in (20, 150, 700):
        got = {r.doc_id: r.n_links for r in near_duplicates.similar_texts(rows, block_bytes=block_bytes).collect()}
        assert got == {i: len(links[i]) for i in range(len(texts))}


def test_one_row_of_each_class_whatever_its_id(spark):
    rng = random.Random(6)
    a, b, c, d = (prose(rng, 60, 10**6) for _ in range(4))
    near = lambda t: f"{t} end"
    rows = [(1, a), (1, b), (2, near(a)), (None, c), (None, c), (None, near(c)), (5, near(b)), (None, d), (7, near(d)), (7, near(d))]
    kept = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.removesuffix(" end")) for r in kept) == sorted([(1, a), (1, b), (0, c), (7, d)])
    assert {r.text for r in kept if r.doc_id} == {a, b, near(d)}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert near_duplicates.similar_texts(none).count() == 0
    assert near_duplicates.one_of_each(none).columns == none.columns
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.without_leaks(none, items.where("item_id = 0")).count() == 0
    assert secrets.find_secrets(none).count() == 0
    assert site_lines.drop_site_lines(none).count() == 0
    assert quality.ledger(none).count() == 0
    assert katz.score(none).count() == 0


# ---- secrets


def brute_spans(text):
    out = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}.get(rule.kind, rule.pattern)
        for m in re.finditer(pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, rule.kind, m.end()))
    return sorted(out)


def test_secret_spans(spark):
    rng = random.Random(4)
    bits = ["PassWord", "=", " : ", "token", "api_key", "apikey='", "abc", "abcdef", "secret:token:abcdefgh", "AKIA" + "A1" * 9, "AKIA12", "deadbeef" * 4, "deadbeef", "\n", "ü𝔘", "ghp_" + "aB3" * 13, '"', "-----BEGIN RSA PRIVATE KEY-----", "xoxb-" + "1234567890" * 3, " "]
    texts = AWKWARD + ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(300)]
    for r in secrets.find_secrets(made(spark, texts)).collect():
        assert [tuple(s) for s in r["__spans"]] == brute_spans(r.text or ""), r.text


def test_trigram_queries_lose_nothing():
    def holds(query, text):
        if query is True:
            return True
        if isinstance(query, str):
            return query in text
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    samples = ["passwd = xabcdef", "API_KEY: 'abcdefg'", "AKIA" + "Z" * 20, "ghs_" + "a" * 40, "-----BEGIN PRIVATE KEY-----", "AIza" + "x" * 35]
    for s in samples:
        hit = [r for r in secrets.RULES if re.search(r.pattern, s)]
        assert hit
        assert all(holds(secrets.trigram_query(r.pattern), s.lower()) for r in hit)
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is True
    assert secrets.trigram_query("abcd|x?yz") is True
    assert secrets.trigrams(secrets.trigram_query("(abc)?defg")) >= {"def", "efg"}


# ---- encoding


def vocabulary_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    path, rng = vocabulary_path(), random.Random(2)
    lib = Tokenizer.from_file(path)
    odd = lambda: chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x3000), rng.randrange(0x1F300, 0x1FA00)]))
    texts = AWKWARD + ["".join(odd() for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["a" * 3000, "ab" * 2000 + "é" * 999, "x<|endoftext|>y<|endoftext|>", "   \n\n  it's we'll"]
    got = bpe.encode_documents(made(spark, texts), path).withColumnRenamed("ids", "i").collect()
    assert len(got) == len(texts)
    want = Counter()
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want[tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((tuple(r.i), r.ids_sha256, r.decoded_sha256) for r in got) == want


# ---- decontamination


def edits_to(item, part):
    row = [0] * (len(part) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(part, 1):
            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks_against_all_pairs(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.randrange(12, 45), 10**6)) for i in range(25)] + [(90, ""), (91, None), (92, "short one here"), (0, "again the same id with other words in it now")]
    norm = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", (t or "").lower())
    texts = AWKWARD + [prose(rng, 150, 10**6) for _ in range(10)]
    for i, t in items[:25] * 3:
        w = t.split()
        for _ in range(rng.randrange(0, int(len(w) * 0.35) + 1)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = rng.choice([[], [f"zz{rng.randrange(999)}"]])
            w = w or ["x"]
        texts.append(prose(rng, rng.randrange(40), 10**6).upper() + " " + " ".join(w) + ", " + prose(rng, 20, 10**6))
    docs = made(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for n, t in enumerate(texts):
        for i, x in items:
            a, b = norm(x), norm(t)
            if a and b and (e := edits_to(a, b)) <= int(len(a) * decontaminate.EDITS + 1e-9):
                want.add((n if n != 3 else None, i, e))
    got = {(r.doc_id, r.item_id, r.n_edits) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 40
    bad = {n for n, _, _ in want}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {n for n in range(len(texts)) if n not in bad and n != 3}
    split = decontaminate.find_leaks(docs, bench, block_items=5)
    assert {(r.doc_id, r.item_id) for r in split.collect()} == {(d, i) for d, i, _ in got}


# ---- language model


def test_scores(spark):
    rng = random.Random(3)

    def chain(n, w=1):
        return " ".join(f"W{(w := (w * 3 + rng.randrange(3)) % 50)}" for _ in range(n))

    texts = AWKWARD + [chain(rng.randrange(200)) for _ in range(120)] + [prose(rng, 30, 10**6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in katz.score(rows).collect()}
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [[*GAP.findall((t or "").translate(fold)), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    ours, base = (sum(got[i][k] for i in range(len(texts)) if held[i]) for k in ("score", "base_score"))
    assert ours > base


def test_every_context_sums_to_one(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, prose(rng, rng.randrange(100), 5)) for i in range(40)], "doc_id bigint, text string")
    source = katz._prepared(rows, "doc_id", "text")
    corpus = katz.count_words(source)
    table = katz.table_of(*katz.fit(source, corpus)).astype(float)
    assert np.allclose((10**table).sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize("held_by_tasks", [1 << 17, 20, 0])
def test_scores_have_every_word_pair(spark, monkeypatch, held_by_tasks):
    # more words than any fixed vocabulary of the module; pairs of rare words carry the text
    monkeypatch.setattr(katz, "HELD_COUNTS", held_by_tasks)
    rng = random.Random(11)
    follows = {i: [rng.randrange(4000) for _ in range(2)] for i in range(4000)}

    def chain(n):
        out = [rng.randrange(4000)]
        for _ in range(n):
            out.append(rng.choice(follows[out[-1]]) if rng.random() < 0.9 and out[-1] in follows else rng.randrange(5000))
        return " ".join(f"w{w}" for w in out)

    texts = ["", None] + ["the end"] * 30 + [chain(rng.randrange(300)) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens = [[None, *(t or "").split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t[1:])
    pairs = Counter(p for t, h in zip(tokens, held) if not h for p in zip(t, t[1:]))
    mass = sum(count.values()) + len(count) + 1
    factor = katz.discounts(Counter(pairs.values()))
    kept = {p: c * factor[c - 1] if c <= len(factor) else c for p, c in pairs.items()}
    lost, low = Counter(), Counter()
    for (a, b), c in pairs.items():
        lost[a] += c - kept[a, b]
        low[a] += count[b] + 1
    spare = {a: float(lost[a] < 1e-9) for a in count}

    def chance(a, b):
        if (a, b) in pairs:
            return kept[a, b] / (count[a] + spare[a])
        first = (count[b] + 1) / mass
        return first * ((lost[a] + spare[a]) / (count[a] + spare[a]) / (1 - low[a] / mass) if a in count else 1)

    assert len(count) > 2500
    got = {r.doc_id: r for r in katz.score(rows).collect()}
    for i, t in enumerate(tokens):
        assert math.isclose(got[i].score, sum(math.log10(chance(a, b)) for a, b in zip(t, t[1:])), rel_tol=1e-9)
        assert got[i].n_known == sum(count[w] > 0 for w in t[1:])


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(12)
    texts = AWKWARD + ["often often seen " * 40] * 8 + [prose(rng, rng.randrange(200), 30) for _ in range(120)]
    ids = [None if i == 7 else f"d{i % 100}" for i in range(len(texts))]  # some repeat
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string").coalesce(2)
    by = lambda r: (r.doc_id or "", r.n_tokens, r.base_score)
    whole = sorted(katz.score(rows).collect(), key=by)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert katz._blocks(katz._prepared(rows, "doc_id", "text")).count() > 10
        split = sorted(katz.score(rows).collect(), key=by)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == len(texts) and [r[:5] for r in whole] == [r[:5] for r in split]
    assert all(math.isclose(a.score, b.score, rel_tol=1e-9) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9) for a, b in zip(whole, split))


def test_scoring_writes_less_than_the_texts(spark, monkeypatch):
    # tables with a row or an array entry per text and pair take more room than the texts
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(3000) if rng.random() < 0.7 else rng.randrange(10**6)}" for _ in range(400)) for _ in range(600)]
    paths, sizes, cut = [], [], katz.cut

    def measured(df):
        table = cut(df)
        paths.append(table.cut_path)
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(table.cut_path) for f in names))
        return table

    monkeypatch.setattr(katz, "cut", measured)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert katz.score(rows).count() == len(texts)
    assert sum(os.path.exists(path) for path in paths) == 1  # the others are deleted once they are read
    assert sum(sizes) < 2 * sum(map(len, texts))


# ---- transcripts


def test_viterbi_in_blocks_is_the_undivided_path(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["User: hi?", "Assistant: well\nmore text " + "x " * 30, "hm?", "- a\n- b", "", None, "System: be brief"])) for c in (1, 2, None) for t in range(rng.randrange(1, 60))]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    train = spark.createDataFrame([(1, i, chat.ROLES[1 + i % 2], "so?" if i % 2 == 0 else "long answer " * 9) for i in range(40)], "conv_id int, turn int, role string, text string")
    model = chat.fit(train, "conv_id", "turn", "role", "text")
    whole = chat.decode(chat.lines_of(turns, "conv_id", ["turn"], "text"), model).orderBy("pos").collect()
    cut = chat.decode(chat.lines_of(turns, "conv_id", ["turn"], "text"), model, block_lines=7).orderBy("pos").collect()
    assert len(whole) == sum(len((t or "").split("\n")) for _, _, t in rows)
    line = {r.pos: r for r in whole}
    assert [(r.conv, r.pos, r.bare) for r in whole] == [(r.conv, r.pos, r.bare) for r in cut]
    shown = {r.bare: r for r in spark.createDataFrame([(x,) for x in {r.bare for r in whole}], "bare string").select("bare", chat.observed(F.col("bare"))[1].alias("f")).collect()}

    def path_score(rows):
        total, before = 0.0, None
        for r in rows:
            k, raw = chat.ROLES.index(r.role), marks[r.pos]
            move = model["start"][k] if before is None or before.conv != r.conv else chat._moves(model, np.array([raw]))[0][chat.ROLES.index(before.role), k]
            total += move + model["emit"][k, shown[r.bare].f] + model["mark"][k, raw]
            before = r
        return total

    ordered = chat.lines_of(turns, "conv_id", ["turn"], "text").orderBy("conv", "at", "line").select(chat.observed(F.col("text"))[0].alias("m")).collect()
    marks = {pos: r.m for pos, r in zip(sorted(line), ordered)}
    best = 0.0
    for _, rows_of in itertools.groupby(whole, key=lambda r: r.conv):
        rows_of = list(rows_of)
        mark, feature = np.array([marks[r.pos] for r in rows_of]), np.array([shown[r.bare].f for r in rows_of])
        role = [chat.ROLES[k] for k in chat._path(model, mark, feature, None, None)]
        best += path_score([Row(conv=r.conv, pos=r.pos, bare=r.bare, role=x) for r, x in zip(rows_of, role)])
    assert math.isclose(path_score(whole), best, abs_tol=1e-6) and math.isclose(path_score(cut), best, abs_tol=1e-6)
    said = chat.parse_transcripts(turns, model)
    assert said.agg({"n_lines": "sum"}).first()[0] == sum(len((t or "").split("\n")) for _, _, t in rows)
    assert said.where("role = 'user' AND text = 'hi?'").count() > 0
    assert chat.parse_transcripts(turns.where("turn < 0"), model).count() == 0


def test_markers_recover_roles(spark):
    rows = [(c, t, chat.ROLES[1 + t % 2], ("why is it so?" if t % 2 == 0 else "because " * 20)) for c in range(40) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    model = chat.fit(turns, "conv_id", "turn", "role", "text")
    got = chat.parse_transcripts(chat.marked(turns), model).orderBy("conv_id", "turn_no").collect()
    assert [r.role for r in got] == [r[2] for r in rows]


# ---- archives


def test_archives_round_trip(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"
    pages = [(1, "http://a/x", "same"), (2, "http://b", "same"), (5, None, "same"), (3, "http://c/\r\nX: y", tricky), (4, "http://d", ""), (6, "http://e", None), (7, "", "é " * 4000), (2, "http://b", "same"), (None, "http://n", "same")]
    rows = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, digest string")
    got = warc.archived(rows, with_payload=True).collect()
    assert len(got) == len(pages) and all(r.request and r.metadata for r in got)
    first = defaultdict(lambda: -1)
    for i, _, h in pages:
        first[h or ""] = max(first[h or ""], -1 if i is None else i)
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        answer = i == first[h or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if answer else "revisit", None if answer else f"<urn:page:{first[h or '']}>", raw if answer else None] += 1
    assert Counter((r.metadata.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.archived(rows.where("page_id > 99")).count() == 0


# ---- main text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<p>Only this", "Only this"),
        ("<nav><a>x</a></nav><article><h1>Title</h1><p>The cat and the dog are in the house of the man.<p>End.</article><footer>f</footer>", "Title The cat and the dog are in the house of the man. End."),
        ("<script>var a='</p>';</script><div class='cookie-notice'>We use it and the like for all of you to see</div><main><p>It is&nbsp;a &lt;b&gt; of<br>the x &amp; y in  a row</p></main>", "It is a <b> of the x & y in a row"),
        ("<body><article><p>This is the text of it and that is all there is to it</p><div id=comments><p>I am of the view that this is a good one</p></div></article></body>", "This is the text of it and that is all there is to it"),
        ("<article><p>This is the f<b>oo</b> of a bar that was in the house of it</p></article><!-- <p>x</p> -->", "This is the foo of a bar that was in the house of it"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


TEXT = "This is the text of it and that is all there is to it"


@pytest.mark.parametrize("wrapper", ["div class='content-sidebar-wrap'", "div class=has-sidebar", "div class='right-sidebar x'", "div id=no-comments", "div class='fixed-header'", "form"])
@pytest.mark.parametrize("inner", ["<main><p>{}</p></main>", "<article><p>{}</p></article>", "<div><p>{}</p></div>"])
def test_wrappers_do_not_empty_the_page(wrapper, inner):
    name = wrapper.split()[0]
    page = f"<body><{wrapper}><nav>Home</nav>{inner.format(TEXT)}<div class=sidebar><p>More of the same to be seen in here</p></div></{name}><footer>f</footer></body>"
    assert html_text.main_text(page) == TEXT
    nested = f"<div class=has-sidebar>{page}</div>"
    assert html_text.main_text(nested) == TEXT


def test_hints_still_hold_beside_the_article():
    comments = "<div id=comments><article><p>" + TEXT.replace("text", "view") * 3 + "</p></article></div>"
    assert html_text.main_text(f"<article><p>{TEXT}</p></article>{comments}") == TEXT
    assert html_text.main_text(f"<main><p>{TEXT}</p></main><div class=related><article><p>{TEXT}</p></article></div>") == TEXT
    assert html_text.main_text(f"<p>{TEXT}</p><div class=cookie-notice><p>We use it and the like</p></div>") == TEXT


@pytest.mark.parametrize(
    "text",
    [
        "Вчера вечером мы долго гуляли вдоль реки и говорили о новой книге.",
        "Wczoraj wieczorem długo spacerowaliśmy wzdłuż rzeki, rozmawiając później przy herbacie.",
        "Dün akşam nehir boyunca uzun süre yürüdük ve yeni kitaptan konuştuk.",
    ],
)
def test_text_of_other_languages(text):
    links = "<ul>" + "".join(f"<li><a href=x>{w} {w}</a>" for w in text.split()) + "</ul>"
    assert html_text.main_text(f"<body>{links}<div><p>{text}</p><p>{text}</p></div>{links}</body>") == f"{text} {text}"
    labels = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa"
    assert html_text.main_text(f"<body><p>{labels}</p><p>{TEXT}</p></body>") == TEXT


def test_pages_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, None, "u"), (2, "<p>x</p>", "u"), (2, "<p>x</p>", "u")], "page_id int, html string, text string")
    out = html_text.extract_main_text(rows)
    assert sorted(r.text for r in out.collect()) == ["", "x", "x"] and out.columns == ["page_id", "html", "text"]


def test_word_hashes_follow_text_borders():
    data = "ab cd" "cd ab" "Ab".encode() if False else b"ab cdcd abAb"
    ends = np.array([5, 10, 12])
    h, start, end = hashed_words(np.frombuffer(data, np.uint8), ends)
    assert list(zip(start, end)) == [(0, 2), (3, 5), (5, 7), (8, 10), (10, 12)]
    assert h[0] == h[3] != h[4] and h[1] == h[2]
    folded = hashed_words(np.frombuffer(data, np.uint8), ends, fold=True)[0]
    assert folded[0] == folded[4]


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("the given tables are not here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r.asDict() for r in docs.collect()]
    led = {r.doc_id: r.ledger.failed & quality.mask("v1") == 0 for r in quality.ledger(docs).select("doc_id", "ledger").collect()}
    want = [d for d in want if led[d["doc_id"]]]
    pages, seen = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for d in want:
        pages[d["source"]].add(d["text"])
        for x in {x.strip(" ") for x in d["text"].split("\n")} - {""}:
            seen[d["source"]][x].add(d["text"])
    for d in want:
        n, s = len(pages[d["source"]]), d["source"]
        gone = lambda x: x.strip(" ") and len(seen[s][x.strip(" ")]) >= max(5, 0) and len(seen[s][x.strip(" ")]) > site_lines.RATIO * n
        d["text"] = "\n".join(x for x in d["text"].split("\n") if not gone(x))
    texts = list(dict.fromkeys(d["text"] for d in want))
    links, root = brute_links(texts), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, js in links.items():
        for j in js:
            root[top(i)] = top(j)
    low = {}
    for d in want:
        g = top(texts.index(d["text"]))
        low[g] = min(low.get(g, 1 << 60), d["doc_id"])
    want = [d for d in want if d["doc_id"] in low.values()]
    norm = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", t.lower())
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    near = lambda a, b: len(set(a) & set(b)) >= 0.5 * len(set(a)) and edits_to(a, b) <= int(len(a) * decontaminate.EDITS + 1e-9)
    want = [d for d in want if not any(near(a, norm(d["text"])) for a in items)]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    ids = {d["doc_id"]: lib.encode(d["text"], add_special_tokens=False).ids for d in want}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == ids
