"""One query per operator, over whole tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, html_text, katz, near_duplicates, quality, repair, secrets, site_lines, vantage, vector_codes, warc
from .common import table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Measurements and verdict of every document; ``docs`` names the documents it reads.
LEDGER_SQL = r"""
  d AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM documents),
  w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  win AS (SELECT r, i, list_slice(ws, i, i + 7) AS x FROM (
      SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
  twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
  rep AS (SELECT r, sum(least(8, coalesce(next - i, 8))) AS n_repeat_words FROM (
      SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r),
  m AS (SELECT r, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS n_letters,
      len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
  f AS (SELECT *, n_words < 20 AS f0, 100 * n_repeat_words > 30 * n_words AS f1, 10 * n_symbols > n_words AS f2,
      10 * n_dup_lines > 3 * n_lines AS f3, word_chars < 2 * n_words OR word_chars > 20 * n_words AS f4,
      10 * n_letters < 6 * word_chars AS f5, 2 * n_stutter > n_words AS f6 FROM m),
  ledger AS (SELECT r, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
      CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
      f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f4 OR f5 OR f6) AS kept,
      f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT AS failed FROM f)"""


@query(
    "op2_quality_rules",
    f"WITH {LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed "
    "FROM ledger JOIN d USING (r)",
)
def op2_quality_rules(spark, sf_dir):
    rows = quality.ledger(documents(spark, sf_dir))
    m = F.col("ledger")
    return rows.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), m["failed"].alias("failed"),
    )  # fmt: skip


SITE_LINES_SQL = f"""
  page AS (SELECT DISTINCT source, text FROM documents),
  line AS (SELECT DISTINCT source, text, trim(x, ' ') AS k FROM (
      SELECT source, text, unnest(string_split(text, chr(10))) AS x FROM page) WHERE trim(x, ' ') <> ''),
  host AS (SELECT source, count(*) AS n_host FROM page GROUP BY source),
  common AS (SELECT source, list(k) AS ks FROM (
      SELECT source, k, count(*) AS n FROM line GROUP BY source, k) JOIN host USING (source)
    WHERE n >= {site_lines.MIN_PAGES} AND n > CAST({site_lines.RATIO} AS DOUBLE) * n_host GROUP BY source),
  cleaned AS (SELECT d.*, string_split(text, chr(10)) AS a,
      list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = '' OR NOT coalesce(list_contains(ks, trim(x, ' ')), false)) AS b
    FROM documents d LEFT JOIN common USING (source))"""


@query(
    "op9_line_dedup",
    f"WITH {SITE_LINES_SQL} SELECT doc_id, source, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, "
    "CAST(coalesce(len(a) - len(b), 0) AS BIGINT) AS n_dropped, array_to_string(b, chr(10)) AS text FROM cleaned",
)
def op9_line_dedup(spark, sf_dir):
    rows = site_lines.drop_site_lines(documents(spark, sf_dir))
    n = F.col("__lines")
    return rows.select("doc_id", "source", n["n_lines"].alias("n_lines"), n["n_dropped"].alias("n_dropped"), "text")


@query("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates.similar_texts(documents(spark, sf_dir))


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def vocabulary_path() -> str:
    """The public byte-level vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe_encoding")
def op5_bpe_encoding(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary_path(), with_ids=False)


@query("op1_html_extraction")
def op1_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_text.extract_main_text(pages)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _secrets_sql() -> str:
    """Spans by splitting at the matches, as text operations on whole texts."""
    each = []
    for i, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        each.append(
            f"SELECT r, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS ms, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""
      d AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM documents),
      hit AS ({" UNION ALL ".join(each)}),
      one AS (SELECT r, rank, kind, least, i, length(ms[i]) AS size, length(gs[i]) AS len,
        sum(length(ps[i])) OVER w + coalesce(sum(length(ms[i])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM hit) WINDOW w AS (PARTITION BY r, rank ORDER BY i)),
      span AS (SELECT r, rank, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT) AS x FROM one WHERE len >= least),
      per AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(x, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(x, ',' ORDER BY s, rank) AS spans FROM span GROUP BY r)"""


@query(
    "op4_secret_scan",
    f"WITH {_secrets_sql()} SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
    "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)",
)
def op4_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col("__spans")
    of = lambda i: F.filter(spans, lambda s: s["rank"] == i)  # noqa: E731
    counts = [F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    base = secrets.listed(F.filter(spans, lambda s: s["rank"] < len(secrets.BASE)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


@query("op7_warc")
def op7_warc(spark, sf_dir):
    rows = warc.archived(table(spark, sf_dir, "pages"))
    refers = F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).cast("long")
    return rows.select(
        F.col("metadata.page_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), refers.alias("refers_to")
    )


@query("op3_lm_scoring")
def op3_lm_scoring(spark, sf_dir):
    return katz.score(documents(spark, sf_dir))


@query("op6_chat_formatting")
def op6_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    model = chat.fit(turns, "conv_id", "turn", "role", "text")
    out = chat.parse_transcripts(chat.marked(turns), model)
    return out.select("conv_id", "turn_no", "role", "n_lines", "rendered")


#: A vector that is there and whose components are all finite.
_FINITE_SQL = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql() -> str:
    """Rounds of assignment and new entries, unrolled; products of the integer parts are exact in doubles."""
    parts, rounds = vector_codes.PARTS, vector_codes.ROUNDS
    steps = [
        f"""
      kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: floor({vector_codes.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE_SQL}),
      part AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(p)),
      book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= {vector_codes.ENTRIES})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
      near{i} AS MATERIALIZED (SELECT r, p, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}}) AS m
        FROM part JOIN book{i} USING (p) GROUP BY r, p)"""
        )
        if i < rounds:
            steps.append(
                f"""
      mean{i} AS (SELECT p, e, list(y ORDER BY j) AS c FROM (
        SELECT p, m.e AS e, j, floor(sum(x[j]) / count(*)) AS y FROM near{i} JOIN part USING (r, p), range(1, 1000) AS t(j)
        WHERE j <= len(x) GROUP BY p, m.e, j) GROUP BY p, e),
      book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} n ON n.p = b.p AND n.e = b.e)"""
            )
    return f"""WITH {",".join(steps)},
      sha AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS h
        FROM book{rounds}),
      coded AS (SELECT r, string_agg(lower(printf('%02x', CAST(m.e AS BIGINT))), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
        FROM near{rounds} GROUP BY r)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM kept JOIN coded USING (r), sha"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark, sf_dir):
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    rows = vector_codes.with_group_error(rows, "label")
    sha = F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256")
    return rows.select("vec_id", vector_codes.text_codes(F.col("code")).alias("code"), "error", "label_error", sha)


def _repair_sql() -> str:
    """Costs, letters and text from each row to the end, worked out from the last row back to the first."""
    put, role = {"E": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    kept = {("E", "s"): "s", ("E", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    gap = lambda state: "''" if state == "E" else "chr(10)"  # noqa: E731

    def ways(state: str) -> str:
        out, at, letters, text = [], state, "", "''"
        for cost in (0, 2, 4):
            nxt = put[at]
            out.append(f"{{'c': {cost + 3} + f.{at}.c, 'a': '{letters}D' || f.{at}.a, 't': {text} || f.{at}.t}}")
            new = f"{text} || {gap(at)} || '{role[nxt]}:' || r.text || f.{nxt}.t"
            out.append(f"CASE WHEN r.stays THEN {{'c': {cost + 2} + r.more + f.{nxt}.c, 'a': '{letters}R' || f.{nxt}.a, 't': {new}}} END")
            for (before, initial), to in kept.items():
                if before == at:
                    same = f"{text} || {gap(at)} || r.role || ':' || r.text || f.{to}.t"
                    out.append(
                        f"CASE WHEN r.stays AND r.initial = '{initial}' THEN "
                        f"{{'c': {cost} + r.more + f.{to}.c, 'a': '{letters}K' || f.{to}.a, 't': {same}}} END"
                    )
            letters, text, at = letters + "I", f"{text} || {gap(at)} || '{role[nxt]}:'", nxt
        return f"list_min([{', '.join(out)}]) AS {state}"

    ends = {"E": "0, 'a': '', 't': ''", "s": "4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'",
            "u": "2, 'a': 'I', 't': chr(10) || 'assistant:'", "a": "0, 'a': '', 't': ''"}  # fmt: skip
    return rf"""WITH RECURSIVE
      tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS t(i)),
      raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295],
          list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
            lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
        FROM conversations, tab),
      conv AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
      hurt AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
          CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM raw JOIN conv ON raw.conv_id IS NOT DISTINCT FROM conv.conv_id, range(2) AS t(again)
        WHERE kind <> 0 AND (again = 0 OR kind = 3)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial,
          regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last FROM hurt),
      faults AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 'duplicate'
          WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY g ORDER BY pos) AS prior FROM placed),
      rows AS (SELECT *, fault IN ('', 'truncated') AS stays, CAST(fault = 'truncated' AS BIGINT) AS more FROM faults),
      told AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
          count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
          count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY g),
      f AS (SELECT g, coalesce(n, 0) AS i, {", ".join(f"{{'c': CAST({e.split(',', 1)[0]} AS BIGINT),{e.split(',', 1)[1]}}} AS {s}" for s, e in ends.items())}
        FROM conv LEFT JOIN told USING (g)
        UNION ALL SELECT f.g, f.i - 1, {", ".join(ways(s) for s in "Esua")} FROM f JOIN rows r ON r.g = f.g AND r.pos = f.i)
    SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
      f.E.c AS cost, f.E.a AS audit, sha256(f.E.t) AS repaired_sha256
    FROM conv JOIN f USING (g) LEFT JOIN told USING (g) WHERE f.i = 0"""


@query("op12_conversation_repair", _repair_sql())
def op12_conversation_repair(spark, sf_dir):
    rows = repair.damaged(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    out = repair.repair(rows, "conv", "turn", "role", "text", F.col("lost"))
    return out.withColumnRenamed("conv", "conv_id")


@query(
    "op13_nearest_neighbours",
    f"""WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE {_FINITE_SQL} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      d AS (SELECT q.vec_id AS query_id, q.v AS qv, e.vec_id, sqrt(list_reduce(
          list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
        FROM e AS q JOIN e ON e.vec_id IS DISTINCT FROM q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
    FROM d QUALIFY rank <= 10""",
)
def op13_nearest_neighbours(spark, sf_dir):
    return vantage.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=100)
