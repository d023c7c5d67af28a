"""Resume leaves, posting terms and document checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testviews as V
from .. import vocab
from ..functions import text as T
from ..operators import checks as K
from ..operators import leaves as L
from ..operators import phrases as phrase_search
from ..sources import documents as docs
from .registry import VIEWS, fold_sql, plain_sql, query, with_views

_NOW = "2020-06-15 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


# --- leaves -----------------------------------------------------------------


@query("resume_leaves", with_views("rs je bl lv", "SELECT doc_id, section, entry, key, item, path, value FROM lv"))
def resume_leaves(spark, sf):
    return L.leaves(V.resumes(spark, sf), "doc_id").select("doc_id", "section", "entry", "key", "item", "path", "value")


@query(
    "searchable_fields",
    with_views("rs je bl lv", "SELECT doc_id, count(*) AS fields, sum(length(value)) AS chars FROM lv WHERE key NOT IN ('start', 'end', 'phone') AND NOT (section = 'projects' AND key = 'url') GROUP BY 1"),
)
def searchable_fields(spark, sf):
    return L.searchable(L.leaves(V.resumes(spark, sf), "doc_id")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("fields"), F.sum(F.length("value")).alias("chars")
    )


@query(
    "prose_units",
    with_views("rs je bl lv", "SELECT doc_id, path FROM lv WHERE path IN ('basics.label', 'basics.summary') OR (section = 'experience' AND key = 'title') OR key IN ('description', 'bullets')"),
)
def prose_units(spark, sf):
    return L.prose(L.leaves(V.resumes(spark, sf), "doc_id")).select("doc_id", "path")


@query(
    "dated_fields",
    with_views("rs je bl lv", "SELECT doc_id, path, value FROM lv WHERE section IN ('experience', 'education') AND key IN ('start', 'end') AND lower(value) <> 'present'"),
)
def dated_fields(spark, sf):
    return L.dated(L.leaves(V.resumes(spark, sf), "doc_id")).select("doc_id", "path", "value")


@query(
    "loaded_resumes",
    with_views(
        "rs je",
        """SELECT doc_id, 'Person ' || doc_id AS name, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS label,
             (SELECT count(*) FROM je WHERE je.doc_id = rs.doc_id) AS jobs FROM rs WHERE doc_id % 8 NOT IN (5, 6)""",
    ),
)
def loaded_resumes(spark, sf):
    """Resume JSON with padding, blanks and unknown keys; two in eight are no resume."""
    doc = F.col("doc_id")
    raw = V.resumes(spark, sf).withColumn(
        "raw",
        F.when(doc % 8 == 5, "[1, 2]").when(doc % 8 == 6, F.concat(F.lit("not json "), F.col("text"))).otherwise(
            F.to_json(
                F.struct(
                    F.struct(
                        F.concat(F.lit("  "), F.col("content.basics.name")).alias("name"),
                        F.when(doc % 4 == 0, "   ").otherwise(F.col("content.basics.label")).alias("label"),
                        F.lit("x").alias("unknown"),
                    ).alias("basics"),
                    F.col("content.experience"),
                )
            )
        ),
    )
    good, _ = docs.load_resumes(raw, "doc_id", "raw")
    return good.select(
        "doc_id", F.col("content.basics.name").alias("name"), F.col("content.basics.label").alias("label"),
        F.size("content.experience").alias("jobs"),
    )


@query("rejected_resumes", "SELECT doc_id, 'not a resume document' AS reason FROM documents WHERE doc_id % 8 IN (5, 6)")
def rejected_resumes(spark, sf):
    doc = F.col("doc_id")
    raw = V.table(spark, sf, "documents").withColumn(
        "raw", F.when(doc % 8 == 5, "[1, 2]").when(doc % 8 == 6, F.col("text")).otherwise('{"basics": {"name": "x"}}')
    )
    return docs.load_resumes(raw, "doc_id", "raw")[1].select("doc_id", "reason")


# --- text scalars -----------------------------------------------------------


@query("term_keys", with_views("segs", f"SELECT doc_id, idx, {fold_sql('line')} AS term_key FROM segs"))
def term_keys(spark, sf):
    return V.lines(spark, sf).select("doc_id", "idx", T.term_key(F.col("line")).alias("term_key"))


@query(
    "plain_texts",
    f"SELECT doc_id, md5({plain_sql('text')}) AS plain_md5, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS squash_md5, "
    "length(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS bullet_key_chars, "
    "len(regexp_extract_all(text, '\\S+')) AS words, "
    "CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 220 THEN left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 219) || '…' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS snippet FROM documents",
)
def plain_texts(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", F.md5(T.plain(t)).alias("plain_md5"), F.md5(T.squash(t)).alias("squash_md5"),
        F.length(T.bullet_key(t)).alias("bullet_key_chars"), T.word_count(t).alias("words"), T.snippet(t).alias("snippet"),
    )


@query(
    "dehyphenated_texts",
    "SELECT doc_id, length(regexp_replace(replace(text, ' the ', '-' || chr(10)), '(\\p{Ll})-\\n(\\p{Ll})', '\\1\\2', 'g')) AS chars FROM documents",
)
def dehyphenated_texts(spark, sf):
    broken = F.replace("text", F.lit(" the "), F.lit("-\n"))
    return V.table(spark, sf, "documents").select("doc_id", F.length(T.dehyphenate(broken)).alias("chars"))


_STOP = "[" + ", ".join(f"'{w}'" for w in vocab.LETTER_STOPWORDS) + "]"
_DISTINCTIVE = f"""list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(lower({{x}}), '[^a-z0-9.]+'), lambda t: regexp_replace(t, '^\\.+|\\.+$', '', 'g')),
    lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t)),
    lambda t: CASE WHEN length(t) >= 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END))"""


@query("distinctive_terms", "SELECT doc_id, array_to_string(list_sort(" + _DISTINCTIVE.format(x="text") + "), ' ') AS terms FROM documents")
def distinctive_terms(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.array_sort(T.distinctive_terms(F.col("text"))), " ").alias("terms")
    )


@query(
    "reply_objects",
    """SELECT conv_id, turn, turn AS tier_no, CASE WHEN turn % 3 <> 2 THEN 'strong' END AS tier FROM conversations""",
)
def reply_objects(spark, sf):
    """JSON replies inside chatter, in a fence, or absent."""
    turn = F.col("turn")
    body = F.to_json(F.struct(F.lit("strong").alias("tier"), F.col("text").alias("note")))
    reply = (
        F.when(turn % 3 == 0, F.concat(F.lit("Sure! "), body, F.lit(" Done.")))
        .when(turn % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n``` bye")))
        .otherwise(F.regexp_replace("text", "[{}]", ""))
    )
    parsed = F.from_json(T.first_json_object(reply, fenced=True), "tier string, note string")
    return V.table(spark, sf, "conversations").select("conv_id", "turn", turn.alias("tier_no"), parsed["tier"].alias("tier"))


# --- terms and coverage -----------------------------------------------------

_TERMS = "prose pl tech known wanted terms"


@query("posting_terms", with_views(_TERMS, "SELECT doc_id, term_key, term FROM terms"))
def posting_terms(spark, sf):
    return K.posting_terms(V.prose(spark, sf), "doc_id", "text").select("doc_id", "term_key", "term")


VIEWS["covered"] = f"""
  SELECT r.doc_id AS pair_id, t.term, t.at_, t.term_key IS NOT NULL AS asked, xor(r.doc_id, 1) IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 4) AS described,
    t.term_key IS NOT NULL AND contains(f.folded, ' ' || t.term_key || ' ') AS hit
  FROM rs r LEFT JOIN terms t ON t.doc_id = xor(r.doc_id, 1) AND t.doc_id % 9 <> 4
  JOIN (SELECT doc_id, string_agg(' ' || {fold_sql('value')} || ' ', chr(10)) AS folded FROM lv
        WHERE key NOT IN ('start', 'end', 'phone') AND NOT (section = 'projects' AND key = 'url') GROUP BY doc_id) f ON f.doc_id = r.doc_id"""


def _coverage(spark, sf):
    """Each resume against its neighbour's posting; one posting in nine is blank."""
    resumes = V.resumes(spark, sf)
    folded = resumes.select("doc_id", K.folded_text(L.searchable_values(F.col("content"))).alias("folded"))
    pairs = resumes.select(F.col("doc_id").alias("pair_id"), "doc_id", F.col("doc_id").bitwiseXOR(F.lit(1)).alias("posting_id"))
    blank = F.col("doc_id") % 9 == 4
    postings = V.prose(spark, sf).select(F.col("doc_id").alias("posting_id"), F.when(blank, "  ").otherwise(F.col("text")).alias("text"))
    terms = K.term_lists(postings.withColumn("described", T.trim(F.coalesce("text", F.lit(""))) != ""), "posting_id", "text", ["described"])
    return K.coverage(pairs, terms, "posting_id", folded, "doc_id")


@query(
    "keyword_coverage",
    with_views(
        f"{_TERMS} rs je bl lv covered",
        """SELECT pair_id, coalesce(string_agg(term, '|' ORDER BY at_) FILTER (WHERE hit), '') AS matched,
             coalesce(string_agg(term, '|' ORDER BY at_) FILTER (WHERE asked AND NOT hit), '') AS missing FROM covered GROUP BY pair_id""",
    ),
)
def keyword_coverage(spark, sf):
    return _coverage(spark, sf).select(
        "pair_id", F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing")
    )


VIEWS["o_cov"] = """
  SELECT pair_id AS doc_id, 'keyword_coverage' AS kind,
    CASE WHEN count(*) FILTER (WHERE asked) > 0 AND count(*) FILTER (WHERE asked AND NOT hit) = 0 THEN 'pass' ELSE 'warn' END AS verdict,
    CASE WHEN count(*) FILTER (WHERE asked) > 0 THEN count(*) FILTER (WHERE hit) || ' / ' || count(*) FILTER (WHERE asked) || ' JD terms' ELSE 'Not measured' END AS summary,
    CASE WHEN NOT bool_and(described) THEN 'No job description attached, so there are no terms to cover.'
         WHEN count(*) FILTER (WHERE asked) = 0 THEN 'No terms could be read out of this job description.' END AS error
  FROM covered GROUP BY pair_id"""


@query("coverage_outcomes", with_views(f"{_TERMS} rs je bl lv covered o_cov", "SELECT * FROM o_cov"))
def coverage_outcomes(spark, sf):
    return K.coverage_outcome(_coverage(spark, sf)).withColumnRenamed("pair_id", "doc_id")


@query(
    "phrase_hits",
    f"""WITH p AS (SELECT item_id * 1000 + i AS phrase_id, {fold_sql("x")} AS k FROM (
            SELECT item_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS i FROM (
              SELECT item_id, list_concat([text], string_split_regex(text, '[.!?,\\n]')) AS xs FROM benchmark))),
          q AS (SELECT * FROM p WHERE k <> ''),
          l AS (SELECT doc_id, ' ' || {fold_sql('line')} || ' ' AS f FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
        SELECT phrase_id, doc_id, count(*) AS lines FROM q JOIN l ON contains(f, ' ' || k || ' ') GROUP BY ALL""",
)
def phrase_hits(spark, sf):
    """Every benchmark text and its clauses as phrases."""
    text = F.col("text")
    parts = F.concat(F.array(text), F.split(text, r"[.!?,\n]"))
    phrases = V.table(spark, sf, "benchmark").select("item_id", F.posexplode(parts).alias("i", "x")).select(
        (F.col("item_id") * 1000 + F.col("i")).alias("phrase_id"), T.term_key(F.col("x")).alias("term_key")
    )
    lines = V.lines(spark, sf).select("doc_id", F.col("idx").alias("line_no"), F.col("line").alias("text"))
    return phrase_search.phrase_hits(phrases, lines)


# --- phrasing ---------------------------------------------------------------


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PATTERNS = ", ".join(
    f"({i}, {_quote('(?i)' + p.replace('{B}', chr(92) + 'b').replace('{E}', chr(92) + 'b'))}, {_quote(s)})"
    for i, (p, s) in enumerate(vocab.BOILERPLATE)
)


def _stock_sql(source: str, keys: str, text: str) -> str:
    # RE2 patterns with one group per alternative would return groups; the whole match is group 0.
    return (
        f"SELECT {keys}, n AS pattern_no, unnest(regexp_extract_all({text}, rx, 0)) AS phrase, s AS suggestion "
        f"FROM {source}, (VALUES {_PATTERNS}) AS pt(n, rx, s)"
    )


@query("boilerplate_phrases", with_views("prose", _stock_sql("prose", "doc_id", "text")))
def boilerplate_phrases(spark, sf):
    return K.boilerplate(V.prose(spark, sf), ["doc_id"], "text")


@query("conversation_boilerplate", _stock_sql("(SELECT conv_id, turn, replace(text, ' de ', ' leveraging ') AS text FROM conversations)", "conv_id, turn", "text"))
def conversation_boilerplate(spark, sf):
    units = V.table(spark, sf, "conversations").withColumn("text", F.replace("text", F.lit(" de "), F.lit(" leveraging ")))
    return K.boilerplate(units, ["conv_id", "turn"], "text")


def _stacks_sql(source: str, keys: str, text: str) -> str:
    skip = "[" + ", ".join(f"'{w}'" for w in vocab.NOT_MANNER_ADVERBS) + "]"
    return f"""SELECT {keys}, sentence_no, trim(s) AS phrase, array_to_string(a, ', ') AS adverbs FROM (
        SELECT {keys}, sentence_no, s, list_filter(regexp_extract_all(s, '(?i)\\b[a-z]{{4,}}ly\\b'), lambda w: NOT list_contains({skip}, lower(w))) AS a
        FROM (SELECT {keys}, generate_subscripts(ss, 1) - 1 AS sentence_no, unnest(ss) AS s
              FROM (SELECT {keys}, string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM {source})))
      WHERE len(a) >= 3"""


@query("adverb_stacks", _stacks_sql("documents", "doc_id", "text"))
def adverb_stacks(spark, sf):
    return K.adverb_stacks(V.table(spark, sf, "documents"), ["doc_id"], "text").withColumn("adverbs", F.array_join("adverbs", ", "))


VIEWS["pu"] = "SELECT doc_id, path, value FROM lv WHERE path IN ('basics.label', 'basics.summary') OR (section = 'experience' AND key = 'title') OR key IN ('description', 'bullets')"
VIEWS["flags"] = (
    f"SELECT doc_id, path, phrase, suggestion FROM ({_stock_sql('pu', 'doc_id, path', 'value')}) UNION ALL "
    "SELECT doc_id, path, phrase, 'Three adverbs in one sentence (' || adverbs || ') — keep the strongest verb and drop the rest.' "
    f"FROM ({_stacks_sql('pu', 'doc_id, path', 'value')})"
)


@query("phrase_flags", with_views("rs je bl lv pu flags", "SELECT * FROM flags"))
def phrase_flags(spark, sf):
    return K.phrase_flags(V.resumes(spark, sf), "doc_id")


# --- lint -------------------------------------------------------------------

_WORDS = "len(regexp_extract_all(value, '\\S+'))"
_BKEY = "trim(regexp_replace(lower(value), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_SHAPE = r"""CASE WHEN regexp_full_match(value, '\d{4}(-\d{1,2})?') THEN 'iso' WHEN regexp_full_match(value, '[A-Za-z]{3,9}\.?\s+\d{4}') THEN 'month-name'
   WHEN regexp_full_match(value, '\d{1,2}/\d{4}') THEN 'slashed' ELSE 'other' END"""

VIEWS["li"] = f"""
  SELECT doc_id, 'bullet-too-long' AS code, path, path || ' runs ' || {_WORDS} || ' words; past 32 a bullet wraps to three or more lines on the page.' AS detail
  FROM bl WHERE {_WORDS} > 32
  UNION ALL
  SELECT doc_id, 'first-person', path, path || ' opens with “' || regexp_extract(trim(value), '(?i)^(i[''’](m|ve|d|ll)|i|my|mine|me)\\b') || '”; every other bullet starts with a verb.'
  FROM bl WHERE regexp_matches(trim(value), '(?i)^(i[''’](m|ve|d|ll)|i|my|mine|me)\\b')
  UNION ALL
  SELECT doc_id, 'duplicate-bullet', path, path || ' repeats the text already at ' || f || ', word for word.'
  FROM (SELECT *, first_value(path) OVER (PARTITION BY doc_id, {_BKEY} ORDER BY e, j) AS f FROM bl WHERE {_BKEY} <> '') WHERE f <> path
  UNION ALL
  SELECT doc_id, 'trailing-punctuation-mixed', path, path || CASE WHEN w <= o THEN ' ends with a period' ELSE ' ends without a period' END || ', while ' || greatest(w, o)
    || ' other ' || CASE WHEN greatest(w, o) = 1 THEN 'bullet' ELSE 'bullets' END || ' end ' || CASE WHEN w <= o THEN 'without one' ELSE 'with one' END || '.'
  FROM (SELECT *, count(*) FILTER (WHERE trim(value) LIKE '%.') OVER (PARTITION BY doc_id) AS w, count(*) FILTER (WHERE trim(value) NOT LIKE '%.') OVER (PARTITION BY doc_id) AS o
        FROM bl WHERE trim(value) <> '')
  WHERE w > 0 AND o > 0 AND (trim(value) LIKE '%.') = (w <= o)
  UNION ALL
  SELECT doc_id, 'date-format-mixed', path, path || ' reads “' || value || '” while ' || n || ' other dates use the “' || ex || '” form.'
  FROM (SELECT d.*, m.shape AS main, m.n, m.ex FROM
      (SELECT *, {_SHAPE} AS shape FROM lv WHERE section IN ('experience', 'education') AND key IN ('start', 'end') AND lower(value) <> 'present') d
      JOIN (SELECT doc_id, max_by(shape, (n, -f)) AS shape, max_by(ex, (n, -f)) AS ex, max(n) AS n FROM (
          SELECT doc_id, shape, count(*) AS n, min(o) AS f, min_by(value, o) AS ex FROM (
            SELECT doc_id, value, {_SHAPE} AS shape, CASE section WHEN 'experience' THEN 0 ELSE 1000000 END + entry * 2 + CASE key WHEN 'start' THEN 0 ELSE 1 END AS o
            FROM lv WHERE section IN ('experience', 'education') AND key IN ('start', 'end') AND lower(value) <> 'present') GROUP BY ALL) GROUP BY doc_id) m USING (doc_id))
  WHERE shape <> main
  UNION ALL
  SELECT doc_id, 'stale-end-date', 'experience[' || l.e || '].end', 'experience[' || l.e || '].end reads “' || l.t || '”, about ' || y || CASE WHEN y = 1 THEN ' year' ELSE ' years' END
    || ' ago, and no role is marked current. If it is current, say Present; if not, one line naming the break saves the reader guessing.'
  FROM (SELECT doc_id, max_by({{'e': e, 't': end_}}, (end_m, -e)) AS l, 2020 * 12 + 5 - max(end_m) AS mo, (2020 * 12 + 5 - max(end_m)) // 12 AS y
        FROM je GROUP BY doc_id HAVING NOT bool_or(end_ IS NULL OR end_ = 'Present')) WHERE mo > 18
  UNION ALL
  SELECT doc_id, 'skills-undifferentiated', 'skills[0]', 'skills[0] (Words) lists ' || len(string_split(ls[1], ' ')) || ' items in one group; splitting it, or cutting to the ones this role is about, tells a reader which ones you would be hired for.'
  FROM rs WHERE len(string_split(ls[1], ' ')) > 12
  UNION ALL
  SELECT doc_id, 'empty-section', 'projects[0]', 'projects[0] (Project ' || (doc_id % 5) || ') has no description and no bullets.' FROM rs WHERE len(ls) = 1 OR ls[len(ls)] = ''
  UNION ALL
  SELECT doc_id, 'empty-section', 'custom[0]', 'custom[0] (Notes) lists no lines.' FROM rs WHERE doc_id % 10 = 0"""


def _issues(spark, sf):
    return K.lint(V.resumes(spark, sf), "doc_id", _now())


@query("format_lint", with_views("rs je bl lv li", "SELECT doc_id, code, path, detail FROM li"))
def format_lint(spark, sf):
    return _issues(spark, sf).select("doc_id", "code", "path", "detail")


@query("empty_sections", with_views("rs je bl lv li", "SELECT doc_id, path, detail FROM li WHERE code = 'empty-section'"))
def empty_sections(spark, sf):
    return L.empty_sections(V.resumes(spark, sf), "doc_id").select("doc_id", "path", "detail")


def _line_bullets(spark, sf):
    """Plain document lines as bullets."""
    return V.lines(spark, sf).select(
        "doc_id", F.col("idx").alias("leaf_no"), F.concat(F.lit("lines["), F.col("idx").cast("string"), F.lit("]")).alias("path"),
        F.col("line").alias("text"),
    ).where(T.trim(F.col("text")) != "")


@query("long_lines", with_views("segs", "SELECT doc_id, 'lines[' || idx || ']' AS path FROM segs WHERE len(regexp_extract_all(line, '\\S+')) > 32"))
def long_lines(spark, sf):
    return K.long_bullets(_line_bullets(spark, sf), "doc_id").select("doc_id", "path")


_OPENERS = ["I ", "My ", "I’ve ", "me, ", "Mine", "Im ", "IT "]


@query(
    "first_person_lines",
    with_views(
        "segs",
        f"""SELECT doc_id, 'lines[' || idx || ']' AS path FROM (
              SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN [{", ".join(f"'{o}'" for o in _OPENERS)}][1 + (doc_id + idx) % {len(_OPENERS)}] || line ELSE line END AS line FROM segs)
            WHERE regexp_matches(trim(line), '(?i)^(i[''’](m|ve|d|ll)|i|my|mine|me)([^A-Za-z0-9_]|$)')""",
    ),
)
def first_person_lines(spark, sf):
    """Every third line opens with a word of the writer, or one that only looks like it."""
    at = F.col("leaf_no")
    opener = F.get(F.array(*[F.lit(o) for o in _OPENERS]), ((F.col("doc_id") + at) % len(_OPENERS)).cast("int"))
    lines = _line_bullets(spark, sf).withColumn("text", F.when(at % 3 == 0, F.concat(opener, F.col("text"))).otherwise(F.col("text")))
    return K.first_person(lines, "doc_id").select("doc_id", "path")


@query(
    "duplicate_lines",
    with_views(
        "segs",
        """, k AS (SELECT *, trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM segs)
           SELECT doc_id, 'lines[' || idx || ']' AS path, 'lines[' || f || ']' AS first_path
           FROM (SELECT *, min(idx) OVER (PARTITION BY doc_id, k) AS f FROM k WHERE k <> '') WHERE f < idx""",
    ),
)
def duplicate_lines(spark, sf):
    return K.repeated_bullets(_line_bullets(spark, sf), "doc_id").select(
        "doc_id", "path", F.regexp_extract("detail", r"already at (\S+),", 1).alias("first_path")
    )


@query(
    "mixed_punctuation",
    with_views(
        "segs",
        """, c AS (SELECT *, count(*) FILTER (WHERE trim(line) LIKE '%.') OVER (PARTITION BY doc_id) AS w, count(*) FILTER (WHERE trim(line) NOT LIKE '%.') OVER (PARTITION BY doc_id) AS o
             FROM segs WHERE trim(line) <> '')
           SELECT doc_id, 'lines[' || idx || ']' AS path FROM c WHERE w > 0 AND o > 0 AND (trim(line) LIKE '%.') = (w <= o)""",
    ),
)
def mixed_punctuation(spark, sf):
    return K.mixed_punctuation(_line_bullets(spark, sf), "doc_id").select("doc_id", "path")


@query(
    "mixed_dates",
    with_views("rs je bl lv li", "SELECT doc_id, path, detail FROM li WHERE code = 'date-format-mixed'"),
)
def mixed_dates(spark, sf):
    rows = L.dated(L.leaves(V.resumes(spark, sf), "doc_id")).select("doc_id", "leaf_no", "path", F.col("value").alias("text"))
    return K.mixed_dates(rows, "doc_id").select("doc_id", "path", "detail")


# --- fidelity, confidence, all ----------------------------------------------

VIEWS["fl"] = """
  SELECT *, NOT ((section = 'experience' AND key = 'bullets' AND (doc_id + item) % 6 = 0) OR (section = 'education' AND doc_id % 11 = 0)) AS survived FROM lv"""

VIEWS["fid"] = """
  SELECT doc_id, CASE WHEN m THEN d ELSE 0 END AS dropped, CASE WHEN m THEN c ELSE 0 END AS checked,
    m AND doc_id % 11 = 0 AS structural_loss,
    CASE WHEN NOT m THEN 'warn' WHEN d = 0 THEN 'pass' WHEN doc_id % 11 = 0 OR d > 0.2 * c THEN 'fail' ELSE 'warn' END AS verdict,
    CASE WHEN m THEN d || ' of ' || c || ' fields dropped' ELSE 'Not measured' END AS summary,
    CASE WHEN NOT m THEN 'The ATS parser could not read this résumé.' END AS error
  FROM (SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE NOT survived) AS d, doc_id % 17 <> 0 AS m FROM fl GROUP BY doc_id)"""


def _fidelity(spark, sf):
    return K.fidelity(V.resumes(spark, sf), V.parsed_resumes(spark, sf), "doc_id")


@query("parse_fidelity", with_views("rs je bl lv fl fid", "SELECT * FROM fid"))
def parse_fidelity(spark, sf):
    return _fidelity(spark, sf)


@query("dropped_fields", with_views("rs je bl lv fl", "SELECT doc_id, path FROM fl WHERE NOT survived OR doc_id % 17 = 0"))
def dropped_fields(spark, sf):
    lost = K.dropped_leaves(V.resumes(spark, sf), V.parsed_resumes(spark, sf), "doc_id")
    return lost.where(~F.col("survived")).select("doc_id", "path")


@query(
    "field_recall",
    with_views(
        "rs je bl lv fl",
        """SELECT doc_id, count(*) AS labelled, count(*) FILTER (WHERE doc_id % 17 <> 0 AND survived AND NOT (section = 'experience' AND key = 'bullets' AND contains(value, ' '))) AS found,
             round(count(*) FILTER (WHERE doc_id % 17 <> 0 AND survived AND NOT (section = 'experience' AND key = 'bullets' AND contains(value, ' '))) / count(*), 9) AS recall FROM fl GROUP BY doc_id""",
    ),
)
def field_recall(spark, sf):
    return K.field_recall(V.resumes(spark, sf), V.parsed_resumes(spark, sf), "doc_id").withColumn("recall", F.round("recall", 9))


VIEWS["hay"] = f"SELECT doc_id, {plain_sql('text')} AS hay FROM documents"
_CONF = f"""CASE WHEN contains(hay, {plain_sql('value')}) THEN 1.0 WHEN key IN ('start', 'end') THEN 0.8 ELSE 0.5 END"""


@query("import_confidence", with_views("rs je bl lv hay", f"SELECT doc_id, path, CAST({_CONF} AS DOUBLE) AS confidence FROM lv JOIN hay USING (doc_id)"))
def import_confidence(spark, sf):
    return K.import_confidence(V.resumes(spark, sf), "doc_id", "text").select("doc_id", "path", "confidence")


@query(
    "low_confidence_fields",
    with_views("rs je bl lv hay", f"SELECT doc_id, count(*) AS fields FROM lv JOIN hay USING (doc_id) WHERE {_CONF} < 1 GROUP BY doc_id"),
)
def low_confidence_fields(spark, sf):
    scored = K.import_confidence(V.resumes(spark, sf), "doc_id", "text")
    return K.low_confidence(scored).groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"))


def _ratings(spark, sf):
    tier = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "strong").when(F.col("quality") == 1, "possible").otherwise("reach")
    )
    return V.table(spark, sf, "labels").select("doc_id", tier.alias("tier"), (1 + F.col("doc_id") % 3).alias("reason_count"))


VIEWS["o_rest"] = """
  SELECT r.doc_id, 'format_lint' AS kind, CASE WHEN n IS NULL THEN 'pass' ELSE 'warn' END AS verdict,
    CASE WHEN n IS NULL THEN 'clean' ELSE n || CASE WHEN n = 1 THEN ' issue' ELSE ' issues' END END AS summary, NULL AS error
  FROM rs r LEFT JOIN (SELECT doc_id, count(*) AS n FROM li GROUP BY doc_id) USING (doc_id)
  UNION ALL
  SELECT r.doc_id, 'ai_tell', CASE WHEN n IS NULL THEN 'pass' ELSE 'warn' END,
    CASE WHEN n IS NULL THEN 'clean' ELSE n || CASE WHEN n = 1 THEN ' phrase flagged' ELSE ' phrases flagged' END END, NULL
  FROM rs r LEFT JOIN (SELECT doc_id, count(*) AS n FROM flags GROUP BY doc_id) USING (doc_id)
  UNION ALL
  SELECT r.doc_id, 'match_rating', CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' ELSE 'warn' END,
    CASE WHEN quality IS NULL THEN 'Not measured — no model configured' ELSE CASE WHEN quality = 1 AND toxic = 0 THEN 'Strong' WHEN quality = 1 THEN 'Possible' ELSE 'Reach' END
      || ' — ' || (1 + r.doc_id % 3) || CASE WHEN r.doc_id % 3 = 0 THEN ' reason' ELSE ' reasons' END END,
    CASE WHEN quality IS NULL THEN 'No rating was returned.' END
  FROM rs r LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 'parse_fidelity', verdict, summary, error FROM fid"""


@query(
    "all_checks",
    with_views(
        f"{_TERMS} rs je bl lv covered o_cov pu flags li fl fid o_rest",
        """SELECT k.n AS kind_no, o.* FROM (SELECT * FROM o_rest UNION ALL SELECT * FROM o_cov) o
           JOIN (VALUES (0, 'parse_fidelity'), (1, 'keyword_coverage'), (2, 'format_lint'), (3, 'ai_tell'), (4, 'match_rating')) AS k(n, kind) USING (kind)""",
    ),
)
def all_checks(spark, sf):
    documents = V.resumes(spark, sf)
    outcomes = [
        _fidelity(spark, sf).withColumn("kind", F.lit("parse_fidelity")),
        K.coverage_outcome(_coverage(spark, sf)).withColumnRenamed("pair_id", "doc_id"),
        K.lint_outcome(documents, _issues(spark, sf), "doc_id"),
        K.phrasing_outcome(documents, K.phrase_flags(documents, "doc_id"), "doc_id"),
        K.rating_outcome(documents, _ratings(spark, sf), "doc_id"),
    ]
    return K.all_checks(documents, outcomes, "doc_id")
