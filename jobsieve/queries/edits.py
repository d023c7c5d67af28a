"""Differences, change validation and provenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testviews as V
from ..functions.word_diff import word_diff as word_segments
from ..operators import diff as X
from ..operators import merge
from ..operators import provenance as P
from ..operators import pull_in
from .documents import _DISTINCTIVE
from .registry import VIEWS, query, with_views

# --- differences ------------------------------------------------------------


@query(
    "field_changes",
    with_views(
        "turns",
        """SELECT conv_id, turn, CASE WHEN a = b THEN NULL WHEN a = '' THEN 'add' WHEN b = '' THEN 'remove' ELSE 'edit' END AS kind
           FROM (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN '' ELSE was END AS a,
                   CASE WHEN conv_id % 4 = 1 THEN '' WHEN conv_id % 4 = 2 THEN was ELSE now END AS b FROM turns)""",
    ),
)
def field_changes(spark, sf):
    c = F.col("conv_id") % 4
    was = F.when(c != 0, F.col("was"))
    now = F.when(c == 1, "").when(c == 2, F.col("was")).otherwise(F.col("now"))
    return V.turns(spark, sf).select("conv_id", "turn", X.field_change(was, now).alias("kind"))


_LISTS = """
  , p AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN list_reverse(string_split(was, ' ')) WHEN conv_id % 5 = 1 THEN string_split(was, ' ')
         ELSE string_split(now, ' ') END AS b, string_split(was, ' ') AS a FROM turns),
    d AS (SELECT * FROM p WHERE a <> b),
    ro AS (SELECT * FROM d WHERE list_sort(a) = list_sort(b)),
    ch AS (SELECT * FROM d WHERE list_sort(a) <> list_sort(b)),
    wa AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, v ORDER BY i) AS n FROM (SELECT conv_id, turn, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS i FROM ch)),
    no AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, v ORDER BY i) AS n FROM (SELECT conv_id, turn, unnest(b) AS v, generate_subscripts(b, 1) - 1 AS i FROM ch)),
    m AS (SELECT coalesce(wa.conv_id, no.conv_id) AS conv_id, coalesce(wa.turn, no.turn) AS turn, wa.i AS wi, no.i AS ni, wa.v AS wv, no.v AS nv
          FROM wa FULL JOIN no USING (conv_id, turn, v, n)),
    lw AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY wi) AS s FROM m WHERE ni IS NULL),
    ln AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ni) AS s FROM m WHERE wi IS NULL),
    lo AS (SELECT coalesce(lw.conv_id, ln.conv_id) AS conv_id, coalesce(lw.turn, ln.turn) AS turn, lw.wi, ln.ni, lw.wv, ln.nv FROM lw FULL JOIN ln USING (conv_id, turn, s)),
    de AS (SELECT DISTINCT conv_id, turn FROM (SELECT *, lag(wi) OVER (PARTITION BY conv_id, turn ORDER BY ni) AS b FROM m WHERE wi IS NOT NULL AND ni IS NOT NULL) WHERE wi < b)"""


@query(
    "list_diff",
    with_views(
        "turns",
        f"""{_LISTS} SELECT conv_id, turn, 'reorder' AS kind, 'words' AS path, array_to_string(a, ' · ') AS was_text, array_to_string(b, ' · ') AS now_text FROM ro
            UNION ALL SELECT conv_id, turn, CASE WHEN wi IS NULL THEN 'add' WHEN ni IS NULL THEN 'remove' ELSE 'edit' END, 'words[' || coalesce(ni, wi) || ']', wv, nv FROM lo
            UNION ALL SELECT conv_id, turn, 'reorder', 'words', NULL, NULL FROM de""",
    ),
)
def list_diff(spark, sf):
    c = F.col("conv_id") % 5
    was, now = F.split("was", " "), F.split("now", " ")
    pairs = V.turns(spark, sf).select(
        "conv_id", "turn", F.lit("words").alias("path"), was.alias("was"),
        F.when(c == 0, F.reverse(was)).when(c == 1, was).otherwise(now).alias("now"),
    )
    return X.list_diff(pairs, ["conv_id", "turn"]).drop("seq")


def _revised(spark, sf):
    """Each resume next to a revision of it, one kind of change per document."""
    doc, c = F.col("doc_id"), F.col("content")
    jobs = c["experience"]
    one = doc % 4
    reworded = F.transform(
        jobs,
        lambda e, i: F.when(
            i == 0,
            F.struct(
                e["company"], e["title"], e["location"], e["start"], e["end"],
                F.transform(e["bullets"], lambda b, j: F.when(j == 0, F.concat(b, F.lit(" v2"))).otherwise(b)).alias("bullets"),
            ),
        ).otherwise(e),
    )
    extra = F.array(F.struct(F.lit("Extra").alias("title"), F.array(F.lit("x")).alias("bullets")))
    now = F.struct(
        F.struct(
            c["basics"]["name"].alias("name"), F.concat(c["basics"]["label"], F.lit("+")).alias("label"), c["basics"]["email"].alias("email"),
            F.lit(None).cast("string").alias("phone"), F.lit("https://x.io").alias("url"), c["basics"]["location"].alias("location"),
            c["basics"]["summary"].alias("summary"),
        ).alias("basics"),
        F.when(one == 0, reworded).when((one == 1) & (F.size(jobs) > 0), F.slice(jobs, 1, F.size(jobs) - 1)).otherwise(jobs).alias("experience"),
        c["education"].alias("education"),
        F.when(one == 3, F.transform(c["skills"], lambda g: F.struct(g["category"], F.reverse(g["items"]).alias("items")))).otherwise(c["skills"]).alias("skills"),
        c["projects"].alias("projects"),
        F.when(one == 2, F.concat(c["custom"], extra)).otherwise(c["custom"]).alias("custom"),
    )
    return V.resumes(spark, sf).select("doc_id", c.alias("was"), now.alias("now"))


@query(
    "semantic_diff",
    with_views(
        "rs je bl",
        """, sk AS (SELECT doc_id, string_split(ls[1], ' ') AS it FROM rs)
           SELECT doc_id, 'edit' AS kind, 'basics.label' AS path, source AS was_text, source || '+' AS now_text FROM rs
           UNION ALL SELECT doc_id, 'remove', 'basics.phone', '+1 555 0100', NULL FROM rs
           UNION ALL SELECT doc_id, 'add', 'basics.url', NULL, 'https://x.io' FROM rs
           UNION ALL SELECT doc_id, 'edit', path, value, value || ' v2' FROM bl WHERE doc_id % 4 = 0 AND e = 0 AND j = 0
           UNION ALL SELECT DISTINCT doc_id, 'reorder', 'experience[0].bullets', NULL, NULL
             FROM (SELECT doc_id, j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS gap
                   FROM bl b JOIN (SELECT doc_id, value FROM bl WHERE e = 0 AND j = 0) f USING (doc_id, value) WHERE e = 0 AND doc_id % 4 = 0) WHERE gap >= 2
           UNION ALL SELECT doc_id, 'remove', 'experience[' || e || ']', title || ' — ' || company, NULL FROM je WHERE doc_id % 4 = 1 AND e = (SELECT max(e) FROM je k WHERE k.doc_id = je.doc_id)
           UNION ALL SELECT doc_id, 'add', 'custom[' || CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END || ']', NULL, 'Extra' FROM rs WHERE doc_id % 4 = 2
           UNION ALL SELECT doc_id, 'reorder', 'skills[0].items', array_to_string(it, ' · '), array_to_string(list_reverse(it), ' · ') FROM sk WHERE doc_id % 4 = 3 AND it <> list_reverse(it)""",
    ),
)
def semantic_diff(spark, sf):
    return X.semantic_diff(_revised(spark, sf), "doc_id")


@query(
    "line_changes",
    with_views(
        "turns",
        """, a AS (SELECT conv_id, turn, unnest(string_split(was, chr(10))) AS line FROM turns), b AS (SELECT conv_id, turn, unnest(string_split(now, chr(10))) AS line FROM turns),
           g AS (SELECT conv_id, turn, line, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL),
           h AS (SELECT conv_id, turn, line, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL)
           SELECT conv_id, turn, line, n AS removed, 0 AS added FROM g UNION ALL SELECT conv_id, turn, line, 0, n FROM h""",
    ),
)
def line_changes(spark, sf):
    pairs = V.turns(spark, sf)
    lines = lambda c: pairs.select("conv_id", "turn", F.explode(F.split(c, "\n")).alias("line"))
    return X.value_changes(lines("was"), lines("now"), ["conv_id", "turn"], "line")


# Lengths of common subsequences by diagonals of the table, from its end; the letters say which way each
# cell is left (m both, d the old token, a the new one) and are followed from the beginning.
_WHITE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_WORD_DIFF = rf"""
  , pairs AS (SELECT row_number() OVER () AS g, * FROM turns),
  cut AS (SELECT *, regexp_extract_all(was, '{_WHITE}+|[\p{{L}}\p{{N}}]+(?:[''’\-/.][\p{{L}}\p{{N}}]+)*%?|[^ ]') AS a,
      regexp_extract_all(now, '{_WHITE}+|[\p{{L}}\p{{N}}]+(?:[''’\-/.][\p{{L}}\p{{N}}]+)*%?|[^ ]') AS b FROM pairs),
  diag AS (SELECT g, a, b, CAST(len(a) AS INT) AS n, CAST(len(b) AS INT) AS m, CAST(len(a) + len(b) - 1 AS INT) AS s,
      list_resize(CAST([] AS INT[]), len(a) + 2, 0) AS l1, list_resize(CAST([] AS INT[]), len(a) + 2, 0) AS l2, '' AS way FROM cut
    UNION ALL
    SELECT g, a, b, n, m, s - 1,
      list_concat(list_transform(range(0, n + 1), lambda i: CAST(CASE WHEN i >= n OR s - i >= m OR i > s THEN 0 WHEN a[i + 1] = b[s - i + 1] THEN l2[i + 2] + 1
        ELSE greatest(l1[i + 2], l1[i + 1]) END AS INT)), [0]),
      l1,
      array_to_string(list_transform(range(0, n), lambda i: CASE WHEN s - i >= m OR i > s THEN '.' WHEN a[i + 1] = b[s - i + 1] THEN 'm'
        WHEN l1[i + 2] >= l1[i + 1] THEN 'd' ELSE 'a' END), '')
    FROM diag WHERE s >= 0),
  walk AS (SELECT g, list_reduce(list({{'i': CAST(0 AS INT), 's': s + 1, 'way': way}} ORDER BY s), lambda w, x:
      CASE WHEN x.s <> w.s OR w.i >= n OR w.s - w.i >= m THEN w
        ELSE {{'i': w.i + CASE WHEN x.way[w.i + 1] = 'a' THEN 0 ELSE 1 END, 's': w.s + CASE WHEN x.way[w.i + 1] = 'm' THEN 2 ELSE 1 END, 'way': w.way || x.way[w.i + 1]}} END,
      {{'i': CAST(0 AS INT), 's': CAST(0 AS INT), 'way': ''}}) AS w FROM diag WHERE s < n + m - 1 GROUP BY g, n, m),
  ops AS (SELECT g, conv_id, turn, a, b, coalesce(w.way || repeat('d', len(a) - w.i) || repeat('a', len(b) - (w.s - w.i)), repeat('d', len(a)) || repeat('a', len(b))) AS ops
    FROM cut LEFT JOIN walk USING (g)),
  op AS (SELECT g, conv_id, turn, k, o, CASE WHEN o = 'a' THEN b[count(*) FILTER (o <> 'd') OVER w] ELSE a[count(*) FILTER (o <> 'a') OVER w] END AS token
    FROM (SELECT g, conv_id, turn, a, b, k, ops[k] AS o FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS k FROM ops)) WINDOW w AS (PARTITION BY g ORDER BY k)),
  run AS (SELECT g, conv_id, turn, o, min(k) AS k, string_agg(token, '' ORDER BY k) AS text
    FROM (SELECT *, k - row_number() OVER (PARTITION BY g, o ORDER BY k) AS block FROM op) GROUP BY g, conv_id, turn, o, block),
  piece AS (SELECT * FROM (SELECT g, conv_id, turn, k, unnest(CASE WHEN o = 'm' THEN [{{'part': 1, 'type': 'same', 'text': text}}] ELSE [
      {{'part': 0, 'type': 'same', 'text': regexp_extract(text, '^{_WHITE}*')}},
      {{'part': 1, 'type': CASE o WHEN 'd' THEN 'del' ELSE 'add' END, 'text': regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g')}},
      {{'part': 2, 'type': 'same', 'text': CASE WHEN regexp_matches(text, '^{_WHITE}*$') THEN '' ELSE regexp_extract(text, '{_WHITE}*$') END}}] END, recursive := true)
      FROM run) WHERE text <> ''),
  put AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY g ORDER BY k, part) AS before FROM piece)
    WHERE NOT (type = 'same' AND regexp_matches(text, '^{_WHITE}+$') AND before IS NOT NULL AND regexp_matches(before, '{_WHITE}$'))),
  block AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k, part) - row_number() OVER (PARTITION BY g, type ORDER BY k, part) AS block FROM put)
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY g ORDER BY min(3 * k + part)) - 1 AS INT) AS seq, type, string_agg(text, '' ORDER BY k, part) AS text
  FROM block GROUP BY g, conv_id, turn, type, block"""


@query("word_diff", with_views("turns", _WORD_DIFF).replace("WITH ", "WITH RECURSIVE ", 1))
def word_diff(spark, sf):
    pairs = V.turns(spark, sf)
    return pairs.select("conv_id", "turn", F.posexplode(word_segments(F.col("was"), F.col("now"))).alias("seq", "s")).select(
        "conv_id", "turn", "seq", F.col("s.type").alias("type"), F.col("s.text").alias("text")
    )


@query(
    "word_retention",
    with_views(
        "turns",
        """, w AS (SELECT conv_id, turn, regexp_extract_all(lower(was), '[\\p{L}\\p{N}''’]+') AS a, regexp_extract_all(lower(now), '[\\p{L}\\p{N}''’]+') AS b FROM turns),
           ca AS (SELECT conv_id, turn, v, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS v FROM w) GROUP BY ALL),
           cb AS (SELECT conv_id, turn, v, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS v FROM w) GROUP BY ALL),
           k AS (SELECT conv_id, turn, sum(ca.n) AS words, sum(least(ca.n, coalesce(cb.n, 0))) AS kept FROM ca LEFT JOIN cb USING (conv_id, turn, v) GROUP BY ALL)
           SELECT conv_id, turn, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
             round(CASE WHEN words > 0 THEN kept / words ELSE 0 END, 9) AS retained,
             coalesce(words, 0) > 0 AND 2 * coalesce(kept, 0) < coalesce(words, 0) AS rewritten FROM w LEFT JOIN k USING (conv_id, turn)""",
    ),
)
def word_retention(spark, sf):
    return X.word_retention(V.turns(spark, sf), ["conv_id", "turn"], "was", "now").withColumn("retained", F.round("retained", 9))


@query(
    "letter_words",
    "SELECT conv_id, CAST(sum(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}''’]+'))) AS BIGINT) AS words FROM conversations GROUP BY conv_id",
)
def letter_words(spark, sf):
    return X.letter_words(V.table(spark, sf, "conversations"), "conv_id", "text")


# --- proposed changes -------------------------------------------------------

VIEWS["b0"] = "SELECT rs.doc_id, ls, bl.value AS b0 FROM rs LEFT JOIN bl ON bl.doc_id = rs.doc_id AND e = 0 AND j = 0"


def _changes(spark, sf):
    """Twelve proposals per document, one for each way to pass or be refused."""
    c = F.col("content")
    summary = c["basics"]["summary"]
    first = F.get(F.get(c["experience"], 0)["bullets"], 0)
    bullet = "experience[0].bullets[0]"

    def words(text, n):
        return F.array_join(F.slice(F.split(text, " "), 1, n), " ")

    none = F.lit(None).cast("string")
    rows = [
        ("edit", bullet, F.concat(F.coalesce(first, F.lit("x")), F.lit(" more")), "experience.0.bullets.0", first),
        ("edit", "basics.summary", F.lit("new"), bullet, words(first, 3)),
        ("add", "experience[0].bullets", F.lit("x"), "basics.summary", words(summary, 6)),
        ("remove", "projects[9]", F.lit(""), bullet, F.lit("q")),
        ("edit", "skills[0].items[0]", F.lit("y"), "nowhere.path", F.lit("q")),
        ("reorder", "basics.name", F.lit("a · b"), bullet, F.lit("q")),
        ("edit", "basics.name", F.lit(""), bullet, F.lit("q")),
        ("swap", "  ", F.lit("z"), bullet, F.lit("q")),
        ("edit", "basics.name", F.lit("z"), "skills[0]", F.lit("q")),
        ("edit", "basics.name", F.lit("z"), "basics.email", F.lit("zzz zzz zzz zzz")),
        ("add", "skills[0].items[9999999]", F.lit("z"), "basics.email", F.lit("q")),
        ("edit", "basics.name", F.lit("z"), "basics.email", none),
    ]
    changes = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("change_no"), F.lit(k).alias("kind"), F.lit(p).alias("path"), n.alias("now"),
                F.lit(cp).alias("citation_path"), s.cast("string").alias("citation_snippet"),
            )
            for i, (k, p, n, cp, s) in enumerate(rows)
        ]
    )
    return V.resumes(spark, sf).select("doc_id", F.inline(changes))


_CITED = "Cited"
_PROPOSALS = """
  SELECT doc_id, i AS change_no, CASE i
      WHEN 0 THEN CASE WHEN b0 IS NULL THEN 'Cannot edit experience[0].bullets[0] — your résumé has no text there.' WHEN trim(b0) = '' THEN 'No source in your résumé — the model cited nothing for this.' END
      WHEN 1 THEN CASE WHEN coalesce(trim(array_to_string(string_split(b0, ' ')[1:3], ' ')), '') = '' THEN 'No source in your résumé — the model cited nothing for this.'
                       ELSE 'The quote from experience[0].bullets[0] is too little of it to carry this change.' END
      WHEN 2 THEN CASE WHEN len(ls) = 1 THEN 'Cannot add at experience[0].bullets — your résumé has nowhere to put it.'
                       WHEN trim(ls[1]) = '' THEN 'No source in your résumé — the model cited nothing for this.'
                       WHEN len(list_filter(string_split(ls[1], ' ')[1:6], lambda w: w <> '')) < 4 THEN 'The quote from basics.summary is too little of it to carry this change.' END
      WHEN 3 THEN 'Cannot remove projects[9] — your résumé has no such field.'
      WHEN 4 THEN 'Cited nowhere.path, which is not a field in your résumé.'
      WHEN 5 THEN 'Cannot reorder basics.name — your résumé has no list there.'
      WHEN 6 THEN 'The model proposed no text for this change.'
      WHEN 7 THEN 'The model did not say where this change goes.'
      WHEN 8 THEN 'Cited skills[0], which is not one field of your résumé.'
      WHEN 9 THEN 'The quoted text is not what basics.email says.'
      WHEN 10 THEN 'Cannot add at skills[0].items[9999999] — your résumé has nowhere to put it.'
      ELSE 'No source in your résumé — the model cited nothing for this.' END AS refused_reason
  FROM b0, (SELECT unnest(range(12)) AS i)"""
VIEWS["judged"] = _PROPOSALS


@query(
    "change_validation",
    with_views("rs je bl b0 judged", "SELECT doc_id, change_no, CASE WHEN refused_reason IS NULL THEN 'proposed' ELSE 'refused' END AS status, refused_reason FROM judged"),
)
def change_validation(spark, sf):
    return P.validate_changes(_changes(spark, sf), V.resumes(spark, sf), "doc_id").select(
        "doc_id", "change_no", "status", "refused_reason"
    )


def _accepted(spark, sf):
    """Edits (one overwritten by a later one), removals, additions, a reorder and strays."""
    rows = [
        ("edit", "experience[0].bullets[0]", "FIRST"), ("edit", "experience.0.bullets.0", "LAST"),
        ("remove", "experience[0].bullets[1]", ""), ("remove", "experience[0].bullets[2]", ""),
        ("add", "experience[0].bullets", "ADDED"), ("add", "experience[0].bullets[0]", "TOP"),
        ("remove", "skills[0].items[0]", ""), ("reorder", "custom", "a · b · c"),
        ("edit", "basics.url", "never"), ("remove", "basics.phone", ""),
    ]
    rows = [(k, p, F.lit(n)) for k, p, n in rows]
    items = F.get("content.skills", 0)["items"]
    rows.append(("reorder", "skills[0].items", F.array_join(F.reverse(F.slice(items, 2, F.size(items))), " · ")))
    changes = F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("change_no"), F.lit(k).alias("kind"), F.lit(p).alias("path"), n.alias("now"),
                     F.lit("proposed").alias("status"))
            for i, (k, p, n) in enumerate(rows)
        ]
    )
    return V.resumes(spark, sf).select("doc_id", F.inline(changes))


@query(
    "applied_changes",
    with_views(
        "rs je bl",
        """, b AS (SELECT doc_id, list(value ORDER BY j) AS v FROM bl WHERE e = 0 GROUP BY doc_id),
             k AS (SELECT r.doc_id, v, list_reverse(string_split(ls[1], ' ')[2:]) AS its FROM rs r LEFT JOIN b USING (doc_id))
           SELECT doc_id, CASE WHEN v IS NULL THEN NULL ELSE array_to_string(list_concat(list_concat(['TOP', 'LAST'], v[4:]), ['ADDED']), '|') END AS bullets,
             array_to_string(its, '|') AS items, CAST(NULL AS VARCHAR) AS phone,
             array_to_string(list_filter([
               CASE WHEN v IS NULL THEN '0 experience.0.bullets.0 is not a field in your résumé.' END,
               CASE WHEN v IS NULL THEN '1 experience.0.bullets.0 is not a field in your résumé.' END,
               CASE WHEN v IS NULL THEN '2 experience[0].bullets[1] is not a field in your résumé.' WHEN len(v) < 2 THEN '2 experience[0].bullets[1] is not in your résumé.' END,
               CASE WHEN v IS NULL THEN '3 experience[0].bullets[2] is not a field in your résumé.' WHEN len(v) < 3 THEN '3 experience[0].bullets[2] is not in your résumé.' END,
               CASE WHEN v IS NULL THEN '4 Nothing at experience[0].bullets to add to.' END,
               CASE WHEN v IS NULL THEN '5 Nothing at experience[0].bullets[0] to add to.' END,
               '7 That order is not the same items the list holds.', '8 basics.url is not in your résumé.',
               CASE WHEN trim(array_to_string(its, ' · ')) = '' THEN '10 The model gave no order to put that list in.' END],
               lambda x: x IS NOT NULL), '|') AS skipped
           FROM k""",
    ),
)
def applied_changes(spark, sf):
    accepted = _accepted(spark, sf)
    applied = P.apply_changes(V.resumes(spark, sf), accepted, "doc_id")
    told = F.struct("change_no", F.concat_ws(" ", "change_no", "reason").alias("t"))
    skipped = P.skip_report(applied, accepted, "doc_id").groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]), "|").alias("skipped")
    )
    return applied.drop("skipped").join(skipped, "doc_id", "left").select(
        "doc_id", F.array_join(F.get("content.experience", 0)["bullets"], "|").alias("bullets"),
        F.array_join(F.get("content.skills", 0)["items"], "|").alias("items"), F.col("content.basics.phone").alias("phone"),
        "skipped",
    )


@query(
    "tailored_versions",
    """SELECT doc_id + 1000000000 AS version_id, doc_id // 100 AS resume_id, doc_id AS parent_id, 'tailored' AS label FROM documents""",
)
def tailored_versions(spark, sf):
    applied = P.apply_changes(V.resumes(spark, sf), _accepted(spark, sf), "doc_id")
    bases = V.versions(spark, sf).select(F.col("version_id").alias("doc_id"), "resume_id")
    children = P.tailored_versions(applied, bases, "doc_id", F.col("doc_id") + 1_000_000_000, "tailored")
    stored = children.where(F.col("parent_id") < 0)
    return merge.append_versions(stored, children).drop("content")


@query(
    "pinned_tailored",
    with_views(
        "ev apps",
        """SELECT application_id, CASE WHEN application_id % 2 = 0 THEN application_id + 5000000 ELSE version_id END AS version_id,
             CASE WHEN application_id % 2 = 0 AND status = 'sourced' THEN 'tailored' ELSE status END AS status FROM apps""",
    ),
)
def pinned_tailored(spark, sf):
    apps = V.applications(spark, sf).select("application_id", "version_id", "status")
    app = F.col("application_id")
    children = apps.where(app % 2 == 0).select("application_id", (app + 5_000_000).alias("version_id"))
    return P.pin_tailored(apps, children)


# --- reasons, ratings, paragraphs -------------------------------------------


def _reasons(spark, sf):
    doc = F.col("doc_id")
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("reason_no"), F.lit(t).alias("text"), c.cast("array<string>").alias("citations"), F.lit(g).alias("gap"))
            for i, (t, c, g) in enumerate(
                [
                    ("all good ", F.array(F.lit(" basics.name "), F.lit("skills[0].items[0]"), F.lit("experience")), False),
                    ("some lost", F.array(F.lit("basics.url"), F.lit("experience[0].bullets[0]"), F.lit("")), False),
                    ("invented", F.array(F.lit("a.b"), F.lit("c[1]"), F.lit("d"), F.lit("e"), F.lit("f")), False),
                    ("bare", F.array(), False),
                    ("a gap", F.array(), True),
                    ("a wrong gap", F.array(F.lit("x.y")), True),
                    ("  ", F.array(F.lit("basics.name")), False),
                ]
            )
        ]
    )
    return V.table(spark, sf, "labels").select(doc.alias("doc_id"), F.inline(rows))


@query(
    "fit_reasons",
    with_views(
        "rs je bl",
        """, d AS (SELECT doc_id, (SELECT count(*) FROM bl WHERE bl.doc_id = labels.doc_id AND e = 0 AND j = 0) > 0 AS has FROM labels)
           SELECT doc_id, 0 AS reason_no, 'basics.name, skills[0].items[0], experience' AS resolved, '' AS unresolved, NULL AS flag FROM d
           UNION ALL SELECT doc_id, 1, CASE WHEN has THEN 'experience[0].bullets[0]' ELSE '' END, CASE WHEN has THEN 'basics.url' ELSE 'basics.url, experience[0].bullets[0]' END,
             CASE WHEN NOT has THEN 'No source — cited basics.url, experience[0].bullets[0], which your résumé does not have.' END FROM d
           UNION ALL SELECT doc_id, 2, '', 'a.b, c[1], d, e, f', 'No source — cited a.b, c[1], d, +2 more, which your résumé does not have.' FROM d
           UNION ALL SELECT doc_id, 3, '', '', 'No source — nothing in your résumé backs this.' FROM d
           UNION ALL SELECT doc_id, 4, '', '', NULL FROM d
           UNION ALL SELECT doc_id, 5, '', 'x.y', 'No source — cited x.y, which your résumé does not have.' FROM d""",
    ),
)
def fit_reasons(spark, sf):
    checked = P.check_reasons(_reasons(spark, sf), V.resumes(spark, sf), "doc_id", ["doc_id", "reason_no"])
    return checked.select(
        "doc_id", "reason_no", F.array_join("resolved", ", ").alias("resolved"), F.array_join("unresolved", ", ").alias("unresolved"), "flag"
    )


@query(
    "batch_ratings",
    """WITH e AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' STRONG' WHEN 1 THEN 'reach' WHEN 2 THEN '87%' ELSE 'possible' END AS tier, doc_id % 5 = 3 AS bare, doc_id % 7 = 0 AS broken FROM labels)
       SELECT 'doc-' || doc_id AS external_id, trim(lower(tier)) AS tier FROM e WHERE tier <> '87%' AND NOT bare AND NOT broken AND doc_id % 3 <> 0""",
)
def batch_ratings(spark, sf):
    """Two replies per listing; every seventh unreadable, a third of the ids never asked about."""
    doc = F.col("doc_id")
    reason = F.struct(F.lit("fits").alias("text"), F.array(F.lit("basics.name")).alias("citations"), F.lit(False).alias("gap"))
    entry = F.struct(
        F.concat(F.lit(" doc-"), doc.cast("string")).alias("externalId"),
        F.when(doc % 5 == 0, " STRONG").when(doc % 5 == 1, "reach").when(doc % 5 == 2, "87%").otherwise("possible").alias("tier"),
        F.when(doc % 5 != 3, F.array(reason)).otherwise(F.array().cast("array<struct<text:string,citations:array<string>,gap:boolean>>")).alias("reasons"),
    )
    reply = F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(entry).alias("ratings"))), F.lit(" ok"))
    labels = V.table(spark, sf, "labels")
    single = labels.select(F.when(doc % 7 == 0, "no json here").otherwise(reply).alias("reply"))
    replies = single.withColumn("reply_no", F.explode(F.array(F.lit(0), F.lit(1))))
    entries, _ = P.rating_entries(replies, [])
    known = labels.where(doc % 3 != 0).select(F.concat(F.lit("doc-"), doc.cast("string")).alias("external_id"))
    return P.valid_ratings(entries, known, ["external_id"], ["reply_no", "entry_no"]).select("external_id", "tier")


@query(
    "rating_runs",
    """WITH c AS (SELECT doc_id % 14 AS run, doc_id AS chunk_no, doc_id % 7 = 0 OR (doc_id % 14 = 3 AND doc_id % 4 = 1) AS bad FROM labels)
       SELECT run, count(*) AS chunks, count(*) FILTER (bad) AS failed, CASE WHEN bool_and(bad) THEN 'error' WHEN bool_or(bad) THEN 'partial' ELSE 'rated' END AS outcome,
         CASE WHEN bool_and(bad) THEN 'no ratings could be read' END AS error FROM c GROUP BY run""",
)
def rating_runs(spark, sf):
    """Replies to the chunks of fourteen runs; in two of them none can be read, in one only some."""
    doc = F.col("doc_id")
    bad = (doc % 7 == 0) | ((doc % 14 == 3) & (doc % 4 == 1))
    replies = V.table(spark, sf, "labels").select(
        (doc % 14).alias("run"), doc.alias("reply_no"), F.when(bad, "sorry").otherwise('{"ratings": []}').alias("reply")
    )
    return pull_in.rating_runs(P.rating_chunks(replies, ["run"]).withColumnRenamed("reply_no", "chunk_no"), "run")


def _paragraphs(spark, sf):
    doc, c = F.col("doc_id"), F.col("content")
    summary = c["basics"]["summary"]
    first = F.coalesce(F.get(F.get(c["experience"], 0)["bullets"], 0), F.lit(" "))
    rows = F.array(
        F.struct(F.lit(0).alias("para_no"), summary.alias("text"), F.array(F.lit("basics.summary"), F.lit("experience[0].bullets[0]"), F.lit("nope[3]")).alias("citations")),
        F.struct(F.lit(1).alias("para_no"), first.alias("text"), F.array(F.lit("basics.name"), F.lit("job.company"), F.lit("job.jdText")).alias("citations")),
        F.struct(F.lit(2).alias("para_no"), F.lit("plain words").alias("text"), F.array(F.lit("job.salary"), F.lit("skills[0]"), F.lit("a"), F.lit("b")).alias("citations")),
        F.struct(F.lit(3).alias("para_no"), F.concat(F.lit("To "), F.col("content.basics.name")).alias("text"), F.array(F.lit(" basics.name ")).alias("citations")),
    )
    return V.resumes(spark, sf).select("doc_id", (doc % 50).alias("job_id"), F.inline(rows))


_PARAS = f"""
  , pa AS (SELECT doc_id, 0 AS para_no, ls[1] AS text, ['basics.summary', 'experience[0].bullets[0]', 'nope[3]'] AS c FROM b0
     UNION ALL SELECT doc_id, 1, coalesce(b0, ' '), ['basics.name', 'job.company', 'job.jdText'] FROM b0
     UNION ALL SELECT doc_id, 2, 'plain words', ['job.salary', 'skills[0]', 'a', 'b'] FROM b0
     UNION ALL SELECT doc_id, 3, 'To Person ' || doc_id, ['basics.name'] FROM b0),
    x AS (SELECT doc_id, para_no, text, unnest(c) AS cite, generate_subscripts(c, 1) AS n FROM pa WHERE trim(text) <> ''),
    y AS (SELECT x.*, CASE cite WHEN 'job.company' THEN j.company WHEN 'job.jdText' THEN j.title ELSE lv.value END AS field
          FROM x LEFT JOIN lv ON lv.doc_id = x.doc_id AND lv.path = x.cite LEFT JOIN jobs j ON j.job_id = x.doc_id % 50),
    z AS (SELECT *, {_DISTINCTIVE.format(x='field')} AS ft, {_DISTINCTIVE.format(x='text')} AS tt FROM y),
    v AS (SELECT *, coalesce(trim(field), '') <> '' AS isf, coalesce(len(ft) > 0 AND len(list_intersect(ft, tt)) >= least(2, len(ft)), false) AS dr FROM z),
    sn AS (SELECT *, trim(regexp_replace(field, '\\s+', ' ', 'g')) AS flat FROM v),
    g AS (SELECT doc_id, para_no, string_agg(cite || CASE WHEN starts_with(cite, 'job.') THEN ' job ' ELSE ' resume ' END
            || CASE WHEN length(flat) > 220 THEN left(flat, 219) || '…' ELSE flat END, '|' ORDER BY n) FILTER (WHERE isf AND dr) AS sources,
          list(cite ORDER BY n) FILTER (WHERE isf AND dr) AS backed, list(cite ORDER BY n) FILTER (WHERE NOT isf) AS unres, list(cite ORDER BY n) FILTER (WHERE isf AND NOT dr) AS unsup
          FROM sn GROUP BY ALL)"""


def _first_three(x: str) -> str:
    return f"array_to_string({x}[1:3], ', ') || CASE WHEN len({x}) > 3 THEN ', +' || (len({x}) - 3) || ' more' ELSE '' END"


@query(
    "paragraph_provenance",
    with_views(
        "rs je bl lv b0 jobs",
        f"""{_PARAS} SELECT doc_id, para_no, coalesce(array_to_string(backed, ', '), '') AS backed, coalesce(sources, '') AS sources,
              CASE WHEN backed IS NOT NULL THEN NULL WHEN unres IS NOT NULL THEN 'No source — cited ' || {_first_three('unres')} || ', which your résumé does not have.'
                WHEN unsup IS NOT NULL THEN 'No source — cited ' || {_first_three('unsup')} || ', which says nothing this paragraph rests on.'
                ELSE 'No source — nothing in your résumé or the posting backs this paragraph.' END AS flag FROM g""",
    ),
)
def paragraph_provenance(spark, sf):
    jobs = V.jobs(spark, sf).select("job_id", "title", "company", F.col("title").alias("jd_text"))
    checked = P.check_paragraphs(_paragraphs(spark, sf), V.resumes(spark, sf), "doc_id", jobs, ["doc_id", "para_no"])
    told = F.transform("sources", lambda c: F.concat_ws(" ", c["path"], c["source"], c["snippet"]))
    return checked.select("doc_id", "para_no", F.array_join("backed", ", ").alias("backed"), F.array_join(told, "|").alias("sources"), "flag")


@query(
    "draft_citations",
    with_views(
        "rs je bl lv b0",
        """SELECT doc_id, 'basics.summary' AS path, value AS snippet FROM lv WHERE path = 'basics.summary'
           UNION ALL SELECT doc_id, 'basics.summary', ls[1] FROM rs WHERE trim(ls[1]) = ''
           UNION ALL SELECT doc_id, 'skills[0].items', NULL FROM rs
           UNION ALL SELECT doc_id, 'experience[0].bullets[0]', b0 FROM b0 WHERE b0 IS NOT NULL""",
    ),
)
def draft_citations(spark, sf):
    drafts = V.table(spark, sf, "documents").select(
        "doc_id",
        F.array(*[F.lit(p) for p in ("basics.summary", "skills[0].items", " basics.summary", "experience[0].bullets[0]", "ghost", "")]).alias("citations"),
    ).withColumn("draft_id", F.col("doc_id"))
    return P.draft_citations(drafts, V.resumes(spark, sf), "doc_id", ["draft_id"]).select("doc_id", "path", "snippet")
