"""Layout queries over glyph and line tables derived from document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testviews as V
from ..operators import layout, pages as Y
from .registry import VIEWS, query, with_views

# --- glyphs -----------------------------------------------------------------
# Words of a document set eight to a row in two columns, fifty rows to a page; every tenth row has one
# run across the gutter, every seventh hangs from a bullet. Heights within a row drift by 0.6 up to
# 3.6 points and the next row begins at 5, so only the distance from a row's first run tells rows apart.

VIEWS["gl0"] = """
  SELECT doc_id, r // 50 AS page, CAST(5.0 * r + 0.6 * ((doc_id + 3 * r + c) % 7) AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x,
    CAST(CASE WHEN r % 10 = 0 AND c = 3 THEN x + 200.0 ELSE x + least(55.0, 5.0 * length(w)) END AS DOUBLE) AS right_,
    CASE WHEN r % 7 = 3 AND c % 4 = 0 THEN '•' WHEN r % 7 = 5 AND c = 0 THEN '- ' || w ELSE w END AS w,
    CAST(CASE WHEN c = 0 THEN 12.0 ELSE 10.0 END AS DOUBLE) AS size, CASE WHEN c < 2 THEN 'Bold' ELSE 'Text' END AS font
  FROM (SELECT *, i // 8 AS r, i % 8 AS c, 40.0 + 60.0 * (i % 8) + CASE WHEN i % 8 >= 4 THEN 40.0 ELSE 0.0 END AS x
        FROM (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w
              FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents)))"""
# The first run of each row, carried along the heights of a page.
VIEWS["gl"] = """
  SELECT g.*, h.ry FROM gl0 g JOIN (
    SELECT doc_id, page, unnest(ys) AS y, unnest(list_reduce(ys, lambda a, y: CASE WHEN y - a.first <= 2.5
        THEN {'first': a.first, 'out': list_append(a.out, a.first)} ELSE {'first': y, 'out': list_append(a.out, y)} END,
        {'first': ys[1], 'out': CAST([] AS DOUBLE[])}).out) AS ry
    FROM (SELECT doc_id, page, list(DISTINCT y ORDER BY y) AS ys FROM gl0 GROUP BY ALL)) h USING (doc_id, page, y)"""


def glyphs(spark, sf):
    words = V.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).alias("i", "w")
    )
    placed = words.select("doc_id", "w", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c")).withColumn(
        "x", F.lit(40.0) + 60.0 * F.col("c") + F.when(F.col("c") >= 4, 40.0).otherwise(0.0)
    )
    r, c = F.col("r"), F.col("c")
    width = F.when((r % 10 == 0) & (c == 3), 200.0).otherwise(F.least(F.lit(55.0), 5.0 * F.length("w")))
    text = F.when((r % 7 == 3) & (c % 4 == 0), "•").when((r % 7 == 5) & (c == 0), F.concat(F.lit("- "), F.col("w"))).otherwise(F.col("w"))
    drift = F.lit(0.6).cast("decimal(2,1)") * ((F.col("doc_id") + 3 * r + c) % 7).cast("int")
    return placed.select(
        "doc_id", F.floor(r / 50).cast("int").alias("page"), "x", (F.lit(5).cast("decimal(2,1)") * r.cast("int") + drift).cast("double").alias("y"),
        (F.col("x") + width).alias("right"), text.alias("str"), F.when(c == 0, 12.0).otherwise(10.0).alias("size"),
        F.when(c < 2, "Bold").otherwise("Text").alias("font"),
    )


@query("text_rows", with_views("gl0 gl", "SELECT doc_id, page, ry AS row_y, count(*) AS runs FROM gl GROUP BY ALL"))
def text_rows(spark, sf):
    return Y.baseline_rows(glyphs(spark, sf)).groupBy("doc_id", "page", "row_y").agg(F.count(F.lit(1)).alias("runs"))


VIEWS["gut"] = """
  SELECT ex.doc_id, ex.page, ex.lft + (b.s + b.t) / 2.0 AS gutter FROM ex LEFT JOIN (
    SELECT doc_id, page, max_by(s, (t - s, -s)) AS s, max_by(t, (t - s, -s)) AS t FROM (
      SELECT doc_id, page, min(cell) AS s, least(max(cell) + 1, to_) AS t FROM (
        SELECT *, cell - row_number() OVER (PARTITION BY doc_id, page ORDER BY cell) AS isl FROM (
          SELECT m.*, (SELECT count(*) FROM gl g WHERE g.doc_id = m.doc_id AND g.page = m.page
              AND m.cell BETWEEN greatest(0, floor(g.x - m.lft)) AND least(ceil(m.span), ceil(g.right_ - m.lft))) AS n
          FROM (SELECT *, CAST(ceil(span * 0.8) AS INT) AS to_, unnest(range(CAST(floor(span * 0.2) AS INT), CAST(ceil(span * 0.8) AS INT) + 1)) AS cell
                FROM ex WHERE nrows >= 6 AND span >= 56) m)
        WHERE n <= nrows * 0.12)
      GROUP BY doc_id, page, to_, isl) WHERE t - s >= 14 GROUP BY doc_id, page) b USING (doc_id, page)"""
VIEWS["ex"] = "SELECT doc_id, page, min(x) AS lft, max(right_) - min(x) AS span, count(DISTINCT ry) AS nrows FROM gl GROUP BY ALL"


@query("page_gutters", with_views("gl0 gl ex gut", "SELECT doc_id, page, gutter FROM gut"))
def page_gutters(spark, sf):
    return Y.gutters(glyphs(spark, sf))


@query(
    "page_lines",
    with_views(
        "gl0 gl ex gut",
        """, fu AS (SELECT doc_id, page, ry, bool_or(coalesce(x < gutter AND right_ > gutter, false)) AS f FROM gl JOIN gut USING (doc_id, page) GROUP BY ALL),
           ba AS (SELECT *, CAST(coalesce(sum(CAST(f AS INT)) OVER (PARTITION BY doc_id, page ORDER BY ry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS band FROM fu),
           si AS (SELECT *, CASE WHEN gutter IS NULL THEN 0 WHEN f THEN 2 WHEN right_ <= gutter THEN 0 ELSE 1 END AS side
                  FROM gl JOIN gut USING (doc_id, page) JOIN ba USING (doc_id, page, ry)),
           nu AS (SELECT *, lag(right_) OVER l AS pr, row_number() OVER l AS k, count(*) OVER (PARTITION BY doc_id, page, ry, side) AS kn,
                    first_value(w) OVER l IN ('•', '‣', '▪', '●', '◦', '⁃', '∙', '*', '·') AS hang
                  FROM si WINDOW l AS (PARTITION BY doc_id, page, ry, side ORDER BY x, y, right_, w, size, font)),
           ink AS (SELECT * FROM nu WHERE NOT (hang AND kn > 1 AND k = 1)),
           fo AS (SELECT doc_id, page, ry, side, max_by(font, (n, -k)) AS font_name FROM (
                    SELECT doc_id, page, ry, side, font, sum(length(w)) AS n, min(k) AS k FROM ink GROUP BY ALL) GROUP BY ALL),
           tx AS (SELECT doc_id, page, band, side, ry, bool_or(hang) AS hang, min_by(y, k) AS y, min(x) AS x, max(right_) AS r, max(size) AS z,
                    string_agg(CASE WHEN k = CASE WHEN hang AND kn > 1 THEN 2 ELSE 1 END OR x - pr <= 1.2 THEN w ELSE ' ' || w END, '' ORDER BY k) AS t
                  FROM ink GROUP BY ALL),
           st AS (SELECT *, regexp_replace(t, '^[•‣▪●◦⁃∙*·]\\s*|^[-–—]\\s+', '') AS s FROM tx)
           SELECT doc_id, page, band, side, ry AS row_y, trim(s) AS text, y, x, r AS "right", z AS font_size, font_name, hang OR s <> t AS is_list_item
           FROM st JOIN fo USING (doc_id, page, ry, side)""",
    ),
)
def page_lines(spark, sf):
    return Y.page_lines(glyphs(spark, sf))


# --- lines ------------------------------------------------------------------
# Document lines with headings, dated lines, bullets and wrapped lines worked in.

VIEWS["ln"] = """
  SELECT doc_id, idx AS line_no, CAST(idx // 60 AS INT) AS page,
    CASE idx % 16 WHEN 0 THEN 'Work Experience:' WHEN 7 THEN 'Awards' WHEN 10 THEN 'SKILLS' WHEN 2 THEN 'Role ' || idx || ', Jan 2019 – Present'
      WHEN 4 THEN 'Other role 2015 - 2018' WHEN 9 THEN line || '-' ELSE line END AS text,
    CASE WHEN idx % 16 IN (0, 7, 10) THEN 40.0 WHEN idx % 5 = 3 THEN 52.0 WHEN idx % 11 = 6 THEN 140.0 ELSE 44.0 END AS x,
    CASE WHEN idx % 16 IN (0, 7, 10) THEN 14.0 WHEN idx % 13 = 12 THEN 11.0 ELSE 10.0 END AS font_size,
    CASE WHEN idx % 16 IN (0, 7, 10) THEN 'Bold' ELSE 'Text' END AS font_name,
    idx % 16 NOT IN (0, 7, 10) AND idx % 5 = 3 AS is_list_item
  FROM segs"""


def lines(spark, sf):
    i = F.col("idx")
    m = i % 16
    heading = m.isin(0, 7, 10)
    text = (
        F.when(m == 0, "Work Experience:").when(m == 7, "Awards").when(m == 10, "SKILLS")
        .when(m == 2, F.concat(F.lit("Role "), i.cast("string"), F.lit(", Jan 2019 – Present")))
        .when(m == 4, "Other role 2015 - 2018").when(m == 9, F.concat(F.col("line"), F.lit("-"))).otherwise(F.col("line"))
    )
    return V.lines(spark, sf).select(
        "doc_id", i.alias("line_no"), F.floor(i / 60).cast("int").alias("page"), text.alias("text"),
        F.when(heading, 40.0).when(i % 5 == 3, 52.0).when(i % 11 == 6, 140.0).otherwise(44.0).alias("x"),
        F.when(heading, 14.0).when(i % 13 == 12, 11.0).otherwise(10.0).alias("font_size"),
        F.when(heading, "Bold").otherwise("Text").alias("font_name"),
        (~heading & (i % 5 == 3)).alias("is_list_item"),
    )


# A one- or two-line document may have "Bold" as its commonest style; then there are no learned styles.
VIEWS["sec"] = """
  SELECT *, CASE WHEN line_no % 16 = 0 THEN 'experience' WHEN line_no % 16 = 10 THEN 'skills' WHEN line_no % 16 = 7 THEN 'custom' END AS own FROM ln"""


@query(
    "page_sections",
    with_views(
        "segs ln sec",
        """SELECT doc_id, line_no, CAST(count(own) OVER w AS BIGINT) AS section_no, last_value(own IGNORE NULLS) OVER w AS kind,
             last_value(CASE WHEN own IS NOT NULL THEN text END IGNORE NULLS) OVER w AS title, own IS NOT NULL AS is_heading
           FROM sec WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""",
    ),
)
def page_sections(spark, sf):
    return layout.sections(lines(spark, sf)).select("doc_id", "line_no", "section_no", "kind", "title", "is_heading")


@query(
    "heading_styles",
    with_views(
        "segs ln sec",
        """, st AS (SELECT doc_id, font_name || '@' || font_size AS style, count(*) AS n, min(line_no) AS first,
                 count(*) FILTER (WHERE own IN ('experience', 'skills')) AS headings FROM sec GROUP BY ALL),
           co AS (SELECT doc_id, max_by(style, (n, -first)) AS common FROM st GROUP BY doc_id)
           SELECT doc_id, coalesce(string_agg(style, ',' ORDER BY style) FILTER (WHERE headings > 0 AND style <> common), '') AS styles
           FROM st JOIN co USING (doc_id) GROUP BY doc_id""",
    ),
)
def heading_styles(spark, sf):
    return layout.heading_styles(lines(spark, sf)).select("doc_id", F.array_join(F.array_sort("styles"), ",").alias("styles"))


@query(
    "entry_chunks",
    """WITH RECURSIVE """ + f"""segs AS ({VIEWS['segs']}), ln AS ({VIEWS['ln']}),
       sq AS (SELECT doc_id, line_no, is_list_item AS li, NOT is_list_item AND (line_no % 16 IN (2, 4)) AS dated FROM ln),
       wk AS (
         SELECT doc_id, line_no, CASE WHEN li THEN 0 ELSE 1 END AS chunk, li AS saw_item, dated AS saw_date FROM sq WHERE line_no = 0
         UNION ALL
         SELECT s.doc_id, s.line_no, CASE WHEN NOT s.li AND (wk.saw_item OR (s.dated AND wk.saw_date)) THEN wk.chunk + 1 ELSE wk.chunk END,
           CASE WHEN NOT s.li AND (wk.saw_item OR (s.dated AND wk.saw_date)) THEN false ELSE wk.saw_item OR s.li END,
           CASE WHEN NOT s.li AND (wk.saw_item OR (s.dated AND wk.saw_date)) THEN s.dated ELSE wk.saw_date OR s.dated END
         FROM wk JOIN sq s ON s.doc_id = wk.doc_id AND s.line_no = wk.line_no + 1)
       SELECT doc_id, line_no, CAST(chunk AS BIGINT) AS chunk FROM wk""",
)
def entry_chunks(spark, sf):
    return layout.entry_chunks(lines(spark, sf), ["doc_id"]).select("doc_id", "line_no", "chunk")


@query(
    "rejoined_bullets",
    with_views(
        "segs ln",
        r""", a AS (SELECT *, sum(CAST(is_list_item AS INT)) OVER w AS an,
               last_value(CASE WHEN is_list_item THEN {'p': page, 'x': x, 's': font_size} END IGNORE NULLS) OVER w AS l
             FROM ln WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
           s AS (SELECT *, sum(CASE WHEN is_list_item THEN 0 WHEN l IS NOT NULL AND page = l.p AND x - l.x BETWEEN -2 AND 24 AND abs(font_size - l.s) <= 0.5
                   AND line_no % 16 NOT IN (0, 2, 4, 10) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, an ORDER BY line_no) AS stops FROM a)
           SELECT doc_id, line_no, text FROM s WHERE NOT (an > 0 AND stops = 0)
           UNION ALL SELECT doc_id, min(line_no), replace(regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' ') FROM s WHERE an > 0 AND stops = 0 GROUP BY doc_id, an""",
    ),
)
def rejoined_bullets(spark, sf):
    return layout.rejoin_wrapped(lines(spark, sf)).select("doc_id", "line_no", "text")
