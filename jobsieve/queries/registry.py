"""The query registry and the SQL views both engines agree on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def iso(column: str | Column) -> Column:
    """Timestamps as text, so both engines print them alike."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


# Views worth computing once.
_ONCE = {"hay", "lv", "terms", "covered"}

# SQL views, by name. A view may use the ones above it.
VIEWS: dict[str, str] = {}


def with_views(names: str, select: str) -> str:
    """``select`` with the named views in front of it."""
    parts = [f"{n} AS {'MATERIALIZED ' if n in _ONCE else ''}({VIEWS[n]})" for n in names.split()]
    recursive = "RECURSIVE " if any("UNION ALL" in VIEWS[n] and f"FROM {n}" in VIEWS[n] for n in names.split()) else ""
    return f"WITH {recursive}" + ", ".join(parts) + " " + select


VIEWS["ev"] = """
  SELECT user_id * 100 + CAST(floor(day(ts) / 3) AS BIGINT) AS application_id, event_id AS seq, ts AS event_at,
    CASE event_type
      WHEN 'view' THEN 'sourced'
      WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'tailored' ELSE 'applied' END
      WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'outreach' ELSE 'replied' END
      WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'interview' ELSE 'offer' END
      WHEN 'error' THEN 'rejected' END AS status
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events)"""

VIEWS["apps"] = """
  SELECT application_id, max_by(status, (event_at, seq)) AS status,
    min(CASE WHEN status = 'applied' THEN event_at END) AS applied_at,
    min(CASE WHEN status = 'replied' THEN event_at END) AS replied_at,
    min(CASE WHEN status = 'interview' THEN event_at END) AS interview_at,
    min(CASE WHEN status = 'offer' THEN event_at END) AS offered_at,
    min(CASE WHEN status IN ('offer', 'rejected') THEN event_at END) AS decided_at,
    min(event_at) AS created_at, max(event_at) AS updated_at,
    application_id % (SELECT count(*) FROM pages) AS job_id,
    CASE application_id % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'possible' WHEN 2 THEN 'reach' END AS fit_tier,
    CASE WHEN application_id % 5 <> 0 THEN application_id % (SELECT count(*) FROM documents) END AS version_id,
    CASE application_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'paste' ELSE 'manual' END AS source
  FROM ev GROUP BY application_id"""

VIEWS["jobs"] = r"""
  SELECT page_id AS job_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS company,
    CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'City ' || (page_id % 7) END AS location
  FROM pages"""

VIEWS["steps"] = """
  SELECT l_orderkey AS application_id,
    CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey END AS contact_id,
    l_linenumber AS sequence_step, o_orderdate AS created_at, CAST(l_quantity AS INT) % 7 AS day_offset,
    CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS sent_at,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND l_linestatus = 'F' THEN 'replied'
         WHEN l_linestatus = 'F' THEN 'sent' ELSE 'scheduled' END AS status,
    l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["contacts"] = """
  SELECT o_orderkey AS application_id, o_custkey AS contact_id, c_name AS name,
    CASE WHEN c_custkey % 5 = 0 THEN NULL
         WHEN o_orderkey % 2 = 0 THEN upper('c' || c_custkey || '@mail.example')
         ELSE 'c' || c_custkey || '@mail.example' END AS email,
    o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey"""

VIEWS["outreach_jobs"] = """
  SELECT o_orderkey AS application_id, n_name AS company, o_orderpriority AS title
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey % 10 <> 0"""

VIEWS["listings"] = """
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'doc-' || (doc_id - doc_id % 9) ELSE 'doc-' || doc_id END AS external_id,
    'Role ' || (doc_id // 5) AS title, lang AS company, source AS location,
    CASE WHEN doc_id % 7 = 0 THEN NULL
         ELSE 'https://www.Jobs.example.com/p/' || (doc_id - doc_id % 5) || '/?utm_source=' || source || '&id=1' END AS url,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS description,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 37) END AS posted_at,
    doc_id % 3 = 0 AS remote, source,
    CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS adapter_rank, doc_id AS pos,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'strong' WHEN quality = 1 THEN 'possible' WHEN quality = 0 THEN 'reach' END AS tier
  FROM documents LEFT JOIN labels USING (doc_id)"""

VIEWS["searches"] = r"""
  SELECT item_id * 100 + i AS query_id, CASE WHEN i = 0 AND item_id % 11 = 7 THEN ' ' WHEN i % 2 = 1 THEN '  ' || upper(left(x, 2)) || substr(x, 3) ELSE x END AS keywords,
    CASE WHEN item_id % 3 = 0 OR (i = 0 AND item_id % 11 = 7) THEN 'SRC1' END AS location, item_id % 4 = 0 AS remote_only
  FROM (SELECT item_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS i
        FROM (SELECT item_id, list_concat([text], string_split_regex(text, '[.!?,\n]')) AS xs FROM benchmark)) WHERE i = 0 OR trim(x) <> ''"""

VIEWS["hits"] = """
  SELECT query_id, l.* FROM searches s JOIN listings l
    ON contains(lower(concat_ws(' ', l.title, l.company, coalesce(l.description, ''))), trim(lower(s.keywords)))
   AND (s.location IS NULL OR contains(lower(l.location), lower(s.location)))
   AND (NOT s.remote_only OR l.remote)"""

VIEWS["segs"] = r"""
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS line
  FROM documents"""

# Text with the phrases the checks look for worked into it.
VIEWS["prose"] = """
  SELECT doc_id, replace(replace(replace(replace(text, ' the ', ' experience with '), ' and ', ' results-driven Kafka '),
    ' that ', ' Machine  learning, '), ' for ', ' leveraging CI/CD ') AS text
  FROM documents"""

VIEWS["turns"] = """
  SELECT conv_id, a.turn AS turn, a.text AS was, b.text AS now
  FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn = a.turn + 2"""

VIEWS["versions"] = """
  SELECT doc_id AS version_id, CASE WHEN doc_id % 100 = 0 THEN NULL ELSE (doc_id // 100) * 100 + (doc_id % 100) // 2 END AS parent_id,
    doc_id // 100 AS resume_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id * 13) % 29) AS created_at,
    lang || '-' || doc_id AS label
  FROM documents"""

# --- documents as resumes ---------------------------------------------------

_MONTHS = "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])"


def _month(year: str, month: str, shape: str) -> str:
    return (
        f"CASE {shape} WHEN 0 THEN ({year}) || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') "
        f"WHEN 1 THEN {_MONTHS}[CAST({month} AS INT)] || ' ' || ({year}) "
        f"ELSE lpad(CAST({month} AS VARCHAR), 2, '0') || '/' || ({year}) END"
    )


VIEWS["rs"] = "SELECT doc_id, lang, source, text, string_split(text, chr(10)) AS ls FROM documents"

VIEWS["je"] = f"""
  SELECT doc_id, ls, e, 'Company ' || ((doc_id + e) % 13) AS company, 'Role ' || (e % 3) AS title,
    {_month('2008 + (doc_id + e) % 12', '1 + (doc_id + 3 * e) % 12', '(CASE WHEN doc_id % 5 = 0 THEN e % 3 ELSE 0 END)')} AS start_,
    CASE WHEN e = 0 AND doc_id % 3 = 0 THEN NULL WHEN e = 0 AND doc_id % 7 = 1 THEN 'Present'
      ELSE {_month('2009 + (doc_id + e) % 12', '1 + (doc_id + 3 * e) % 12', '(CASE WHEN doc_id % 5 = 0 THEN e % 3 ELSE 0 END)')} END AS end_,
    (2009 + (doc_id + e) % 12) * 12 + (doc_id + 3 * e) % 12 AS end_m
  FROM (SELECT *, unnest(range(0, CAST(ceil((len(ls) - 1) / 4.0) AS INT))) AS e FROM rs)"""

VIEWS["bl"] = """
  SELECT doc_id, e, j, 'experience[' || e || '].bullets[' || j || ']' AS path,
    CASE WHEN (doc_id + j) % 9 = 0 THEN 'My ' || b WHEN (doc_id + j) % 9 = 1 THEN replace(b, ' the ', ' seamlessly leveraged ') ELSE b END AS value
  FROM (SELECT doc_id, e, generate_subscripts(ls[2 + 4 * e : 5 + 4 * e], 1) - 1 AS j, unnest(ls[2 + 4 * e : 5 + 4 * e]) AS b FROM je)"""

VIEWS["lv"] = r"""
  SELECT * FROM (
    SELECT doc_id, 'basics' AS section, 0 AS entry, key, NULL AS item, 'basics.' || key AS path, value
    FROM (SELECT doc_id, unnest([{'key': 'name', 'value': 'Person ' || doc_id}, {'key': 'label', 'value': source},
            {'key': 'email', 'value': 'p' || doc_id || '@example.com'}, {'key': 'phone', 'value': '+1 555 0100'},
            {'key': 'location', 'value': lang}, {'key': 'summary', 'value': ls[1]}], recursive := true) FROM rs)
    UNION ALL SELECT doc_id, 'experience', e, key, NULL, 'experience[' || e || '].' || key, value
    FROM (SELECT doc_id, e, unnest([{'key': 'company', 'value': company}, {'key': 'title', 'value': title},
            {'key': 'start', 'value': start_}, {'key': 'end', 'value': end_}], recursive := true) FROM je)
    UNION ALL SELECT doc_id, 'experience', e, 'bullets', j, path, value FROM bl
    UNION ALL SELECT doc_id, 'education', 0, key, NULL, 'education[0].' || key, value
    FROM (SELECT doc_id, unnest([{'key': 'institution', 'value': 'School ' || (doc_id % 7)}, {'key': 'degree', 'value': CASE WHEN doc_id % 2 = 1 THEN 'BSc' END},
            {'key': 'start', 'value': '2001'}, {'key': 'end', 'value': CASE WHEN doc_id % 3 = 0 THEN 'June 2005' ELSE '2005-06' END}], recursive := true) FROM rs)
    UNION ALL SELECT doc_id, 'skills', 0, 'category', NULL, 'skills[0].category', 'Words' FROM rs
    UNION ALL SELECT doc_id, 'skills', 0, 'items', j, 'skills[0].items[' || j || ']', v
    FROM (SELECT doc_id, generate_subscripts(string_split(ls[1], ' '), 1) - 1 AS j, unnest(string_split(ls[1], ' ')) AS v FROM rs)
    UNION ALL SELECT doc_id, 'projects', 0, 'name', NULL, 'projects[0].name', 'Project ' || (doc_id % 5) FROM rs
    UNION ALL SELECT doc_id, 'projects', 0, 'description', NULL, 'projects[0].description', ls[len(ls)] FROM rs WHERE len(ls) > 1
    UNION ALL SELECT doc_id, 'custom', 0, 'title', NULL, 'custom[0].title', 'Notes' FROM rs WHERE doc_id % 10 = 0)
  WHERE trim(value) <> ''"""


def fold_sql(x: str) -> str:
    """Folded tokens of a text, joined by a space."""
    return (
        f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> ''), "
        "lambda t: CASE WHEN length(t) > 3 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' "
        "WHEN length(t) > 4 AND regexp_matches(t, '(?:ses|xes|zes|ches|shes)$') THEN left(t, length(t) - 2) "
        "WHEN length(t) > 2 AND t LIKE '%s' AND NOT regexp_matches(t, '(?:ss|us|is)$') THEN left(t, length(t) - 1) ELSE t END), ' ')"
    )


def plain_sql(x: str, extra: str = "") -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[‘’{extra}]', '''', 'g'), "
        "'[“”]', '\"', 'g'), '[‐-―]', '-', 'g'), '\\s+', ' ', 'g')))"
    )


# --- what a posting asks for ------------------------------------------------

_T = r"[A-Za-z][A-Za-z0-9+#]*(?:[./][A-Za-z0-9+#]+)*"
_TRIG = (
    r"(?i)\b(?:experience|expertise|proficiency|proficient|familiarity|familiar|knowledge|background|skilled|fluent)"
    r"\s+(?:with|in|of|using|across)\b"
)
_CLAUSE = r"(?i)[,;:.!?()]|\s(?:and|or|plus|to|for|at|is|as)\s"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _phrase_rows() -> str:
    from .. import vocab

    out = []
    for p in vocab.KNOWN_SKILL_PHRASES:
        words = "".join(c if c.isalnum() else " " for c in p).split()
        out.append("('" + r"[\s-]+".join(words) + "')")
    return "(VALUES " + ", ".join(out) + ") AS ph(rx)"


def _term_views() -> None:
    from .. import vocab

    stop = _list(vocab.TERM_STOPWORDS)
    common = _list(tuple(dict.fromkeys(vocab.TERM_STOPWORDS + vocab.COMMON_CAPITALISED)))
    VIEWS["pl"] = """
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM prose"""
    VIEWS["tech"] = f"""
      SELECT doc_id, line_no, i - 1 AS ord, 2 AS rank, t AS term
      FROM (SELECT doc_id, line_no, generate_subscripts(toks, 1) AS i, unnest(toks) AS t, gaps
            FROM (SELECT doc_id, line_no, regexp_extract_all(line, '{_T}') AS toks, regexp_split_to_array(line, '{_T}') AS gaps FROM pl))
      WHERE NOT list_contains({common}, lower(t))
        AND (list_contains({_list(vocab.KNOWN_TECH)}, lower(t)) OR regexp_matches(substr(t, 2), '[A-Z]') OR regexp_matches(t, '[0-9+#./]')
          OR (length(t) BETWEEN 2 AND 6 AND t = upper(t))
          OR (regexp_matches(t, '^[A-Z][a-z]') AND NOT (i = 1 OR regexp_matches(gaps[i], '[.!?;:•\\-–—()\\[\\]]'))))"""
    VIEWS["known"] = f"""
      SELECT doc_id, line_no, len(regexp_extract_all(regexp_extract(line, '(?is)^(.*?)\\b' || rx || '\\b', 1), '{_T}')) AS ord, 1 AS rank,
        regexp_extract(line, '(?i)\\b' || rx || '\\b') AS term
      FROM pl, {_phrase_rows()} WHERE regexp_matches(line, '(?i)\\b' || rx || '\\b')"""
    VIEWS["wanted"] = f"""
      SELECT doc_id, line_no, len(regexp_extract_all(head, '{_T}')) AS ord, 0 AS rank,
        regexp_replace(array_to_string(CASE WHEN k IS NULL THEN [] ELSE words[k : k + 2] END, ' '), '[^A-Za-z0-9+#./\\s-]+$', '') AS term
      FROM (SELECT *, list_position(list_transform(words, lambda w: list_contains({stop}, regexp_replace(lower(w), '[^a-z0-9]', '', 'g'))), false) AS k
            FROM (SELECT *, list_filter(regexp_split_to_array(regexp_split_to_array(substr(line, length(head) + 1), '{_CLAUSE}')[1], '\\s+'), lambda w: w <> '') AS words
                  FROM (SELECT *, array_to_string(list_transform(range(1, i + 1), lambda x: pieces[x] || trigs[x]), '') AS head
                        FROM (SELECT *, unnest(range(1, len(trigs) + 1)) AS i
                              FROM (SELECT *, regexp_extract_all(line, '{_TRIG}') AS trigs, regexp_split_to_array(line, '{_TRIG}') AS pieces FROM pl)))))"""
    VIEWS["terms"] = f"""
      SELECT doc_id, term_key, min_by(term, (line_no, ord, rank)) AS term, min((line_no, ord, rank)) AS at_
      FROM (SELECT *, {fold_sql('term')} AS term_key FROM (
              SELECT doc_id, line_no, ord, rank, regexp_replace(trim(term), '\\s+', ' ', 'g') AS term
              FROM (SELECT * FROM tech UNION ALL SELECT * FROM known UNION ALL SELECT * FROM wanted)))
      WHERE term_key <> '' AND regexp_matches(term, '[A-Za-z]')
        AND len(list_filter(regexp_split_to_array(lower(term), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({stop}, t))) > 0
      GROUP BY doc_id, term_key"""


_term_views()
