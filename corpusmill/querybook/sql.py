"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

from corpusmill.functions.base import WHITESPACE
from corpusmill.functions.split import SEPARATORS


def chars(text: str) -> str:
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in text) + ")"


def strip(expr: str) -> str:
    return f"trim({expr}, {chars(WHITESPACE)})"


def clean(expr: str) -> str:
    one = rf"regexp_replace(replace(coalesce({expr}, ''), chr(160), ' '), '[ \t]+', ' ', 'g')"
    two = rf"regexp_replace({one}, '\n[ \t]+', chr(10), 'g')"
    return strip(rf"regexp_replace({two}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def norm(expr: str) -> str:
    return strip(f"replace(replace(lower(coalesce({expr}, '')), '-', ' '), '_', ' ')")


def tokens(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({expr}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def md5_number(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def _quote(text: str) -> str:
    return chars(text)


def chunks(source: str, size: int = 1000, overlap: int = 200) -> str:
    """CTEs that end in ``chunked``: the columns of ``source`` (document_id, page_number, ..., text) per chunk.

    ``source`` is a table or sub-query with document_id, page_number and text.
    """
    ctes = [f"c0 AS (SELECT *, [{{'t': text, 'lg': true, 'op': true}}] AS a FROM {source} WHERE text <> '')"]
    for i, sep in enumerate(SEPARATORS):
        s = _quote(sep)
        parts = f"list_filter(list_transform(string_split(x.t, {s}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {s} || p END), lambda p: p <> '')"
        label = (
            f"list_transform([{parts}], lambda ps: list_transform(ps, lambda p, i: {{'t': p, 'lg': length(p) >= {size}, "
            f"'op': i = 1 OR length(p) >= {size} OR length(ps[i - 1]) >= {size}}}))[1]"
        )
        ctes.append(
            f"c{i + 1} AS (SELECT * REPLACE (flatten(list_transform(a, lambda x: CASE WHEN x.lg THEN {label} ELSE [x] END)) AS a) FROM c{i})"
        )
    n = len(SEPARATORS)
    stride = size - overlap
    hard = (
        f"flatten(list_transform(a, lambda x: CASE WHEN x.lg THEN list_transform(range(0, greatest(1, "
        f"ceil((length(x.t) - {overlap}) / {stride}.0)::BIGINT)), lambda w: {{'t': substr(x.t, 1 + w * {stride}, {size}), "
        f"'lg': false, 'op': true}}) ELSE [x] END))"
    )
    ctes.append(f"hard AS (SELECT * REPLACE ({hard} AS a) FROM c{n})")
    ctes.append(
        "states AS (SELECT * EXCLUDE (a), list_transform(a, lambda x: {'d': []::VARCHAR[], 'c': [x.t], 'n': length(x.t), 'op': x.op}) AS s FROM hard)"
    )
    kept = (
        f"list_max(list_filter(range(0, len(st.c) + 1), lambda j: coalesce(list_sum(list_transform(st.c[len(st.c) - j + 1:], "
        f"lambda q: length(q))), 0) <= least({overlap}, {size} - x.n)))"
    )
    closed = "list_append(st.d, array_to_string(st.c, ''))"
    carry = (
        f"list_transform([CASE WHEN {kept} = 0 THEN []::VARCHAR[] ELSE st.c[len(st.c) - {kept} + 1:] END], lambda kp: "
        f"{{'d': {closed}, 'c': list_concat(kp, x.c), 'n': length(array_to_string(kp, '')) + x.n, 'op': true}})[1]"
    )
    fold = (
        f"list_reduce(s, lambda st, x: CASE WHEN x.op THEN {{'d': {closed}, 'c': x.c, 'n': x.n, 'op': true}} "
        f"WHEN st.n + x.n > {size} THEN {carry} "
        f"ELSE {{'d': st.d, 'c': list_concat(st.c, x.c), 'n': st.n + x.n, 'op': true}} END, "
        f"{{'d': []::VARCHAR[], 'c': []::VARCHAR[], 'n': 0::BIGINT, 'op': true}})"
    )
    ctes.append(f"packed AS (SELECT * EXCLUDE (s), {fold} AS r FROM states)")
    ctes.append(
        f"lists AS (SELECT * EXCLUDE (r), list_filter(list_transform(list_append(r.d, array_to_string(r.c, '')), "
        f"lambda t: {strip('t')}), lambda t: t <> '') AS ct FROM packed)"
    )
    ctes.append(
        "numbered AS (SELECT * EXCLUDE (ct, text), unnest(ct) AS chunk_text, unnest(range(0, len(ct)))::INT AS chunk_index FROM lists)"
    )
    ctes.append(
        "chunked AS (SELECT *, length(chunk_text)::INT AS chunk_length, sha256(concat_ws('_', document_id, "
        "coalesce(page_number::VARCHAR, 'no_page'), 'no_section', chunk_index::VARCHAR)) AS chunk_id FROM numbered)"
    )
    return ",\n".join(ctes)


# The documents table as pages: what most queries start from.
PAGES = f"""pages_of_text AS (
  SELECT doc_id::VARCHAR AS document_id, source AS short_title, lang AS language, NULL::VARCHAR AS regulation_title,
         'https://corpus.example/' || source || '/' || doc_id AS source_url, 1 AS page_number,
         source || '_' || doc_id || '.txt' AS file_name, {clean('text')} AS text
  FROM documents)"""

CHUNKED = f"{PAGES},\n{chunks('pages_of_text')}"


def keyword(k: int | None, chunks: str = "chunked", questions: str = "asked", prefix: str = "kw", text: str = "chunk_text") -> str:
    """CTEs that end in ``<prefix>_hits``: question_id, chunk_id, score, rank."""
    p = prefix
    best = f"\n  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= {k}" if k else ""
    return f"""{p}_tok AS (SELECT chunk_id, {tokens(text)} AS toks FROM {chunks}),
{p}_tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM {p}_tok) GROUP BY ALL),
{p}_n AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM {p}_tok),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY term),
{p}_q AS (SELECT DISTINCT question_id, unnest({tokens('question')}) AS term FROM {questions}),
{p}_scored AS (
  SELECT question_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))), 6) AS score
  FROM {p}_q JOIN {p}_df USING (term) JOIN {p}_tf USING (term) JOIN {p}_tok USING (chunk_id) CROSS JOIN {p}_n GROUP BY ALL),
{p}_hits AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {p}_scored{best})"""


def vectors(source: str, key: str, text: str, dims: int, prefix: str) -> str:
    """CTE ``<prefix>``: key and unit vector of hashed words."""
    return f"""{prefix}_w AS (
  SELECT {key}, ({md5_number('term')} % {dims})::INT AS b, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS w
  FROM (SELECT {key}, unnest({tokens(text)}) AS term FROM {source}) GROUP BY ALL),
{prefix}_n AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {prefix}_w GROUP BY ALL HAVING sum(w * w) > 0),
{prefix} AS (
  SELECT n.{key}, list((coalesce(w.w, 0) / n.norm)::FLOAT ORDER BY r.b) AS embedding
  FROM {prefix}_n n CROSS JOIN (SELECT unnest(range(0, {dims}))::INT AS b) r LEFT JOIN {prefix}_w w ON w.{key} = n.{key} AND w.b = r.b
  GROUP BY n.{key})"""


def nearest(k: int, questions: str, rows: str, prefix: str = "vec") -> str:
    """CTE ``<prefix>_hits``: exact cosine neighbours."""
    return f"""{prefix}_s AS (
  SELECT q.question_id, c.chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM {questions} q CROSS JOIN {rows} c),
{prefix}_hits AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {prefix}_s
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= {k})"""


def fused(k: int, lists: tuple[str, ...], prefix: str = "fused") -> str:
    union = " UNION ALL ".join(f"SELECT question_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS part FROM {name}" for name in lists)
    return f"""{prefix}_s AS (SELECT question_id, chunk_id, round(sum(part), 6) AS score FROM ({union}) GROUP BY ALL),
{prefix}_hits AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {prefix}_s
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= {k})"""


ASKED = "asked AS (SELECT item_id AS question_id, text AS question FROM benchmark)"


def cells(vector: str) -> str:
    """A number over all cells of a vector, each rounded to 5 places and weighed by its place."""
    return f"coalesce(list_sum(list_transform({vector}, lambda x, i: i * round(x::DOUBLE * 100000)::BIGINT)), 0)::BIGINT"
