"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import cascade, digest, langid, lexical, mixing, multi_index, packing, quotes, repair, secrets, simhash, spans, warc
from corpusmill.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file() -> str:
    """The public byte-level vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document."""
    found = simhash.classes(read(spark, sf_dir, "documents"), simhash.CONTRACT)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("w")[0]), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op3_mix_sources",
    r"""
    WITH docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
    ),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
        FROM docs GROUP BY source
    ),
    ordered AS (
        SELECT *, 3 * source_size AS cap,
               coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before,
               (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS weights
        FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    level AS (
        SELECT max((total - cap_before) / (weights - weight_before)) AS level FROM ordered
        WHERE (total - cap_before) / (weights - weight_before) <= cap / weight
    ),
    targets AS (SELECT source, source_size, least(level * weight, cap::DOUBLE) AS target FROM ordered, level),
    placed AS (
        SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
    FROM placed
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    found = mixing.mixed(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds, and the ranges that were cut."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return spans.without_repeats(docs, spans="removed")


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pieces of every document lie in sequences of 2048 tokens."""
    return packing.packed(read(spark, sf_dir, "documents"), tokenizer_file()).drop("tk")


@query("op9_improbable_digest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document, and how like it is to its half edited text and to the next document."""
    return digest.fingerprints(read(spark, sf_dir, "documents"))


@query(
    "op10_warc_splits",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives."""
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_language_models")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, told from its text."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predictions(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


#: Verdict, host and path of the rules of op5.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query(
    "op5_bloom_cascade",
    r"""
    WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
    c AS (
        SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
        FROM b
    ),
    rules(v, h, p) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
    ),
    best AS (
        SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
        FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
    ),
    listed AS (SELECT DISTINCT regexp_extract(host, '(?:^|\.)([^.]*(?:cheap|casino|pills|loans)[^.]*\..*)$', 1) AS host FROM c)
    SELECT c.page_id, c.host, c.path, best.rule,
           coalesce(best.v, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE l.host <> '' AND (c.host = l.host OR ends_with(c.host, '.' || l.host))) THEN 'block' ELSE 'allow' END) AS verdict
    FROM c LEFT JOIN best USING (page_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return cascade.judged(pages, URL_RULES, cascade.spam_domains(pages)).drop("url")


@query("op7_inverted_multi_index")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query(
    "op1_quotation_links",
    r"""
    WITH RECURSIVE m AS (
        SELECT DISTINCT conv_id, turn, conv_id || ':' || turn AS id, coalesce(text, '') AS text,
               trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS said FROM conversations
    ),
    origin AS (SELECT conv_id, said, min(turn) AS turn FROM m WHERE said <> '' GROUP BY conv_id, said),
    tree AS (
        SELECT m.*, o.turn AS up, (o.turn IS NOT NULL)::BIGINT + (o2.turn IS NOT NULL)::BIGINT AS linked
        FROM m
        LEFT JOIN m p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1
        LEFT JOIN origin o ON o.conv_id = m.conv_id AND o.said = p.said
        LEFT JOIN m p2 ON p2.conv_id = p.conv_id AND p2.turn = m.turn - 2
        LEFT JOIN origin o2 ON o2.conv_id = m.conv_id AND o2.said = p2.said
    ),
    walk AS (
        SELECT conv_id, turn, turn AS root, 0::BIGINT AS depth FROM tree WHERE up IS NULL
        UNION ALL
        SELECT t.conv_id, t.turn, w.root, w.depth + 1 FROM tree t JOIN walk w ON t.conv_id = w.conv_id AND t.up = w.turn
    )
    SELECT t.id AS message_id, t.conv_id::VARCHAR AS thread, t.turn AS sent, regexp_replace(t.text, '^\s+|\s+$', '', 'g') AS text,
           t.conv_id || ':' || t.up AS parent_id, t.linked, t.conv_id || ':' || w.root AS root_id, w.depth,
           row_number() OVER (PARTITION BY t.conv_id, w.root ORDER BY t.turn, t.id) AS position
    FROM tree t JOIN walk w ON t.conv_id = w.conv_id AND t.turn = w.turn
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as mail that quotes the turns before it: linked to what it quotes and put in reply order."""
    return quotes.linked(quotes.quoting(read(spark, sf_dir, "conversations")))


@query(
    "op13_lexical_search",
    r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ),
    docs AS (SELECT row_number() OVER () AS r, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
    totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM docs),
    held AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
    asked AS (
        SELECT item_id, term, count(*)::BIGINT AS times
        FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        )
        GROUP BY ALL
    ),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term
    ),
    scores AS (
        SELECT item_id, r, any_value(doc_id) AS doc_id,
               sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::BIGINT AS score
        FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (r), totals
        GROUP BY item_id, r
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that fit every benchmark item best."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _repair_sql() -> str:
    """The cheapest edits turn by turn, from the left, with the repaired text carried along in each of the four places."""

    def edit(state: str, cost: str, letter: str, line: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}', 'o': {state}.o || {line}}}"

    def insert(state: str, role: str) -> str:
        return edit(state, "5", "I", f"'{role}:' || chr(10)")

    def told(role: str) -> str:
        return f"{role} || ':' || text || chr(10)"

    gone = [edit(f"t{i}", "2", "D", "''") for i in range(4)]
    return f"""
    WITH RECURSIVE table_ AS (
        SELECT list(v ORDER BY i) AS t
        FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
    ),
    keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                               lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS act
        FROM conversations, table_
    ),
    damaged AS (
        SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role,
               CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM (SELECT *, unnest(CASE act WHEN 0 THEN []::BIGINT[] WHEN 3 THEN range(2) ELSE range(1) END) AS copy FROM keyed)
    ),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, left(role, 1) AS ini
        FROM damaged
    ),
    marked AS (
        SELECT *, CASE WHEN last = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS fault,
               ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair
        FROM ordered
    ),
    counts AS (
        SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
               count(*) FILTER (fault = 'b')::BIGINT AS blank, count(*) FILTER (fault = 'd')::BIGINT AS duplicate, count(*) FILTER (fault = 't')::BIGINT AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
        FROM marked GROUP BY conv_id
    ),
    walk AS (
        SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'e': '', 'o': ''}} AS t0, {{'c': 1000000000::BIGINT, 'e': '', 'o': ''}} AS t1,
               {{'c': 5::BIGINT, 'e': 'I', 'o': 'user:' || chr(10)}} AS t2, {{'c': 10::BIGINT, 'e': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS t3
        FROM counts
        UNION ALL
        SELECT conv_id, i, n0, n1, c2, least(n3, {insert("c2", "assistant")}) FROM (
            SELECT *, least(n2, {insert("least(n0, n1, n3)", "user")}) AS c2 FROM (
                SELECT conv_id, i, {gone[0]} AS n0,
                       least({gone[1]}, CASE WHEN ok AND ini = 's' THEN {edit("t0", "extra", "K", told("role"))} ELSE {gone[1]} END) AS n1,
                       least({gone[2]}, CASE WHEN ok THEN {edit("tu", "extra + 1", "R", told("'user'"))} ELSE {gone[2]} END,
                             CASE WHEN ok AND ini = 'u' THEN {edit("tu", "extra", "K", told("role"))} ELSE {gone[2]} END) AS n2,
                       least({gone[3]}, CASE WHEN ok THEN {edit("t2", "extra + 1", "R", told("'assistant'"))} ELSE {gone[3]} END,
                             CASE WHEN ok AND ini = 'a' THEN {edit("t2", "extra", "K", told("role"))} ELSE {gone[3]} END) AS n3
                FROM (
                    SELECT m.conv_id, m.i, m.role, m.text, m.ini, m.fault IN ('t', 'n') AS ok, CASE m.fault WHEN 't' THEN 5 ELSE 0 END AS extra,
                           w.t0, w.t1, w.t2, w.t3, least(w.t0, w.t1, w.t3) AS tu
                    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
                )
            )
        )
    ),
    ends AS (SELECT w.conv_id, least(t0, t3) AS best FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)
    SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit,
           sha256(coalesce(left(best.o, greatest(length(best.o) - 1, 0)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) d
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM d.conv_id
    """


@query("op12_structure_repair", _repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with the cheapest edits that give it its form again."""
    return repair.summary(read(spark, sf_dir, "conversations"))


def _secrets_sql() -> str:
    """Matches with their places by running sums, then scopes as in the operator."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def hits(kind: int, pattern: str, keep: str = "true", begin: str = "") -> str:
        whole = quoted(begin + pattern)
        return f"""
        SELECT r, {kind} AS kind, start, start + length(hit) AS stop FROM (
            SELECT r, hit, (sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY r ORDER BY i) - coalesce(length(hit), 0))::BIGINT AS start
            FROM (SELECT r, unnest(string_split_regex(text, {whole})) AS gap, unnest(regexp_extract_all(text, {whole})) AS hit, generate_subscripts(string_split_regex(text, {whole}), 1) AS i FROM docs)
        )
        WHERE hit IS NOT NULL AND {keep}
        """

    def named(pattern: str, least: int, most: int = 1 << 30) -> str:
        return f"length(regexp_extract(hit, {quoted(pattern)}, 2)) BETWEEN {least} AND {most}"

    word = r"\b"
    base = [hits(0, secrets.ASSIGN, named(secrets.ASSIGN, 8)), hits(1, secrets.ACCESS), hits(2, secrets.HEX)]
    weak = [
        hits(3, secrets.IDENTIFIER, named(secrets.IDENTIFIER, 3), word),
        hits(4, secrets.SECRET, named(secrets.SECRET, 4), word),
        hits(4, secrets.ASSIGN, named(secrets.ASSIGN, 4, 7)),
        hits(4, secrets.TOKEN, "regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')"),
        hits(5, secrets.URL),
        hits(5, secrets.ENDPOINT, named(secrets.ENDPOINT, 3), word),
        hits(-1, secrets.BLANK_LINE),
    ]
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    told = f"string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    half = secrets.SCOPE_CHARS // 2
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    base AS ({" UNION ALL ".join(base)}),
    events AS (SELECT * FROM base UNION ALL {" UNION ALL ".join(weak)}),
    told AS (
        SELECT *, sum((kind < 0)::INTEGER) OVER (a ROWS UNBOUNDED PRECEDING) AS paragraph,
               max(stop) FILTER (kind >= 0) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached,
               min(start) FILTER (kind BETWEEN 0 AND 2) OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
        FROM events WINDOW a AS (PARTITION BY r ORDER BY start, kind NOT BETWEEN 0 AND 2, stop DESC, kind)
    ),
    parts AS (SELECT * FROM told WHERE kind BETWEEN 0 AND 2 OR kind > 2 AND coalesce(reached, 0) <= start AND coalesce(next >= stop, true)),
    inside AS (SELECT * FROM (SELECT *, unnest([start // {half}, start // {half} - 1]) AS scope FROM parts) WHERE stop <= scope * {half} + {secrets.SCOPE_CHARS}),
    whole AS (SELECT r, paragraph, scope FROM inside GROUP BY ALL HAVING bool_or(kind IN (1, 3)) AND bool_or(kind IN (0, 2, 4))),
    every AS (SELECT r, kind, start, stop FROM base UNION ALL (SELECT DISTINCT r, kind, start, stop FROM inside JOIN whole USING (r, paragraph, scope) WHERE kind > 2)),
    counts AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, {told} AS t FROM base GROUP BY r),
    lists AS (SELECT r, {told} AS t FROM every GROUP BY r)
    SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
           sha256(coalesce(c.t, '')) AS base_sha256, coalesce(l.t, '') AS spans
    FROM docs LEFT JOIN counts c USING (r) LEFT JOIN lists l USING (r)
    """


@query("op11_secret_links", _secrets_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secrets.secrets(read(spark, sf_dir, "documents")).drop("found")
