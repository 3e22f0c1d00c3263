"""Index rows and retrieval over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import norm_key
from corpusmill.operators.embed import embed
from corpusmill.operators.hybrid import search_hybrid
from corpusmill.operators.index import (
    dedupe, facets, index_eligible, order_fields, sample_index, to_index_rows, upsert_index, where_fields,
)
from corpusmill.operators.keyword import search_keyword
from corpusmill.operators.vector import CALIBRATION_ROWS, ROUNDS, CellIndex, cell_index, recall_at_k, search_vector, search_vector_ann
from corpusmill.querybook import sql
from corpusmill.querybook.frames import asked, chunks_of_text, pages_of_text, stored_chunks, stored_postings
from corpusmill.querybook.registry import query, spread, table, vector_cells
from corpusmill.sources.index_sink import publish, publish_index

DIMS = 64
_HITS = "SELECT question_id, chunk_id, score, rank FROM {}"


@query("search_keyword", f"WITH {sql.CHUNKED},\n{sql.ASKED},\n{sql.keyword(5)} {_HITS.format('kw_hits')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_keyword(asked(spark, sf_dir), stored_postings(chunks_of_text(spark, sf_dir)), 5)


@query(
    "search_keyword_documents",
    "WITH docs AS (SELECT doc_id AS chunk_id, text AS chunk_text FROM documents),\n"
    f"{sql.ASKED},\n{sql.keyword(5, chunks='docs')} {_HITS.format('kw_hits')}",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search_keyword(asked(spark, sf_dir), stored_postings(docs, "doc_id", ("text",)), 5)


_VECTORS = (
    f"{sql.vectors('chunked', 'chunk_id', 'chunk_text', DIMS, 'cv')},\n{sql.ASKED},\n{sql.vectors('asked', 'question_id', 'question', DIMS, 'qv')}"
)


def _question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed(asked(spark, sf_dir), "question", DIMS)


@query("search_vector", f"WITH {sql.CHUNKED},\n{_VECTORS},\n{sql.nearest(5, 'qv', 'cv')} {_HITS.format('vec_hits')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vector(_question_vectors(spark, sf_dir), embed(chunks_of_text(spark, sf_dir), dims=DIMS), 5)


def _label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of every label, as a query for its typical members."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = cells.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"])
    return mean.groupBy(F.col("label").alias("question_id")).agg(vector.alias("embedding"))


_CENTRES = """cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings),
centre AS (SELECT label AS question_id, list(x ORDER BY pos) AS embedding FROM (SELECT label, pos, round(avg(x), 9) AS x FROM cells GROUP BY ALL) GROUP BY ALL),
stored AS (SELECT vec_id AS chunk_id, embedding FROM embeddings)"""


@query("nearest_to_label_centres", f"WITH {_CENTRES},\n{sql.nearest(10, 'centre', 'stored')} {_HITS.format('vec_hits')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vector(_label_centres(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, id_col="vec_id")


@query(
    "nearest_euclidean",
    f"""WITH {_CENTRES}, s AS (SELECT question_id, chunk_id, round(-list_distance(c.embedding, s.embedding::DOUBLE[]), 6) + 0.0 AS score FROM centre c CROSS JOIN stored s)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 10""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vector(_label_centres(spark, sf_dir), table(spark, sf_dir, "embeddings"), 10, "euclidean", "vec_id")


CELLS = 32


def _cells_sql(cells: int, k: int, recall: float, rounds: int = ROUNDS) -> str:
    """Centres turn by turn, the cells that hold enough neighbours of the first rows, and the search in them."""

    def likest(rows: str, centres: str) -> str:
        return f"SELECT r.*, c.cell, row_number() OVER (PARTITION BY r.chunk_id ORDER BY round(list_dot_product(r.v, c.c), 9) DESC, c.cell) AS place FROM {rows} r, {centres} c"

    out = ["unit AS (SELECT vec_id AS chunk_id, embedding, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0)",
           f"k0 AS (SELECT (row_number() OVER (ORDER BY md5(chunk_id::VARCHAR), chunk_id) - 1)::INT AS cell, v AS c FROM unit QUALIFY row_number() OVER (ORDER BY md5(chunk_id::VARCHAR), chunk_id) <= {cells})"]
    for i in range(rounds):
        out.append(f"s{i} AS (SELECT cell, pos, round(sum(x), 6) AS x FROM (SELECT cell, unnest(v) AS x, unnest(range(len(v))) AS pos FROM ({likest('unit', f'k{i}')}) WHERE place = 1) GROUP BY ALL)")
        out.append(f"m{i} AS (SELECT cell, list(x ORDER BY pos) AS c FROM s{i} GROUP BY cell)")
        out.append(f"k{i + 1} AS (SELECT k.cell, coalesce(list_transform(m.c, lambda x: x / sqrt(list_dot_product(m.c, m.c))), k.c) AS c FROM k{i} k LEFT JOIN m{i} m USING (cell))")
    out.append(f"stored_cells AS (SELECT * FROM ({likest('unit', f'k{rounds}')}) WHERE place = 1)")
    out.append(f"first_rows AS (SELECT * FROM unit ORDER BY md5(chunk_id::VARCHAR), chunk_id LIMIT {CALIBRATION_ROWS})")
    out.append(f"""calibration AS (
  SELECT q.chunk_id AS q, s.cell FROM first_rows q JOIN stored_cells s ON q.chunk_id <> s.chunk_id
  QUALIFY row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) DESC, s.chunk_id) <= {k})""")
    out.append(f"places AS (SELECT row_number() OVER (ORDER BY l.place) AS n, l.place FROM calibration c JOIN ({likest('first_rows', f'k{rounds}')}) l ON l.chunk_id = c.q AND l.cell = c.cell)")
    out.append(f"probes AS (SELECT place AS probes FROM places WHERE n = ceil({recall} * (SELECT count(*) FROM places)))")
    out.append(f"""opened AS (
  SELECT question_id, cell FROM (SELECT q.question_id, c.cell, row_number() OVER (PARTITION BY question_id ORDER BY round(list_dot_product(q.embedding, c.c) / sqrt(list_dot_product(q.embedding, q.embedding)), 9) DESC, c.cell) AS place FROM centre q, k{rounds} c), probes
  WHERE place <= probes)""")
    out.append(f"""ann_hits AS (
  SELECT question_id, chunk_id, score, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id))::INT AS rank
  FROM (SELECT question_id, chunk_id, round(list_cosine_similarity(q.embedding, s.embedding::DOUBLE[]), 6) + 0.0 AS score FROM opened JOIN stored_cells s USING (cell) JOIN centre q USING (question_id))
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= {k})""")
    return ",\n".join(out)


# The wanted recall lies above 0.9, since neighbours of the label centres lie farther apart than those of the rows.
_RECALL = 0.95
_ANN = _cells_sql(CELLS, 10, _RECALL)


def _cells(spark: SparkSession, sf_dir: str) -> CellIndex:
    return cell_index(table(spark, sf_dir, "embeddings"), CELLS, 10, _RECALL, "vec_id")


@query("search_vector_ann", f"WITH {_CENTRES},\n{_ANN} {_HITS.format('ann_hits')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vector_ann(_label_centres(spark, sf_dir), _cells(spark, sf_dir), 10)


@query(
    "ann_recall",
    f"""WITH {_CENTRES},\n{sql.nearest(10, 'centre', 'stored')},\n{_ANN}
SELECT question_id, round(count(a.chunk_id) / count(*)::DOUBLE, 3) AS recall FROM vec_hits v LEFT JOIN ann_hits a USING (question_id, chunk_id) GROUP BY question_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres, vectors = _label_centres(spark, sf_dir), table(spark, sf_dir, "embeddings")
    return recall_at_k(search_vector(centres, vectors, 10, id_col="vec_id"), search_vector_ann(centres, _cells(spark, sf_dir), 10))


HYBRID = (
    f"{sql.CHUNKED},\n{_VECTORS},\n{sql.keyword(None)},\n{sql.nearest(5, 'qv', 'cv')},\n{sql.fused(5, ('kw_hits', 'vec_hits'))}"
)


def hybrid_hits(spark: SparkSession, sf_dir: str, chunks: DataFrame, k: int = 5) -> DataFrame:
    return search_hybrid(_question_vectors(spark, sf_dir), stored_postings(chunks), embed(chunks, dims=DIMS), k)


@query("search_hybrid", f"WITH {HYBRID} {_HITS.format('fused_hits')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_hits(spark, sf_dir, stored_chunks(spark, sf_dir))


@query(
    "search_filtered",
    f"WITH {sql.CHUNKED},\nfr AS (SELECT * FROM chunked WHERE short_title = 'src3'),\n{sql.ASKED},\n{sql.keyword(5, chunks='fr')} {_HITS.format('kw_hits')}",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The filter is on a column of the documents, so it reaches their scan.
    return search_keyword(asked(spark, sf_dir), stored_postings(where_fields(chunks_of_text(spark, sf_dir), short_title="src3")), 5)


@query(
    "index_rows",
    f"""WITH {sql.CHUNKED},\n{sql.vectors('chunked', 'chunk_id', 'chunk_text', DIMS, 'cv')}
SELECT chunk_id, chunk_text, short_title, regulation_title, source_url, page_number, file_name, {sql.cells('embedding')} AS cells FROM chunked LEFT JOIN cv USING (chunk_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_eligible(to_index_rows(embed(chunks_of_text(spark, sf_dir), dims=DIMS)))
    return rows.withColumn("cells", vector_cells(F.col("embedding"))).drop("embedding")


@query(
    "index_eligible",
    "SELECT doc_id::VARCHAR AS chunk_id, label FROM documents JOIN embeddings ON vec_id = doc_id WHERE trim(text, ' ') <> ''",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Documents without a vector stay in the left join and are then dropped.
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vectors, docs.doc_id == vectors.vec_id, "left").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"), "embedding", "label"
    )
    return index_eligible(rows).select("chunk_id", "label")


@query(
    "dedupe_by_text",
    "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id")
    return dedupe(keyed, "text_hash", ["doc_id"])


@query(
    "dedupe_by_loose_url",
    f"SELECT url_key, page_id FROM (SELECT {sql.norm('url')} AS url_key, page_id FROM pages) QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id DESC) = 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select(norm_key(F.col("url")).alias("url_key"), "page_id")
    return dedupe(keyed, "url_key", [F.col("page_id").desc()])


@query(
    "upsert_index",
    f"""SELECT vec_id, CASE WHEN label >= 5 THEN label + 100 ELSE label END AS label, {sql.cells('embedding')} AS cells FROM embeddings
UNION ALL SELECT -1 - vec_id, label, {sql.cells('embedding')} FROM embeddings WHERE label = 9""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", vector_cells(F.col("embedding")).alias("cells"))
    changed = rows.filter("label >= 5").withColumn("label", F.col("label") + 100)
    added = rows.filter("label = 9").withColumn("vec_id", -1 - F.col("vec_id"))
    return upsert_index(rows, changed.unionByName(added), "vec_id")


@query(
    "sample_index",
    f"WITH {sql.CHUNKED} SELECT chunk_id, left(chunk_text, 500) AS chunk_preview FROM chunked ORDER BY chunk_id LIMIT 5",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_index(chunks_of_text(spark, sf_dir), 5)


@query("facets", f"WITH {sql.CHUNKED} SELECT short_title AS value, count(*) AS count FROM chunked GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(chunks_of_text(spark, sf_dir), "short_title")


@query(
    "filtered_sorted_pages",
    f"WITH {sql.PAGES} SELECT document_id AS chunk_id, page_number, md5(text) AS text_md5 FROM pages_of_text WHERE page_number = 1 AND short_title = 'src4' AND text <> ''",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_text(spark, sf_dir).withColumnRenamed("document_id", "chunk_id")
    kept = where_fields(pages, page_number=1, short_title="src4")
    return order_fields(kept, "chunk_id", ascending=False).select("chunk_id", "page_number", F.md5("text").alias("text_md5"))


def _checking_writer():
    """Accepts a row when it has an id and a vector: what an index service checks first."""

    def write(rows):
        return [i is not None and v is not None and len(v) > 0 for i, v in zip(rows["chunk_id"], rows["embedding"])]

    return write


@query(
    "publish_batches",
    f"""WITH s AS (SELECT vec_id, ({sql.md5_number('vec_id::VARCHAR')} % 16)::INT AS shard FROM embeddings),
b AS (SELECT shard, ((row_number() OVER (PARTITION BY shard ORDER BY vec_id) - 1) // 20 + 1)::INT AS batch FROM s)
SELECT shard, batch, count(*) AS n_ok, 0::BIGINT AS n_failed FROM b GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return publish_index(rows, _checking_writer, batch_size=20, shards=16)


def _refusing_writer():
    """Refuses the rows of one label, as an index service refuses what breaks its rules."""

    def write(rows):
        return [label != 7 for label in rows["label"]]

    return write


@query(
    "publish_commit",
    f"""WITH s AS (SELECT vec_id, label, ({sql.md5_number('vec_id::VARCHAR')} % ceil((SELECT count(*) FROM embeddings) / 60.0)::BIGINT)::INT AS shard FROM embeddings),
b AS (SELECT *, ((row_number() OVER (PARTITION BY shard ORDER BY vec_id) - 1) // 20 + 1)::INT AS batch FROM s)
SELECT shard, batch, count(*) FILTER (label IS DISTINCT FROM 7) AS n_ok, count(*) FILTER (label = 7) AS n_failed,
       coalesce(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) FILTER (label IS DISTINCT FROM 7), '') AS taken, coalesce(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) FILTER (label = 7), '') AS refused
FROM b GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    sent = publish(rows, _refusing_writer, batch_size=20, allow_failed=True, shard_rows=60)
    return sent.select("shard", "batch", "n_ok", "n_failed", F.array_join("taken", ",").alias("taken"), F.array_join("refused", ",").alias("refused"))
