"""The operators as queries over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    alignment,
    bitslice,
    hnsw,
    idfiles,
    language,
    licences,
    lines,
    mixing,
    neardup,
    packing,
    suffixes,
    toxicity,
    whitening,
)
from tallyhouse.session import scratch

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, remainder: int, column: str = "doc_id"):
    """Whether the checksum of the id's text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~fold(3, 1) & F.col("doc_id").isNotNull()))
    return language.identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": fold(3, 1)})


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), WORD_TOKENIZER)


@query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.licences(_table(spark, sf_dir, "documents")))


@query
def op5_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(spark, _table(spark, sf_dir, "embeddings"))


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(spark, _table(spark, sf_dir, "embeddings"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_classes(spark, _table(spark, sf_dir, "documents"), all_lines=True, count_links=False)
    return found.select("doc_id", "line_no", "n_bytes", "class_doc_id", "class_line_no", "kept")


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "id-files")
    idfiles.write_ids(spark, _table(spark, sf_dir, "documents"), path, BYTE_TOKENIZER)
    return idfiles.read_checksums(spark, path)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(4, 2))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(spark, _table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark, _table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark, _table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "part")
    return found.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error"
    )


def _licence_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    places = " ".join(
        f", list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {j}] = {quoted(x)}' for j, x in enumerate(p.split(), 1))}) AS p{k}"
        for k, (p, _) in enumerate(licences.PHRASES)
    )
    templates = ", ".join(
        f"({k}, [{', '.join(quoted(x) for x in sorted(set(t.split())))}], {licences.needed(t)}, {licences.width(t)}, {quoted(label)})"
        for k, (t, label) in enumerate(licences.TEMPLATES)
    )
    at = "list_concat(list_concat(p0, p1), p2)"
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN {quoted(label)} END" for k, (_, label) in enumerate(licences.PHRASES))
    return f"""
    WITH t(k, words, need, width, label) AS (VALUES {templates}),
    low AS (SELECT row_number() OVER () AS row, doc_id,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
    found AS (SELECT row, doc_id, s, regexp_extract_all(s, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
    base AS (SELECT row, doc_id, len(w) AS n_words {places} FROM found),
    spots AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM found),
    own AS (SELECT row, k, i, word, need, width, label, n FROM spots JOIN (SELECT *, len(words) AS n, unnest(words) AS word FROM t) USING (word)),
    met AS (SELECT a.row, a.k, a.i, a.label, a.n, a.need, count(DISTINCT b.word) AS common FROM own a, own b
            WHERE a.row = b.row AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.width GROUP BY ALL),
    held AS (SELECT row, list(DISTINCT label) AS labels, max(common / n) AS best, count(*) AS n_blocks FROM met WHERE common >= need GROUP BY row),
    named AS (SELECT *, list_filter([{base}], lambda x: x IS NOT NULL) AS own, {at} AS spots FROM base LEFT JOIN held USING (row))
    SELECT doc_id, n_words, len(spots) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word,
           array_to_string(list_sort(list_distinct(own)), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(own, coalesce(labels, [])))), ',') AS labels,
           CASE WHEN len(spots) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
    FROM named"""


ORACLES["op4_licence_scan"] = _licence_sql()

# Equal scores go to the smaller id. Usable vectors hold finite numbers only.
ORACLES["op5_bit_sliced_top_k"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    met AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM met
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
