"""Queries of the problems pN and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, names, nndescent, overlap, packing, partenum, quality, tokenizer
from foliant.llm.classes import expand, link_counts
from foliant.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.neighbours(table(spark, sf_dir, "embedding_csv"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.neighbour_pairs(p1_neighbours(spark, sf_dir))


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the books whose number is divisible by 20, by greedy search over the graph of all."""
    return nndescent.search_ids(table(spark, sf_dir, "embedding_csv"), "cast(substring(id, 3) as bigint) % 20 = 0")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = overlap.similar_value_sets(table(spark, sf_dir, "lshfakedata"))
    return expand(members, links)


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(*overlap.similar_value_sets(table(spark, sf_dir, "lshfakedata")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = partenum.near_duplicates(table(spark, sf_dir, "lshfakedata"))
    return expand(members, links)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(*partenum.near_duplicates(table(spark, sf_dir, "lshfakedata")))


def p4_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variants(table(spark, sf_dir, "lshfakedata"), table(spark, sf_dir, "short_names"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(p4_persons(spark, sf_dir))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("lshfakedata", "language_names", "stopwords", "books_csv"))
    return langid.record_languages(*tables).select("id", "seg_no", "lang", "words", "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("lshfakedata", "language_names", "stopwords", "books_csv"))
    return langid.mislabelled(langid.record_languages(*tables))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("lshfakedata", "language_names", "stopwords", "books_csv"))
    return langid.record_languages(*tables, runs=True)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded from its ids again; null texts come back empty."""
    return tokenizer.decode_texts(p6_ids(spark, sf_dir))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


#: A limit on loss-bearing tokens that binds before the capacity does.
LOSS_LIMIT = 1_536


def p7_pack_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p7_pack, with at most 1,536 loss-bearing tokens in a container of more than one piece."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), loss_limit=LOSS_LIMIT)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full both packings are in tokens, segments and loss-bearing tokens."""
    both = ((None, p7_pack(spark, sf_dir)), (LOSS_LIMIT, p7_pack_loss(spark, sf_dir)))
    plain, bound = (packing.fill(packed, loss_limit=limit).withColumn("loss_limit", F.lit(limit or packing.CAPACITY)) for limit, packed in both)
    return plain.unionByName(bound)


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    common = quality.common_words(table(spark, sf_dir, "stopwords"))
    return quality.text_quality(documents, quality.fit(documents, common), common)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).where("chars > 0 and prose < 0.5").select("doc_id").distinct()


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_search": p1_search, "p2_found": p2_found, "p2_links": p2_links, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_persons": p4_persons, "p5_found": p5_found, "p5_languages": p5_languages, "p5_segments": p5_segments, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_pack": p7_pack, "p7_pack_loss": p7_pack_loss, "p7_fill": p7_fill, "p8_found": p8_found, "p8_stats": p8_stats}


_WHITE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SET = "list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: trim(regexp_replace(lower(x), '" + _WHITE + "', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '')))"
_JACCARD = "len(list_intersect(a.{c}, b.{c})) / (len(a.{c}) + len(b.{c}) - len(list_intersect(a.{c}, b.{c})))"

#: By definition, all pairs: for the small scale of the check only.
ORACLE = {
    "p1_found": """WITH v AS (SELECT DISTINCT bookid, TRY_CAST(description_emb AS DOUBLE[]) AS v FROM embedding_csv WHERE json_valid(description_emb)),
u AS (SELECT bookid, v FROM v WHERE len(v) = 1024 AND list_bool_and(list_transform(v, lambda x: isfinite(x))) AND list_dot_product(v, v) > 0),
s AS (SELECT a.bookid AS x, b.bookid AS y, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS c FROM u a JOIN u b ON a.bookid <> b.bookid),
n AS (SELECT x, y FROM s WHERE c >= 0.6 QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS bookid_a, greatest(x, y) AS bookid_b FROM n""",
    "p2_found": f"""WITH s AS (SELECT DISTINCT id, {_SET.replace('{c}', 'characters')} AS ch, {_SET.replace('{c}', 'genres')} AS ge FROM lshfakedata WHERE id IS NOT NULL)
SELECT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.id < b.id WHERE len(a.ch) > 0 AND len(b.ch) > 0 AND len(a.ge) > 0 AND len(b.ge) > 0 AND {_JACCARD.format(c='ch')} >= 0.6 AND {_JACCARD.format(c='ge')} >= 0.5""",
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_found": f"""WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(array_to_string(descriptions, ' '), '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM lshfakedata WHERE id IS NOT NULL),
s AS (SELECT id, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS p FROM t WHERE len(w) > 20)
SELECT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.id < b.id WHERE len(a.p) >= 20 AND len(b.p) >= 20 AND {_JACCARD.format(c='p')} >= 0.6""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLE
