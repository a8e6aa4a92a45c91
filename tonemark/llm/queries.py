"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemark.llm import (
    bpe,
    collocations,
    embedding_dedup,
    exact_substrings,
    fuzzy_passages,
    importance,
    language_id,
    mixing,
    quality_rules,
    secrets,
    simhash,
    toxicity,
    warc,
)
from tonemark.llm.shared import cut, documents, table
from tonemark.plans.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir, "doc_id", "text")), ["doc_id"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir, "doc_id", "text"), VOCABULARY)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    docs = cut(docs, "sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = cut(mixing.targets(sizes), "targets")
    taken = mixing.mix(docs, wanted, "doc_id", "size", F.array("source"))
    named = wanted.withColumnRenamed("source", "_source")
    joined = taken.join(named, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def op5_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages.linked_documents(fuzzy_passages.shared_passages(documents(spark, sf_dir, "doc_id", "text")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language_id.fit(docs)
    named = language_id.predict(docs.drop("lang"), model)
    return named.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    counted = quality_rules.with_statistics(docs).select("doc_id", "lang", "source", *quality_rules.STATISTICS)
    counted = cut(counted, "statistics")
    judged = quality_rules.judged(counted, quality_rules.fit(counted))
    return judged.select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept", "distance")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, index = scratch_path(spark, "archives"), scratch_path(spark, "capture_index")
    pages = table(spark, sf_dir, "pages")
    _, directory = warc.archive(pages, archives, index)
    return warc.read_records(warc.find(warc.keys_of(pages), directory, index), archives)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "benchmark").select("text")
    drawn = importance.resample(documents(spark, sf_dir, "doc_id", "text"), target)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_substrings": op1_exact_substrings,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_fuzzy_passages": op5_fuzzy_passages,
    "op6_language_id": op6_language_id,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_importance": op11_importance,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op7_embedding_dedup": """
        WITH RECURSIVE usable AS (
          SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
          ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
        ),
        reach AS (
          SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION
          SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ),
        parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM parts LEFT JOIN counts USING (vec_id)""",
    "op10_warc": """
        WITH pay AS (
          SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
          FROM pages
        ),
        best AS (SELECT payload_digest, max(page_id) AS first FROM pay WHERE payload_bytes >= 1000 GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM pay LEFT JOIN best USING (payload_digest)""",
    "op11_importance": """
        WITH RECURSIVE steps AS (
          SELECT range AS b, range AS c, 0 AS k FROM range(256)
          UNION ALL
          SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
        ),
        lut AS (SELECT list(c ORDER BY b) AS l FROM steps WHERE k = 8),
        texts AS (
          SELECT doc_id AS id, true AS doc, text FROM documents
          UNION ALL SELECT NULL, false, text FROM benchmark
        ),
        split AS (
          SELECT row_number() OVER () AS nr, id, doc, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM texts
        ),
        words AS (
          SELECT nr, id, doc, coalesce(len(w), 0)::BIGINT AS n, list_concat(coalesce(w, []),
            list_transform(range(1, coalesce(len(w), 0)), lambda i: w[i] || ' ' || w[i + 1])) AS f
          FROM split
        ),
        uses AS (SELECT nr, doc, unnest(f) AS f FROM words),
        kinds AS (SELECT f, hex(encode(f)) AS x FROM uses GROUP BY f),
        cells AS (
          SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2),
              lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT),
              lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS cell
          FROM kinds, lut
        ),
        counts AS (
          SELECT cell, count(*) FILTER (doc) AS s, count(*) FILTER (NOT doc) AS t
          FROM uses JOIN cells USING (f) GROUP BY cell
        ),
        totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
        gains AS (
          SELECT cell, floor(1000 * ln(((t + 1.0::DOUBLE) * (s_all + 10000)) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g
          FROM counts, totals
        ),
        sums AS (
          SELECT nr, sum(g)::BIGINT AS g FROM uses JOIN cells USING (f) JOIN gains USING (cell) WHERE doc GROUP BY nr
        ),
        scored AS (
          SELECT id AS doc_id, n, len(f)::BIGINT AS n_features,
                 coalesce(floor(g::DOUBLE / nullif(len(f), 0))::BIGINT, 0) AS weight,
                 floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE)
                   / 4294967296.0::DOUBLE)))::BIGINT AS noise
          FROM words LEFT JOIN sums USING (nr) WHERE doc
        ),
        placed AS (
          SELECT *, weight + noise AS score, n >= 20 AS able,
                 row_number() OVER (PARTITION BY n >= 20 ORDER BY weight + noise DESC, doc_id) AS r,
                 count(*) FILTER (n >= 20) OVER () AS total
          FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * total // 100 THEN r END AS rank
        FROM placed""",
    "op13_collocations": r"""
        WITH pieces AS (
          SELECT row_number() OVER () AS piece, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
          FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[.,;:!?\x0A-\x0D]')) AS p
            FROM documents
          )
        ),
        grams AS (
          SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
          FROM pieces, (SELECT unnest(range(1, 6)) AS m)
          WHERE len(w) >= m
        ),
        counts AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
        sizes AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE m = 1 GROUP BY lang),
        often AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100),
        held AS (
          SELECT lang, array_to_string(w[i : j], ' ') AS phrase, max(f) AS most
          FROM often, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j)
          WHERE m > 2 AND i < j AND j <= m AND j - i + 1 < m
          GROUP BY ALL
        ),
        kept AS (
          SELECT often.* FROM often LEFT JOIN held USING (lang, phrase)
          WHERE m >= 2 AND (most IS NULL OR 100 * most < 100 * f)
        ),
        cuts AS (
          SELECT lang, phrase, f, k, array_to_string(w[1 : k], ' ') AS a1, array_to_string(w[k + 1 : m], ' ') AS a2
          FROM kept, (SELECT unnest(range(1, 5)) AS k)
          WHERE k < m
        ),
        scores AS (
          SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n, k, (1000 * cuts.f * n) // (x.f * y.f) AS score
          FROM cuts JOIN often x ON x.lang = cuts.lang AND x.phrase = a1
          JOIN often y ON y.lang = cuts.lang AND y.phrase = a2 JOIN sizes ON sizes.lang = cuts.lang
        ),
        best AS (
          SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000""",
}
