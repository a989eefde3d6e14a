"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import (
    collocations, contamination, cotraining, hard_negatives, language, mixing, quality, repeats, secrets, simhash, surrogates, token_files, tokens,
)
from wiretally.sources.storage import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def checked(sql: str):
    """A query with the SQL of the same result."""
    def wrap(fn):
        SQL[fn.__name__] = sql
        return query(fn)

    return wrap


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language(spark, sf):
    return language.identify(_read(spark, sf))


@query
def op2_simhash(spark, sf):
    rows = simhash.classes(_read(spark, sf))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_mixing(spark, sf):
    return mixing.mix(_read(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_surrogates(spark, sf):
    return surrogates.replace(_read(spark, sf)).select("doc_id", "text", "n_entities")


@query
def op5_repeats(spark, sf):
    return repeats.remove_repeats(_read(spark, sf)).drop("kept")


@query
def op6_tokens(spark, sf):
    import public_tokenizers

    rows = tokens.count_tokens(_read(spark, sf).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > 1024)


@query
def op7_cotraining(spark, sf):
    return cotraining.classify(_read(spark, sf), _read(spark, sf, "labels"))


@query
def op8_secrets(spark, sf):
    return secrets.digest(secrets.scan(_read(spark, sf)))


@query
def op9_contamination(spark, sf):
    found = contamination.containment(_read(spark, sf), _read(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "found", "containment")


@query
def op10_quality(spark, sf):
    return quality.judge(_read(spark, sf))


@query
def op11_token_files(spark, sf):
    import public_tokenizers

    folder = fresh_folder(spark, "llm-token-files")
    token_files.write_tokens(_read(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_digests(spark, folder)


@checked(r"""WITH r AS (SELECT vec_id::BIGINT AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, a.label = b.label AS same, b.id AS other, list_inner_product(a.q, b.q)::BIGINT AS score FROM (SELECT * FROM r WHERE id % 50 = 0) a, r b WHERE a.id <> b.id),
p AS (SELECT anchor, other AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor, p.positive, p.score AS ps, s.other AS negative, s.score AS ns FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score
FROM (SELECT *, row_number() OVER (PARTITION BY anchor, positive ORDER BY ns DESC, negative) AS rank FROM n) WHERE rank <= 3""")
def op12_hard_negatives(spark, sf):
    return hard_negatives.mine(_read(spark, sf, "embeddings"))


@checked(r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM s)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
sub AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS top
 FROM (SELECT lang, w, a, k, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY 1, 2),
ends AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (SELECT e.lang, e.phrase, e.a, e.j, l.a AS l, r.a AS r, ((2000000::HUGEINT * e.a) // (l.a + r.a)) AS score FROM ends e
 JOIN f l ON l.lang = e.lang AND l.phrase = e.lp JOIN f r ON r.lang = e.lang AND r.phrase = e.rp),
b AS (SELECT lang, phrase, a, l, r, score::BIGINT AS score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS (SELECT b.* FROM b LEFT JOIN sub USING (lang, phrase) WHERE sub.top IS NULL OR 100 * sub.top < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x) JOIN n USING (lang) WHERE rank <= 2000""")
def op13_collocations(spark, sf):
    return collocations.collocations(_read(spark, sf))
