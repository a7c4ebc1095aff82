"""The registered queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_digest, scan_licenses

    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op7_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .epsilon import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken_words

    return taken_words(table(spark, sf_dir, "documents"))


def op10_longest_first_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_longest_first

    return shard_longest_first(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_multi_index_hashing": op2_multi_index_hashing,
        "op3_importance_resampling": op3_importance_resampling,
        "op4_language_id": op4_language_id,
        "op5_sum_of_squares_packing": op5_sum_of_squares_packing,
        "op6_url_filter": op6_url_filter,
        "op7_epsilon_grid_join": op7_epsilon_grid_join,
        "op8_minhash_bayes": op8_minhash_bayes,
        "op9_source_mixing": op9_source_mixing,
        "op10_longest_first_sharding": op10_longest_first_sharding,
    }


_COMPONENTS = "re AS (SELECT id, id AS c FROM ids UNION SELECT l.b, re.c FROM re JOIN links l ON re.id = l.a), co AS (SELECT id, min(c) AS component_id FROM re GROUP BY id)"

#: Brute force over all rows, in SQL.
_OP2 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS b FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.b, v.b), lambda p: (p[1] <> p[2])::INT))::BIGINT AS distance FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, vec_id, distance::INT AS distance FROM r WHERE rank <= 10"""

_OP7 = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM ids WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.9), {_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = co.id) AS n_links, component_id, id = component_id AS kept FROM co"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0b\\f\\r]+')"
_OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id), ids AS (SELECT id FROM w),
it AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM it JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * m >= 80 * (p.n + q.n - m)), {_COMPONENTS}
SELECT co.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, co.id = component_id AS kept FROM co LEFT JOIN n ON n.id = co.id"""


def _h(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT)"


_P = 2147483647


def _f(side: str, k: int) -> str:
    """The permutation's round function of a side: a keyed cubic."""
    z = f"(({side} + k{k} % {_P}) % {_P})"
    return f"(({z} * {z} % {_P} * {z} + k{k} // {_P}) % {_P})"


_OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, source IS NULL AS no_src, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+'))::BIGINT AS size, {_h('7', "coalesce(doc_id::VARCHAR, '-')")} % 1024 AS lane FROM documents),
s0 AS (SELECT no_src, src, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2), s1 AS (SELECT *, row_number() OVER (ORDER BY no_src, src) AS nth FROM s0),
s2 AS (SELECT *, [5, 2, 1][(nth - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT no_src, src, source_size, least(cap, coalesce((SELECT level FROM s3 WHERE level <= ratio ORDER BY ratio, nth LIMIT 1), 'inf'::DOUBLE) * weight) AS target, ceil(source_size / 64.0::DOUBLE)::BIGINT AS blocks FROM s3),
s5 AS (SELECT *, least(floor(target * blocks / source_size + 0.5)::BIGINT, 2 * blocks) AS slots, ceil(sqrt(blocks))::BIGINT AS a, ceil(blocks::DOUBLE / a)::BIGINT AS b FROM s4 WHERE source_size > 0),
ps AS (SELECT *, unnest(range((slots - 1) // blocks + 1)) AS pass FROM s5 WHERE slots > 0),
ks AS (SELECT *, {', '.join(f"{_h(chr(39) + 'block' + chr(39), '7', 'no_src', 'src', 'pass', str(k))} AS k{k}" for k in range(4))} FROM ps),
sj AS (SELECT *, unnest(range(least(blocks, slots - pass * blocks))) AS j FROM ks),
wk AS (SELECT no_src, src, pass, blocks, a, b, k0, k1, k2, k3, j, 0 AS turn, j AS y FROM sj
UNION ALL SELECT no_src, src, pass, blocks, a, b, k0, k1, k2, k3, j, turn + 1, l2 * b + r2 FROM (SELECT *, y // b AS l0, y % b AS r0, (l0 + {_f('r0', 0)}) % a AS l1, (r0 + {_f('l1', 1)}) % b AS r1, (l1 + {_f('r1', 2)}) % a AS l2, (r1 + {_f('l2', 3)}) % b AS r2 FROM wk WHERE turn = 0 OR y >= blocks)),
sl AS (SELECT no_src, src, y AS block FROM wk WHERE turn > 0 AND y < blocks),
pl AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY no_src, src ORDER BY lane, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN s4 USING (no_src, src)),
pc AS (SELECT *, unnest(range(pos // 64, (pos + size - 1) // 64 + 1)) AS block FROM pl WHERE size > 0),
tk AS (SELECT doc_id, sum(least(size, (block + 1) * 64 - pos) - greatest(0, block * 64 - pos)) AS got FROM pc JOIN sl USING (no_src, src, block) GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(got, 0)::BIGINT AS taken FROM pl LEFT JOIN tk USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_multi_index_hashing": _OP2, "op7_epsilon_grid_join": _OP7, "op8_minhash_bayes": _OP8, "op9_source_mixing": _OP9}
