"""The registered queries of the training-data operators, with their SQL where it can say the same."""

from __future__ import annotations


import corpus_pipeline
from tidegauge.llm.decontamination import contaminated
from tidegauge.llm.html_text import page_text
from tidegauge.llm.langid import language
from tidegauge.llm.licenses import license_scan
from tidegauge.llm.mixing import mix
from tidegauge.llm.neighbours import nearest
from tidegauge.llm.periodic import periodic_runs
from tidegauge.llm.sharding import shard
from tidegauge.llm.simhash import near_duplicates
from tidegauge.llm.tokens import token_counts
from tidegauge.llm.toxicity import toxicity
from tidegauge.llm.vector_dedup import near_duplicate_vectors
from tidegauge.llm.whitening import whitened
from tidegauge.plans.catalog import Entry, table

CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        CATALOG[name] = Entry(fn, sql)
        return fn

    return register


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)


@query(
    "op10_source_mix",
    """WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) :: BIGINT AS size
               FROM documents),
    s AS (SELECT source, SUM(size) :: BIGINT AS source_size FROM d GROUP BY 1),
    r AS (SELECT source, source_size, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) :: INT] AS w FROM s),
    p AS (SELECT *, SUM(source_size) OVER () AS total, SUM(w) OVER () AS total_w,
                 coalesce(SUM(source_size) OVER before, 0) AS s_before, coalesce(SUM(w) OVER before, 0) AS w_before
          FROM r WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, 3 * source_size * (total_w - w_before) < (total - 3 * s_before) * w AS capped FROM p),
    t AS (SELECT *, (total - 3 * coalesce(SUM(source_size) FILTER (capped) OVER (), 0)) AS lft,
                 SUM(w) FILTER (NOT capped) OVER () AS lft_w FROM c),
    g AS (SELECT source, source_size, CASE WHEN capped THEN 3 * source_size ELSE (lft * w) :: DOUBLE / lft_w :: DOUBLE END :: DOUBLE AS target FROM t),
    f AS (SELECT *, target - whole * source_size AS want
          FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) :: BIGINT ELSE 0 END AS whole FROM g)),
    x AS (SELECT d.source, size, COUNT(*) AS n, any_value(want) AS want FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
          WHERE size > 0 AND want > 0 GROUP BY 1, 2),
    y AS (SELECT *, (want - coalesce(SUM(n * size) OVER (fall ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) :: DOUBLE) * size
                    >= (SUM(n * size * size) OVER (fall ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) :: DOUBLE AS sure
          FROM x WINDOW fall AS (PARTITION BY source ORDER BY size DESC)),
    z AS (SELECT source, min(size) FILTER (sure) AS certain, any_value(want) - coalesce(SUM(n * size) FILTER (sure), 0) :: DOUBLE AS lft,
                 (SUM(n * size * size) FILTER (NOT sure)) :: DOUBLE AS sq FROM y GROUP BY 1),
    u AS (SELECT doc_id, size, f.source, source_size, target, whole, z.lft AS want,
                 CASE WHEN size > 0 AND size >= certain THEN 1.0 WHEN size > 0 THEN coalesce(z.lft / z.sq * size, 0) ELSE 0 END :: DOUBLE AS pi,
                 (('0x' || substr(sha256('42|' || coalesce(doc_id :: VARCHAR, '') || '|' || coalesce(text, '')), 1, 12)) :: BIGINT + 0.5)
                 / 281474976710656.0 :: DOUBLE AS u
          FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source),
    o AS (SELECT *, CASE WHEN pi > 0 AND pi < 1 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS odds FROM u),
    k AS (SELECT *, floor(odds / (1 + odds) * 281474976710655.0 :: DOUBLE) AS rank FROM o),
    b AS (SELECT *, coalesce(SUM(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, size, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
    h AS (SELECT *, (rank IS NOT NULL AND before + size <= want) AS fits FROM b),
    m AS (SELECT *, want - coalesce(SUM(size) FILTER (fits) OVER (PARTITION BY source), 0) AS gap FROM h),
    n AS (SELECT *, CASE WHEN rank IS NOT NULL AND NOT fits AND abs(size - gap) < gap THEN abs(size - gap) END AS miss FROM m),
    l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss NULLS LAST, rank, size, doc_id) = 1 AND miss IS NOT NULL AS fills FROM n),
    e AS (SELECT *, whole + (fits OR fills OR pi = 1) :: BIGINT AS copies FROM l)
    SELECT doc_id, size, source_size, target, copies, (size * copies) :: BIGINT AS taken, pi AS inclusion FROM e""",
)
def op10_source_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


SHARD_BYTES = 4 << 20


@query(
    "op6_shards",
    f"""WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) :: BIGINT AS n_bytes,
                      ('0x' || substr(md5(coalesce(doc_id :: VARCHAR, '') || '|' || coalesce(text, '')), 1, 15)) :: BIGINT AS hash
               FROM documents),
    a AS (SELECT hash, SUM(n_bytes) AS bytes FROM d GROUP BY 1),
    p AS (SELECT hash, bytes, depth, hash >> (60 - depth) AS prefix FROM a, (SELECT unnest(range(61)) :: INT AS depth)),
    b AS (SELECT depth, prefix, SUM(bytes) AS bytes FROM p GROUP BY 1, 2
          HAVING SUM(bytes) <= {SHARD_BYTES} OR min(hash) = max(hash)),
    f AS (SELECT hash, min(p.depth) AS depth FROM p JOIN b ON p.depth = b.depth AND p.prefix = b.prefix GROUP BY 1),
    r AS (SELECT d.*, f.depth, b.bytes, row_number() OVER (PARTITION BY d.hash ORDER BY doc_id) - 1 AS k,
                 greatest(1, {SHARD_BYTES} // nullif(n_bytes, 0)) AS each,
                 CASE WHEN f.depth > 0 THEN right(lpad(bin(d.hash >> (60 - f.depth)), 60, '0'), f.depth) ELSE '' END AS bits,
                 b.bytes > {SHARD_BYTES} AND b.bytes > n_bytes AS many
          FROM d JOIN f USING (hash) JOIN b ON b.depth = f.depth AND b.prefix = d.hash >> (60 - f.depth))
    SELECT doc_id, n_bytes, depth :: INT AS depth,
           'b' || bits || CASE WHEN many THEN '.' || (k // each) ELSE '' END AS shard,
           CASE WHEN many THEN least(each, bytes // n_bytes - (k // each) * each) * n_bytes ELSE bytes END :: BIGINT AS shard_bytes
    FROM r""",
)
def op6_shards(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    return language(table(spark, sf_dir, "documents"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query("op1_main_text")
def op1_main_text(spark, sf_dir):
    return page_text(table(spark, sf_dir, "pages"))


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"), k=16)


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"))


@query("op13_vector_dedup")
def op13_vector_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)
