"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fleetlens.llm import license_scan as licenses
from fleetlens.llm import fill_middle, graph_search, language_id, mixing, near_dup, packing, quality, range_join, sharded_lloyd
from fleetlens.llm import toxicity, warc
from fleetlens.llm import token_counts as counts
from fleetlens.llm.common import table
from fleetlens.llm.registry import ORACLES, QUERIES, bound
from fleetlens.llm.sampling import fold
from fleetlens.session import scratch_folder

__all__ = ["ORACLES", "QUERIES"]


@bound("op1_pack_documents")
def pack_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@bound(
    "op2_near_documents",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    sets AS MATERIALIZED (
      SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
      FROM w),
    copies AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
    shingles AS MATERIALIZED (SELECT rep, len(s) AS n, unnest(s) AS shingle FROM copies),
    common AS (
      SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS n
      FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rep < b.rep
        AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep),
    links AS MATERIALIZED (
      SELECT a, b FROM common WHERE 100 * n >= 85 * (n_a + n_b - n)
      UNION ALL SELECT b, a FROM common WHERE 100 * n >= 85 * (n_a + n_b - n)),
    reach(rep, id) AS (SELECT rep, rep FROM copies UNION SELECT reach.rep, links.b FROM reach JOIN links ON reach.id = links.a),
    low AS (SELECT rep, min(id) AS component FROM reach GROUP BY rep)
    SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id,
      d.doc_id = coalesce(l.component, d.doc_id) AS kept
    FROM sets d LEFT JOIN copies c ON len(d.s) > 0 AND c.s = list_sort(d.s) LEFT JOIN low l ON l.rep = c.rep
    """,
)
def near_documents(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@bound("op3_quality")
def quality_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@bound("op4_token_counts")
def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@bound("op5_nearest_vectors")
def nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = graph_search.nearest(vectors, F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


@bound("op6_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "offending",
    )


@bound(
    "op7_warc_round_trip",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
    l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
    FROM l
    """,
)
def warc_round_trip(spark, sf_dir):
    folder = scratch_folder(spark, "warc")
    warc.write_warc(warc.captures(table(spark, sf_dir, "pages")), folder)
    read = warc.with_originals(warc.assemble(spark, folder))
    # bytes and digest are those of the payload that was read: a revisit's is its original's
    return read.select(
        warc.field("page-id").cast("long").alias("page_id"),
        F.coalesce("block_bytes", "original.block_bytes").alias("payload_bytes"),
        F.coalesce("block_digest", "original.block_digest").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        warc.field("page-id", "original.metadata").cast("long").alias("refers_to"),
    )


@bound(
    "op8_near_vectors",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(vec_id, id) AS (
      SELECT vec_id, vec_id FROM embeddings
      UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.id = links.a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.low AS component_id, e.vec_id = r.low AS kept
    FROM embeddings e
    JOIN (SELECT vec_id, min(id) AS low FROM reach GROUP BY vec_id) r USING (vec_id)
    LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) n USING (vec_id)
    """,
)
def near_vectors(spark, sf_dir):
    found = range_join.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


@bound(
    "op9_source_mix",
    r"""
    WITH d AS (
      SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        ('0x' || md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), text))[1:15])::BIGINT AS h
      FROM documents),
    s AS (
      SELECT k, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY k),
    caps AS (
      SELECT *, 2.0::DOUBLE * n AS cap, 1.5::DOUBLE * sum(n) OVER () AS total,
        coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2.0::DOUBLE * n / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM s),
    level AS (SELECT arg_min((total - before) / rest, (cap / w, k)) AS level FROM caps WHERE cap / w > (total - before) / rest),
    targets AS (SELECT k, n, coalesce(least(cap, level * w), cap) AS target FROM caps, level),
    placed AS (
      SELECT d.doc_id, size, n, target, floor(target)::BIGINT AS goal, coalesce(sum(size) OVER (
        PARTITION BY d.k ORDER BY h % 1024, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
      FROM d JOIN targets t ON t.k = d.k)
    SELECT doc_id, size, n AS source_size, round(target, 6) AS target,
      CASE WHEN n = 0 THEN 0 ELSE goal // n * size + greatest(0, least(size, goal % n - place)) END AS taken
    FROM placed
    """,
)
def source_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(mixed).drop("source").withColumn("target", F.round("target", 6))


def _license_sql() -> str:
    """Words, base places, and the rule of labels: rare words that agree on a beginning, then the key phrase."""
    spans = [(n, t, *licenses._spans(t)) for n, t in enumerate(licenses.TEMPLATES)]
    templates = ", ".join(f"({n}, '{t.label}', {t.base}, {words}, {key}, {at})" for n, t, words, key, at in spans)
    return rf"""
    WITH t(template, label, base, words, key, key_at) AS (VALUES {templates}),
    d AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM documents),
    slots AS (SELECT template, base, len(words) AS n, len(key) AS n_key, key_at, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM t),
    hits AS MATERIALIZED (
      SELECT doc_id, word, i AS at FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d)
      WHERE word IN (SELECT word FROM slots)),
    often AS (SELECT word, count(DISTINCT doc_id) AS n FROM hits GROUP BY word),
    rarity AS (
      SELECT w.word, ((SELECT coalesce(max(n), 0) FROM often) + 1)::DOUBLE / (coalesce(o.n, 0) + 1) AS r
      FROM (SELECT DISTINCT word FROM slots) w LEFT JOIN often o ON o.word = w.word),
    ranked AS (
      SELECT s.*, r.r, i >= key_at AND i < key_at + n_key AS in_key,
        row_number() OVER (PARTITION BY template ORDER BY r.r DESC, i) AS any_rank,
        row_number() OVER (PARTITION BY template, i >= key_at AND i < key_at + n_key ORDER BY r.r DESC, i) AS own_rank
      FROM slots s JOIN rarity r ON r.word = s.word),
    indexed AS (
      SELECT *, count(*) OVER (PARTITION BY template) AS n_indexed, count(*) FILTER (in_key) OVER (PARTITION BY template) AS n_in_key
      FROM ranked WHERE (in_key AND own_rank <= (n_key + 1) // 2) OR (NOT base AND any_rank <= (n + 1) // 2)),
    aligned AS (
      SELECT h.doc_id, x.template, h.at - x.i AS b, count(*) AS agreeing, any_value(n_indexed) AS n_indexed, sum(x.r) AS mass
      FROM hits h JOIN indexed x ON x.word = h.word GROUP BY ALL
      HAVING count(*) >= any_value(greatest(1, least(n_in_key, (50 * n_indexed + 99) // 100)))),
    whole AS (SELECT template, sum(r) AS r FROM ranked GROUP BY template),
    places AS (
      SELECT a.doc_id, t.label, t.base, a.b + t.key_at AS start,
        CASE WHEN agreeing = n_indexed THEN 1.0 ELSE mass / whole.r END AS share
      FROM aligned a JOIN t ON t.template = a.template JOIN whole ON whole.template = a.template JOIN d ON d.doc_id = a.doc_id
      WHERE a.b + t.key_at >= 0 AND d.words[a.b + t.key_at + 1:a.b + t.key_at + len(t.key)] = t.key)
    SELECT d.doc_id, len(any_value(d.words)) AS n_words, count(*) FILTER (p.base) AS n_base,
      min(p.start) FILTER (p.base) AS first_word, max(p.start) FILTER (p.base) AS last_word,
      coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (p.base), '') AS base_labels,
      coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label), '') AS labels, coalesce(round(max(p.share)::DOUBLE, 9), 0) AS score
    FROM d LEFT JOIN places p ON p.doc_id = d.doc_id GROUP BY d.doc_id
    """


@bound("op10_license_scan", _license_sql())
def license_scan(spark, sf_dir):
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 9))


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round as two tables: the vectors with their centroid, and the centroids after it."""
    away = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"

    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (
      SELECT vec_id, e, near.cluster, near.d FROM (
        SELECT v.vec_id, any_value(v.e) AS e, min({{'d': {away}, 'cluster': c.cluster}}) AS near
        FROM v CROSS JOIN c{n} c GROUP BY v.vec_id))"""

    def moved(n: int) -> str:
        return f"""c{n + 1} AS MATERIALIZED (
      SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (
        SELECT cluster, list(mean ORDER BY place) AS e FROM (
          SELECT cluster, place, ((s - ((s % n) + n) % n) // n)::BIGINT AS mean FROM (
            SELECT cluster, place, sum(x)::BIGINT AS s, count(*) AS n
            FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM a{n}) GROUP BY cluster, place))
        GROUP BY cluster) m ON m.cluster = c.cluster)"""

    steps = ",\n    ".join(f"{assigned(n)},\n    {moved(n)}" for n in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (
      SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, e
      FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})),
    {steps},
    {assigned(rounds)}
    SELECT a.vec_id, a.cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
      (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
    """


@bound("op11_centroid_clusters", _lloyd_sql())
def centroid_clusters(spark, sf_dir):
    return sharded_lloyd.lloyd(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@bound(
    "op12_fill_middle",
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
    u AS (
      SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || h[1:8])::BIGINT AS h1,
        ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
      FROM d),
    f AS (
      SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
        greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
          THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM u),
    p AS (
      SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
        array_to_string(lines[b + 1:], '') AS suffix
      FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(prefix || middle || suffix) AS restored_sha256
    FROM p
    """,
)
def fill_in_middle(spark, sf_dir):
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("output"), F.col("form")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(output, form), 256).alias("restored_sha256"),
    )


@bound("op13_language_id")
def language_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    # a text that is rejected still has a nearest language, which is what is asked for here
    return language_id.identify(docs.drop("lang"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"),
        F.col("lang_score").alias("score"), "rejected",
    )
