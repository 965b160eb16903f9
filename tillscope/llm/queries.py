"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import (
    bpe,
    centroids,
    decontaminate,
    jaccard,
    language,
    nearest,
    quotes,
    runs,
    secret_scan,
    simhash,
    substrings,
    tokencount,
    toxicity,
)
from tillscope.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    coded = bpe.encode_decode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, what it replies to, and its place in the reply tree."""
    return quotes.reply_paths(quotes.link_quotes(table(spark, sf_dir, "conversations")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by named pattern, and all spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    names = [kind.name for kind in secret_scan.BASE_KINDS]
    return found.select(
        "doc_id",
        *[F.size(secret_scan.of_kinds(spans, n)).cast("long").alias(f"n_{n}") for n in names],
        F.sha2(secret_scan.span_text(secret_scan.of_kinds(spans, *names)), 256).alias("base_sha256"),
        secret_scan.span_text(spans).alias("spans"),
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest neighbours of every 20th vector."""
    return nearest.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokencount.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark passages."""
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).withColumn("n_hit", decontaminate.words_hit(F.col("spans")))
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    held_out = toxicity.bucket(F.col("doc_id"), 5) == 0
    found = language.predict_languages(table(spark, sf_dir, "documents"), learn=~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a repeated passage covers, and a digest of the rest."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three quarters of the labels."""
    part = toxicity.bucket(F.col("doc_id"), 4)
    scored = toxicity.score_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=part != 2
    )
    return scored.select(
        "doc_id",
        F.coalesce(part == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document and the component of its near copies."""
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors around eight centres, exactly, after ten rounds."""
    order = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("long").cast("string")), 256)
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), order)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256")
    )


def planted_loop(seed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loop of a tenth of the texts, by a hash of their id: its first word and its length."""
    g = seed // 10
    begin = g % n
    return begin, np.where(seed % 10 == 0, 1 + (n - begin) // (3 + g % 8), 0)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, loops planted in a tenth of them included."""
    seed = F.crc32(F.col("doc_id").cast("string"))
    found = runs.find_runs(table(spark, sf_dir, "documents"), seed, planted_loop)
    top = runs.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the component of those that differ by few bits."""
    found = simhash.link_near_copies(table(spark, sf_dir, "documents"))
    name = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", name.alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quote_linking": op2_quote_linking,
    "op3_secrets": op3_secrets,
    "op4_nearest": op4_nearest,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_language": op7_language,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_centroids": op11_centroids,
    "op12_runs": op12_runs,
    "op13_simhash": op13_simhash,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _centroids_sql(rounds: int = 10) -> str:
    """One assignment and one move of the centres for each round, then the last assignment."""
    nearest = """
        near{t} AS MATERIALIZED (
            SELECT place, first(vec_id) AS vec_id, first(x) AS x, first(d ORDER BY d, c) AS d, first(c ORDER BY d, c) AS c
            FROM (
                SELECT v.place, v.vec_id, v.x, m.c,
                       list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i]))) AS d
                FROM vectors v, centres{t} m
            ) GROUP BY place
        )"""
    moved = """
        centres{n} AS MATERIALIZED (
            SELECT m.c, coalesce(s.x, m.x) AS x
            FROM centres{t} m LEFT JOIN (
                SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
                FROM (
                    SELECT c, i, sum(v) AS total, count(*) AS n
                    FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{t}) GROUP BY c, i
                ) GROUP BY c
            ) s ON s.c = m.c
        )"""
    steps = [part.format(t=t, n=t + 1) for t in range(rounds) for part in (nearest, moved)] + [nearest.format(t=rounds)]
    return f"""
        WITH vectors AS MATERIALIZED (
            SELECT row_number() OVER () AS place, vec_id,
                   list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
        ),
        centres0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x
            FROM vectors WHERE vec_id IS NOT NULL QUALIFY c < 8
        ),
        {",".join(steps)}
        SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m.x, ',')) AS centroid_sha256
        FROM near{rounds} n JOIN centres{rounds} m ON m.c = n.c
    """


ORACLE_SQL: dict[str, str] = {
    "op11_centroids": _centroids_sql(),
    "op6_decontamination": rf"""
        WITH doc AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ),
        item AS (
            SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE item_id IS NOT NULL
        ),
        places AS (
            SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i
            FROM item WHERE len(w) > 0
        ),
        phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM places),
        starts AS (
            SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
            FROM doc, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n
        ),
        hits AS (
            SELECT doc_id, i, d.n, item_id
            FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM starts) d
            JOIN phrases p ON p.k = d.k AND p.n = d.n
        ),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
        ),
        found AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op8_substring_dedup": r"""
        WITH doc AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM doc WHERE len(w) >= 20)
        ),
        repeats AS (
            SELECT doc_id, i FROM windows
            QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM repeats),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
        )
        SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)
    """,
    "op10_jaccard_join": rf"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k
            FROM (
                SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM doc WHERE len(w) > 0
            )
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT x, y
            FROM (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
                FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
            ) JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
            WHERE 100 * shared >= 85 * (s.n + t.n - shared)
        ),
        reach AS (
            SELECT doc_id, doc_id AS root FROM doc
            UNION
            SELECT y, root FROM reach JOIN links ON x = doc_id
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id
        FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """,
    "op2_quote_linking": r"""
        WITH RECURSIVE messages AS (
            SELECT conv_id AS conv, turn, first(role ORDER BY coalesce(role, ''), coalesce(text, '')) AS role,
                   first(coalesce(text, '') ORDER BY coalesce(role, ''), coalesce(text, '')) AS text
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
        ),
        split AS (
            SELECT conv, turn, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS n
            FROM messages
        ),
        lines AS (
            SELECT conv, turn, n,
                   length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
                   trim(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '\r$', '')) AS body
            FROM split
        ),
        islands AS (
            SELECT *, n - row_number() OVER (PARTITION BY conv, turn, level ORDER BY n) AS island FROM lines
        ),
        passages AS (
            SELECT conv, turn, level, min(n) AS n, string_agg(body, chr(10) ORDER BY n) AS body
            FROM islands GROUP BY conv, turn, level, island HAVING trim(string_agg(body, chr(10) ORDER BY n)) <> ''
        ),
        own AS (
            SELECT conv, turn, string_agg(body, chr(10) ORDER BY n) AS own_text FROM passages WHERE level = 0 GROUP BY ALL
        ),
        parts AS (
            SELECT conv, turn, unnest([own_text] || string_split(own_text, chr(10))
                   || string_split_regex(own_text, '\n\s*\n')) AS part
            FROM own
        ),
        spoken AS (
            SELECT conv, turn, list_filter(list_transform(string_split(own_text, chr(10)),
                   lambda l: trim(regexp_replace(lower(l), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda l: l <> '') AS said
            FROM own
        ),
        sizes AS (
            SELECT DISTINCT conv, len(list_filter(list_transform(string_split(body, chr(10)),
                   lambda l: trim(regexp_replace(lower(l), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda l: l <> '')) AS n
            FROM passages WHERE level > 0
        ),
        runs AS (
            SELECT conv, turn, array_to_string(said[i:i + n - 1], ' ') AS words
            FROM (
                SELECT s.conv, turn, said, n, unnest(generate_series(1, len(said) - n + 1)) AS i
                FROM spoken s JOIN sizes z ON z.conv = s.conv WHERE n > 1 AND len(said) >= n
            )
        ),
        sources AS (
            SELECT conv, words, min(turn) AS source
            FROM (
                SELECT conv, turn, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM parts
                UNION ALL SELECT conv, turn, words FROM runs
            ) GROUP BY ALL HAVING words <> ''
        ),
        found AS (
            SELECT q.conv, q.turn, q.level, s.source
            FROM passages q JOIN sources s
              ON s.conv = q.conv AND s.source < q.turn
             AND s.words = trim(regexp_replace(lower(q.body), '[^\p{L}\p{N}]+', ' ', 'g'))
            WHERE q.level > 0
        ),
        replies AS (
            SELECT m.conv, m.turn, m.role, coalesce(o.own_text, '') AS own_text,
                   (SELECT count(*) FROM passages q WHERE q.conv = m.conv AND q.turn = m.turn AND q.level > 0) AS n_quotes,
                   (SELECT count(*) FROM found f WHERE f.conv = m.conv AND f.turn = m.turn) AS n_linked,
                   coalesce(
                       (SELECT f.source FROM found f WHERE f.conv = m.conv AND f.turn = m.turn
                        ORDER BY f.level, f.source DESC LIMIT 1),
                       lag(m.turn) OVER (PARTITION BY m.conv ORDER BY m.turn)
                   ) AS reply_to
            FROM messages m LEFT JOIN own o ON o.conv = m.conv AND o.turn = m.turn
        ),
        paths AS (
            SELECT conv, turn, turn AS root, 0::BIGINT AS depth FROM replies WHERE reply_to IS NULL
            UNION ALL
            SELECT r.conv, r.turn, p.root, p.depth + 1 FROM replies r
            JOIN paths p ON p.conv = r.conv AND p.turn = r.reply_to
        )
        SELECT r.conv AS conv_id, r.turn, r.role, r.own_text, r.n_quotes, r.n_linked, r.reply_to, p.root, p.depth
        FROM replies r JOIN paths p ON p.conv = r.conv AND p.turn = r.turn
    """,
}
