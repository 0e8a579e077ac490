"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinweave.llm import chat, chunks, decontaminate as decontamination, langid, lexical, packing, perplexity, repeats, simhash, tokenfiles, tokens, toxicity, vectorcodes, warc
from twinweave.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP7_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op7_decontamination", sql=f"""
    WITH d AS (SELECT doc_id, {_OP7_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_OP7_WORDS} AS w FROM benchmark),
    wins AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM wins),
    spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
    found AS (
        SELECT doc_id, p, spots.n AS n, item_id FROM spots JOIN wins ON spots.n = wins.n AND array_to_string(w[p:p + spots.n - 1], ' ') = g),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
    names AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontamination.find_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), size=10, nameless=True)
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", decontamination.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


@query("op2_simhash_balls")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), size=3, half=1)
    return found.select(F.col("id").alias("doc_id"), simhash.hexed(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op6_substring_trees", sql="""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    wins AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
    late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM wins) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM late),
    lists AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
        sha256(CASE WHEN qs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(list_transform(range(1, len(w) + 1),
            lambda i: CASE WHEN list_contains(qs, i) THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL), ' '), '') END) AS kept_sha256
    FROM d LEFT JOIN lists USING (doc_id)""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf, "documents"), size=20)
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_hilbert_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), tokens.path("byte_bpe_50k.json"), spaced=True, width=2048, added=True)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")


@query("op10_warc", sql="""
    WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
    t AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
    SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN coalesce(page_id < top, top IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN coalesce(page_id < top, top IS NOT NULL) THEN top END AS refers_to FROM p LEFT JOIN t ON p.d = t.d""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.write(table(spark, sf, "pages"))
    return warc.read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_token_files")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    index = tokenfiles.write(table(spark, sf, "documents"), tokens.path("word_bpe_49k.json"), spaced=False, added=True)
    return tokenfiles.read(index).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op9_language_rnn")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    found = langid.predict(docs, langid.train(docs, ~held))
    return found.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query("op4_toxicity_instances")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"), ~langid.held_out(F.col("id"), 3, 1))
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_chunk_fingerprints")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.neighbours(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_chat_repair")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    turns = chat.repair(table(spark, sf, "conversations"))
    return turns.select("conv_id", "turn", "role", "new_role", "action", F.array_join("inserted", ",").alias("inserted"), "cost", F.sha2("rendered", 256).alias("rendered_sha256"))


@query("op11_perplexity_rules")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = perplexity.judge(docs, perplexity.train(docs))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "lang", F.exp("nats").alias("perplexity"), F.exp("low").alias("least"), F.exp("high").alias("most"))


_OP12_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_lexical_search", sql=f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP12_TERMS} AS t FROM documents),
    n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
    a AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
    q AS (SELECT DISTINCT item_id, text, unnest({_OP12_TERMS}) AS term FROM benchmark),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), a),
    s AS (SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
        FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), a GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    WHERE rank <= 10""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _nearest_sql(t: int) -> str:
    return f"""a{t} AS (SELECT vec_id, part, s, min({{'d': d, 'e': e}}) AS best FROM (SELECT p.*, e, CAST(list_sum(list_transform(list_zip(s, c),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{t} USING (part)) GROUP BY ALL)"""


def _means_sql(t: int) -> str:
    """Floored means of whole numbers; entries without a part stay."""
    return f"""u{t} AS (SELECT part, e, pos, ((s - ((s % n) + n) % n) // n) AS x FROM (SELECT part, best.e AS e, pos, sum(v)::BIGINT AS s, count(*) AS n
        FROM (SELECT part, best, unnest(s) AS v, unnest(range(len(s))) AS pos FROM a{t}) GROUP BY ALL)),
    b{t + 1} AS (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{t} b LEFT JOIN (SELECT part, e, list(x ORDER BY pos) AS c FROM u{t} GROUP BY ALL) m USING (part, e))"""


@query("op13_vector_codes", sql=f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS s FROM k, range(16) r(part)),
    b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, s AS c FROM p
        JOIN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64) USING (vec_id)),
    {_nearest_sql(0)}, {_means_sql(0)}, {_nearest_sql(1)}, {_means_sql(1)}, {_nearest_sql(2)},
    done AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
    sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM b2)
    SELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN done USING (vec_id), sha""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, sf, "embeddings"))
    found = vectorcodes.with_label_errors(coded)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


@query("pipeline", sql=corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
