"""The registered queries of this folder, and their expected results as DuckDB SQL."""

from __future__ import annotations

import json
import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import alignment, ann, chat, embedding_dups, exact, language, merkle, mixing, pieces, shards, simhash, token_counts, toxicity
from alertloom.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# Vocabulary of the token count and of the encoding; a file outside this repository.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), PIECES)


# What conversation -1 says, in both of its turns.
TRICKY = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one layout, and a conversation of another, through the same mappings; read back from the formatted turns.

    The table's columns are not packed into JSON, whose parser refuses long texts.
    """
    rows = table(spark, sf_dir, "conversations")
    single = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("place"), "role", "text")
    messages = [{"role": role, "content": TRICKY} for role in ("user", "assistant")]
    more = spark.createDataFrame([(-1, 0, json.dumps({"messages": messages}))], "conv_id bigint, place bigint, record string")
    records = chat.canonical_columns(single, ("role", "text")).unionByName(chat.canonical(more))
    turns = chat.turn_rows(records.drop("layout", "problem"))
    found = chat.read_back(chat.rendered(turns))
    return chat.summaries(found, ["place", "within", "role", "text"])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predicted(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"), F.array("source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encoded(docs, PIECES)
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))


def op12_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.agreement(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_permutation_index, op2_token_counts, op3_chat_formatting, op4_sharding, op5_language, op6_exact_dedup, op7_mixing,
        op8_sentencepiece, op9_toxicity, op10_simhash, op11_merkle_manifest, op12_embedding_dups, op13_tokenizer_alignment,
    )
}

_ROLE = "coalesce(CASE lower(role) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END, '')"
_ESCAPES = r"regexp_replace({0}, '([<\[])(\\*(?:\|turn\|>|\|text\|>|/s>|s>|INST\]|/INST\]))', '\1\\\2', 'g')"
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)"


def _draw_sql(rounds: int) -> str:
    """CTEs draw_0, draw_1, ...: each takes what fits of the documents that none before has taken."""
    parts = ["open_1 AS (SELECT d.doc_id, d.source, d.size, d.key, s.rest AS gap FROM d JOIN s USING (source) WHERE d.size > 0)"]
    for k in range(1, rounds + 1):
        parts.append(f"""
            draw_{k} AS (
                SELECT * FROM (
                    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS reached FROM open_{k} WHERE size <= gap
                ) WHERE reached <= gap
            ),
            open_{k + 1} AS (
                SELECT o.doc_id, o.source, o.size, o.key, o.gap - coalesce(g.taken, 0) AS gap
                FROM open_{k} o ANTI JOIN draw_{k} USING (doc_id)
                LEFT JOIN (SELECT source, sum(size) AS taken FROM draw_{k} GROUP BY source) g USING (source)
            )""".replace("FROM open_%d o ANTI JOIN draw_%d USING (doc_id)" % (k, k), f"FROM (SELECT * FROM open_{k} WHERE doc_id NOT IN (SELECT doc_id FROM draw_{k})) o"))
    last = rounds + 1
    parts.append(f"""
        nearer AS (
            SELECT doc_id, size, gap FROM open_{last} WHERE gap > 0
            QUALIFY row_number() OVER (PARTITION BY source ORDER BY size, key) = 1
        ),
        drawn AS (""" + " UNION ALL ".join(f"SELECT doc_id FROM draw_{k}" for k in range(1, last)) + """
            UNION ALL SELECT doc_id FROM nearer WHERE size < 2 * gap
        )""")
    return ",".join(parts)


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_BELOW = "sha256(string_agg(digest, '' ORDER BY place))"
_FOLD = "sha256(CASE WHEN f.place % 2 = 1 THEN coalesce(s.digest, '') || f.digest ELSE f.digest || coalesce(s.digest, '') END)"
# The polynomial of CRC-32, reversed.
_CRC_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"

EXPECTED = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE t AS (
            SELECT list(c ORDER BY i) AS crcs FROM (
                SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {_CRC_STEP}) AS c FROM (SELECT unnest(range(256)) AS i)
            )
        ),
        d AS (
            SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
                CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                        lambda x, y: xor(x >> 8, crcs[(xor(x, y) & 255) + 1])), 4294967295) % 7 = 0
                    THEN {_leaf_sql("n_chars + 1")} END AS bad
            FROM documents, t
        ),
        r AS (
            SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                count(*) OVER (PARTITION BY lang) AS n
            FROM d
        ),
        nodes AS (
            SELECT lang, 0 AS level, place, leaf AS digest, n FROM r
            UNION ALL
            SELECT lang, level + 1, place // 2, {_BELOW}, (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n
        ),
        subroots AS (
            SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
        ),
        tops AS (
            SELECT 0 AS level, place, digest, n FROM subroots
            UNION ALL
            SELECT level + 1, place // 2, {_BELOW}, (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, place // 2, n
        ),
        folds AS (
            SELECT id, lang, 0 AS level, place, coalesce(bad, leaf) AS digest, '' AS siblings, n FROM r
            UNION ALL
            SELECT f.id, f.lang, f.level + 1, f.place // 2, {_FOLD}, f.siblings || coalesce(s.digest, ''), (f.n + 1) // 2
            FROM folds f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.place = xor(f.place, 1)
            WHERE f.n > 1
        ),
        higher AS (
            SELECT f.id, 0 AS level, s.place, f.digest, f.siblings, s.n, s.digest AS subroot
            FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
            UNION ALL
            SELECT f.id, f.level + 1, f.place // 2, {_FOLD}, f.siblings || coalesce(s.digest, ''), (f.n + 1) // 2, f.subroot
            FROM higher f LEFT JOIN tops s ON s.level = f.level AND s.place = xor(f.place, 1)
            WHERE f.n > 1
        )
        SELECT r.doc_id, r.leaf, h.subroot, o.digest AS root, sha256(h.siblings) AS proof_sha256, h.digest AS folded_root, h.digest = o.digest AS verified
        FROM r JOIN higher h USING (id), tops o WHERE h.n = 1 AND o.n = 1
    """,
    "op12_embedding_dups": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dups.THRESHOLD}
        ),
        reach AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.dst FROM reach r JOIN links l ON l.src = r.seen)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.src = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
        FROM embeddings e JOIN (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id) m USING (vec_id)
    """,
    "op6_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS place
            FROM d
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
    """,
    "op3_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, {_ROLE} AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            sum({len(chat.OPEN) + len(chat.ROLE_END) + len(chat.CLOSE)} + length({_ESCAPES.format("role")}) + length({_ESCAPES.format("text")}))::BIGINT
                AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    # Sources stop at twice their size in the order of size by weight: a source stops if its share at that point is
    # above, and shares are those of the first source that does not.
    "op7_mixing": f"""
        WITH d AS (
            SELECT doc_id, coalesce('=' || source, '') AS source, {_SIZE}::BIGINT AS size,
                md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS key
            FROM documents
        ),
        w AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source = '', source) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight
            FROM d GROUP BY source
        ),
        c AS (
            SELECT *, row_number() OVER o AS place,
                3 * sum(source_size) OVER () - 4 * (sum(source_size) OVER o - source_size) AS num,
                sum(weight) OVER () - (sum(weight) OVER o - weight) AS den
            FROM w WINDOW o AS (ORDER BY source_size / weight, source = '', source)
        ),
        f AS (SELECT *, min(place) FILTER (WHERE weight * num <= 4 * den * source_size) OVER () AS first_free FROM c),
        q AS (
            SELECT source, source_size,
                CASE WHEN place < first_free OR first_free IS NULL THEN 2.0 * source_size
                    ELSE (weight * max(num) FILTER (WHERE place = first_free) OVER ())::DOUBLE
                        / (2 * max(den) FILTER (WHERE place = first_free) OVER ())::DOUBLE END AS target
            FROM f
        ),
        s AS (
            SELECT source, source_size, target::DOUBLE AS target,
                CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT // source_size END AS whole,
                CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT % source_size END AS rest
            FROM q
        ),
        {_draw_sql(mixing.ROUNDS)}
        SELECT d.doc_id, d.size, s.source_size, s.target,
            (d.size * (s.whole + CASE WHEN d.doc_id IN (SELECT doc_id FROM drawn) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM d JOIN s USING (source)
    """,
}
