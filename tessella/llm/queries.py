"""One query for each training-data operator, over whole tables with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, merkle, mixing, near_dedup, pieces, spelling, substring, token_binary, topk, toxicity
from .common import table
from .merkle_sql import manifest
from .ngram_join import jaccard_components


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.written_and_read(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end=2)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


#: Fields of the records that conversations are written as, by conv_id modulo 3: the list, its roles, its texts.
RECORDS = (("messages", "role", "content"), ("conversations", "from", "value"), ("messages", "role", "text"))


def _message(role: str, text: str):
    def made(turn):
        name = turn["role"]
        if role == "from":
            name = F.when(name == "user", "human").when(name == "assistant", "gpt").otherwise(name)
        return F.struct(name.alias(role), turn["text"].alias(text))

    return made


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one with backslashes, as JSON records of three layouts, told apart again by their fingerprints."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(-8, 0, "user", r"a\b \\ </turn>"), (-8, 1, "assistant", r'\### "x" \n')], rows.schema))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    as_json = F.lit(None).cast("string")
    for k, (field, role, text) in enumerate(RECORDS):
        listed = F.transform("turns", _message(role, text))
        as_json = F.when(F.pmod("conv_id", F.lit(3)) == k, F.to_json(F.struct(listed.alias(field), F.struct("conv_id").alias("about")))).otherwise(as_json)
    return chat.record_digests(turns.select("conv_id", as_json.alias("record")))


#: Half of the tokens, more than half of them English and four fifths prose; the rest by tokens to the power 0.7.
MIXTURE = mixing.Targets(share=0.5, power=0.7, weights={"lang": {"en": 0.55}, "topic": {mixing.PROSE: 0.8}})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), MIXTURE)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_|chat_records", name)}


SQL = {
    "op11_spelling_variants": r"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
        ), each AS (SELECT id, run, count(*) AS k, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY 1, 2),
        hashed AS (
            SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)),
                                           lambda s, c: xor(t[(xor(s, c) & 255) + 1], s >> 8)), 4294967295) AS h FROM each, crc
        ), printed AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
        ), words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM printed WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
        cut AS (SELECT DISTINCT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
        longer AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.rest),
        pairs AS (SELECT a, b FROM longer UNION ALL SELECT b, a FROM longer UNION ALL SELECT x.word, y.word FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
        near AS (SELECT a AS word, count(*) AS n_near, arg_min({'w': b, 'n': n}, {'n': -n, 'w': encode(b)}) AS best FROM pairs JOIN words ON word = b GROUP BY 1),
        forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * n THEN best END AS form FROM words w LEFT JOIN near ON near.word = w.word),
        way AS (SELECT word, word AS last, 0 AS step FROM words UNION ALL SELECT way.word, form.w, step + 1 FROM way JOIN forms ON forms.word = way.last WHERE form IS NOT NULL)
        SELECT f.word, form.w AS form, root, n, n_near, form.n AS form_n FROM forms f JOIN (SELECT word, arg_max(last, step) AS root FROM way GROUP BY 1) r ON r.word = f.word""",
    "op12_merkle_manifest": manifest(),
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        ends AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        c AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT c.node, ends.y FROM c JOIN ends ON c.reach = ends.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.reach) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id GROUP BY d.doc_id""",
    "op7_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), shown AS (
            SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                      ELSE '=' || replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ':', '\;') END AS heading,
                   replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS body FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(heading) + length(body) + 14) AS BIGINT) AS formatted_chars
        FROM shown GROUP BY conv_id""",
    "chat_records": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -8, 0, 'user', 'a\b \\ </turn>' UNION ALL SELECT -8, 1, 'assistant', '\### "x" \n'
        ),
        shown AS (
            SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                      ELSE '=' || replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ':', '\;') END AS heading,
                   replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS body FROM rows
        )
        SELECT conv_id, CASE (conv_id % 3 + 3) % 3 WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' ELSE 'messages_text' END AS layout, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(heading) + length(body) + 14) AS BIGINT) AS formatted_chars
        FROM shown GROUP BY conv_id""",
    "op13_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                                WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS df FROM s GROUP BY 1) f USING (g)),
        p AS (SELECT doc_id, g, n FROM r WHERE k <= n - (n * 80 + 99) // 100 + 1),
        c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        i AS (SELECT x, y, any_value(nx) AS nx, any_value(ny) AS ny, count(*) AS k FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.g = a.g GROUP BY 1, 2),
        e AS (SELECT x, y FROM i WHERE 100 * k >= 80 * (nx + ny - k)),
        ends AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        t AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT t.node, ends.y FROM t JOIN ends ON t.reach = ends.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(t.reach) AS component_id, d.doc_id = min(t.reach) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN t ON t.node = d.doc_id GROUP BY d.doc_id""",
    "op6_exact_top_k": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
