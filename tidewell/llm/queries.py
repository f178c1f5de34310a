"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.train_on(docs))


def op2_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op2"), least=0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merge_dropout import digests, encode_pieces

    return digests(encode_pieces(table(spark, sf_dir, "documents"), dropout=0.1, seed=1))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    groups = exact_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), stored=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), stored=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the two labels: 0 of low quality, 1 of high quality but toxic, 2 of high quality.

    ``labels`` has no finer rating. P(grade >= 1), by which texts are selected, is thus of quality alone.
    """
    from . import quality

    docs = table(spark, sf_dir, "documents")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    out = quality.quality(docs, quality.train(docs, ratings))
    return out.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_ge_1"), F.get("tails", F.lit(1)).alias("p_ge_2"), "selected")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op10"), width=4, percent=80)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_forms, word_counts

    scratch = Scratch(spark, "op11")
    words = scratch.table(word_counts(table(spark, sf_dir, "documents"), least_len=7, least_n=2, drop_each=31), "words")
    return spelling_forms(words, scratch, times=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, sha

    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = manifest(docs, Scratch(spark, "op12"), found=found)
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["before"], step["after"])), "")
    return out.select("doc_id", "leaf", "subroot", "root", sha(siblings).alias("proof_sha256"), "folded_root", "verified")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import sha256_hex
    from .line_dedup import without_common_lines

    out = without_common_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op13"), stored=True)
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_vector_near_dedup": op2_vector_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_line_dedup": op13_line_dedup,
}

#: The 256 remainders of the CRC-32 polynomial, as a one-row table.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, y: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc) AS remainders"""


def _crc32(text: str) -> str:
    """DuckDB's SQL for the crc32 of a text of code points below 2048, beside ``_CRC_TABLE``."""
    points = f"list_transform(string_split({text}, ''), lambda s: unicode(s)::BIGINT)"
    utf8 = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {utf8}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf(n_chars: str) -> str:
    one = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    return f"sha256({' || '.join(one(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": f"""
        WITH RECURSIVE run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
             hashed AS (SELECT run, {_crc32("doc_id || ':' || run")} AS h FROM run, {_CRC_TABLE} WHERE length(run) >= 7),
             word AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
             w AS (SELECT word, count(*) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
             cut AS (SELECT word, n, pos, left(word, pos - 1) || substr(word, pos + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) AS u(pos)),
             near AS (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
                      UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT a.word, b.word, b.n FROM w a JOIN cut b ON b.rest = a.word),
             best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS b_n FROM near GROUP BY a),
             form AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * w.n THEN b END AS form, CASE WHEN b_n >= 10 * w.n THEN b_n END AS form_n FROM w LEFT JOIN best USING (word)),
             chain AS (SELECT word, form AS at FROM form WHERE form IS NOT NULL UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.at WHERE form.form IS NOT NULL),
             last AS (SELECT chain.word, chain.at FROM chain JOIN form ON form.word = chain.at WHERE form.form IS NULL)
        SELECT word, form, coalesce(last.at, word) AS root, n, n_near, form_n FROM form LEFT JOIN last USING (word)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE seen AS (SELECT *, CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS found FROM documents, {_CRC_TABLE}),
             hashed AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf("n_chars")} AS leaf, {_leaf("found")} AS now FROM seen),
             leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
             node(g, level, i, n, hash) AS (SELECT g, 0, i, n, leaf FROM leaf
                UNION ALL SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY g, level, i // 2, n),
             sub AS (SELECT g, hash, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
             high(level, i, n, hash) AS (SELECT 0, i, n, hash FROM sub
                UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, n),
             step AS (SELECT doc_id, x.level, CASE WHEN y.hash IS NULL THEN '-' WHEN y.i < x.i THEN '<' || y.hash ELSE '>' || y.hash END AS s
                      FROM leaf JOIN node x ON x.g = leaf.g AND x.i = leaf.i >> x.level AND x.n > 1 LEFT JOIN node y ON y.g = x.g AND y.level = x.level AND y.i = xor(x.i, 1)
                      UNION ALL SELECT doc_id, 100 + x.level, CASE WHEN y.hash IS NULL THEN '-' WHEN y.i < x.i THEN '<' || y.hash ELSE '>' || y.hash END
                      FROM leaf JOIN sub USING (g) JOIN high x ON x.i = sub.i >> x.level AND x.n > 1 LEFT JOIN high y ON y.level = x.level AND y.i = xor(x.i, 1)),
             path AS (SELECT doc_id, list(s ORDER BY level) AS steps FROM step GROUP BY doc_id),
             out AS (SELECT doc_id, leaf, sub.hash AS subroot, (SELECT hash FROM high WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
                     list_reduce(list_prepend(now, coalesce(steps, [])), lambda a, s: CASE s[1] WHEN '<' THEN sha256(s[2:] || a) WHEN '>' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root
                     FROM leaf JOIN sub USING (g) LEFT JOIN path USING (doc_id))
        SELECT *, folded_root = root AS verified FROM out""",
    "op13_line_dedup": r"""
        WITH line AS (SELECT doc_id, pos, split[pos] AS line
                      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents), unnest(range(1, len(split) + 1)) AS u(pos)),
             keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
             common AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> top) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (top IS NULL OR doc_id = top), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM n""",
}
