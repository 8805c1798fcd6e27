"""The operators as registered queries over the supplied tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.llm import bpe, chat, clustering, decontaminate, fim, html_crf, langid, pii, sharding, simhash, token_files, topk, toxicity
from bookflow.llm.common import table

END_ID = 2
PII_KEY = "bookflow-surrogates"       # a deployment passes its own
SHARD_KEY = "bookflow-shards"


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def token_files_query(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf, "documents"), _vocabulary(), END_ID)
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def bpe_query(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), _vocabulary(), ids="", decoded="", keep=["doc_id"])


def simhash_query(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def decontaminate_query(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"),
                                       keep=["doc_id"]).drop("spans")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def langid_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = langid.identify(docs, langid.fit(docs, fold("doc_id", 4) != 2), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"), lambda c: fold(c, 3) != 1)
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def topk_query(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf, "embeddings"), "vec_id", "embedding", 256.0)
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def html_query(spark: SparkSession, sf: str) -> DataFrame:
    return html_crf.extract(table(spark, sf, "pages"), html_crf.train(), keep=["page_id", "url"])


def pii_query(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.replace_entities(table(spark, sf, "documents"), PII_KEY)
    return out.select("doc_id", "lang", "source", "text", F.length("text").cast("bigint").alias("n_chars"), "n_entities")


def chat_query(spark: SparkSession, sf: str) -> DataFrame:
    return chat.render(table(spark, sf, "conversations")).select("conv_id", "turn", "n_turns", "rendered")


def sharding_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = sharding.deal(docs, 8, SHARD_KEY, [docs["doc_id"], F.sha2(docs["text"], 256)])
    data = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def fim_query(spark: SparkSession, sf: str) -> DataFrame:
    out = fim.transform(table(spark, sf, "documents"), keep=["doc_id"]).drop("pieces")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return fim.untransform(out, keep=names).drop("restored")


def clustering_query(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster(table(spark, sf, "embeddings"), 8, 10, "3", keep=["vec_id"])


QUERIES = {
    "op1_pii": pii_query,
    "op2_token_files": token_files_query,
    "op3_langid": langid_query,
    "op4_toxicity": toxicity_query,
    "op5_topk": topk_query,
    "op6_html_crf": html_query,
    "op7_chat": chat_query,
    "op8_bpe": bpe_query,
    "op9_simhash": simhash_query,
    "op10_decontaminate": decontaminate_query,
    "op11_sharding": sharding_query,
    "op12_fim": fim_query,
    "op13_clustering": clustering_query,
}


def _sharding_sql(key: str = SHARD_KEY, shards: int = 8, rounds: int = sharding.ROUNDS) -> str:
    """Rows numbered by id and text, the network's rounds one after the other, the walk as a recursion, crc32 byte by byte."""
    def number(half: str, i: int, base: str) -> str:
        return f"(CAST('0x' || substr(sha256('{key}:{i}:' || {half}), 1, {sharding.HEX}) AS BIGINT) % {base})"

    def network(start: str) -> str:
        steps = [f"SELECT r, a, b, x % a AS lo, x // a AS hi FROM {start}"]
        for i in range(rounds):
            lo, hi = (f"(lo + {number('hi', i, 'a')}) % a", "hi") if i % 2 == 0 else ("lo", f"(hi + {number('lo', i, 'b')}) % b")
            steps.append(f"SELECT r, a, b, {lo} AS lo, {hi} AS hi FROM ({steps[-1]})")
        return f"SELECT r, a, b, hi * a + lo AS x FROM ({steps[-1]})"
    return f"""WITH RECURSIVE n AS (SELECT count(*) AS n, greatest(CAST(ceil(sqrt(count(*))) AS BIGINT), 1) AS a FROM documents),
      d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(text) NULLS FIRST) - 1 AS r FROM documents),
      w AS ({network("(SELECT r, a, (n + a - 1) // a AS b, r AS x FROM d, n)")} UNION ALL
        {network("(SELECT r, a, b, x FROM w WHERE x >= (SELECT n FROM n))")}),
      t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
        lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) AS u(i))),
      c AS (SELECT r, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c FROM d, t)
      SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(xor(c.c, 4294967295) AS BIGINT) AS text_crc32, 'rows' AS law,
        CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
      FROM d JOIN w USING (r) JOIN c USING (r) WHERE x < (SELECT n FROM n)"""


def _clustering_sql(k: int = 8, rounds: int = 10, seed: str = "3") -> str:
    """The rounds one after the other, by plain distances."""
    def assigned(c: str) -> str:
        return f"""(SELECT u, min_by(j, [d, j]) AS j, min(d) AS d FROM (SELECT u, j, CAST(list_sum(list_transform(list_zip(q, m),
          lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {c}) GROUP BY u)"""
    parts = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT q AS m, row_number() OVER (ORDER BY h, q) - 1 AS j FROM (
        SELECT q, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, q LIMIT {k}))"""]
    for n in range(rounds):
        parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT coalesce(f.m, o.m) AS m, j FROM c{n} o LEFT JOIN (SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY p) AS m FROM (
        SELECT j, p, sum(q[p]) AS s, count(*) AS n FROM {assigned(f'c{n}')} JOIN v USING (u), range(1, 65) AS r(p) GROUP BY j, p) GROUP BY j) f USING (j))""")
    return f"""{", ".join(parts)}, e AS MATERIALIZED {assigned(f'c{rounds}')}
      SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
      FROM e JOIN v USING (u) JOIN c{rounds} USING (j)"""


_FIM_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS l,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
      n AS (SELECT doc_id, text, l, len(l) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
          WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
      p AS (SELECT *, coalesce(array_to_string(l[1:least(a, b)], ''), '') AS pre, coalesce(array_to_string(l[least(a, b) + 1:greatest(a, b)], ''), '') AS mid,
        coalesce(array_to_string(l[greatest(a, b) + 1:], ''), '') AS suf FROM n)
      SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
          ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
SQL: dict[str, str] = {
    "op11_sharding": _sharding_sql(),
    "op12_fim": _FIM_SQL,
    "op13_clustering": _clustering_sql(),
    "op7_chat": """WITH c AS (SELECT conv_id, list([role, text] ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
      p AS (SELECT l[1:n] AS l, bool_or(n < len(l)) AS goes_on FROM c, unnest(range(1, len(l) + 1)) AS r(n) GROUP BY 1),
      w AS (SELECT l, min(conv_id) AS conv_id FROM c GROUP BY l),
      k AS (SELECT w.conv_id, CAST(len(w.l) AS BIGINT) AS n_turns FROM w JOIN p USING (l) WHERE NOT goes_on)
      SELECT conv_id, turn, n_turns, '<|im_start|>' || lower(trim(coalesce(role, 'unknown'), ' ')) || chr(10)
        || replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
        || '<|im_end|>' || chr(10) AS rendered FROM conversations JOIN k USING (conv_id)""",
    "op5_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
      SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
