"""Registered queries opN_<name> of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import asof, bpe, crosspoly, decontam, maxent, mixing, replies, secrets, simhash, suffix, toxicity, variants, warc
from vellum.llm.common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer_file())


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(docs, secrets.trained(docs))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: What both sides of conversation -7 say.
CONTROL = "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("id")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return replies.conversation_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.document_words(table(spark, sf_dir, "documents")))


def op13_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.matches(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scores": op5_lm_scores,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_chat_format": op11_chat_format,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_asof_join": op13_asof_join,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ESCAPED = "replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: crc32 of a text of ASCII, with the table of its 256 steps in tab.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
_FLOORED = "CASE WHEN h % 2 = 1 THEN us - ((us % 86400000000) + 86400000000) % 86400000000 ELSE us END"

#: The others are beyond SQL (hashes that it lacks, trained models, merges) or too slow in it; tests compare them with brute force, op10's with
#: held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents), items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w
            FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0) AS a),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs JOIN sizes ON len(ws) >= n) AS b),
        occ AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN win ON dw.w = win.w AND dw.n = win.n),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) AS c GROUP BY doc_id),
        itw AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, unnest(ws) AS t FROM items),
        rare AS (SELECT item, t, nth, max(nth) OVER (PARTITION BY item) AS m FROM (SELECT item, itw.t, row_number() OVER (PARTITION BY item ORDER BY n, itw.t) AS nth
            FROM itw JOIN (SELECT t, count(*) AS n FROM itw GROUP BY t) AS f ON itw.t = f.t) AS r WHERE nth <= 3),
        pos AS (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS p FROM docs) AS q WHERE t IN (SELECT t FROM rare)),
        lead_at AS (SELECT item, m, doc_id, p FROM rare JOIN pos ON rare.t = pos.t WHERE nth = 1),
        beside AS (SELECT l.item, l.doc_id, l.p FROM lead_at AS l JOIN rare ON rare.item = l.item AND nth > 1 JOIN pos ON pos.t = rare.t AND pos.doc_id = l.doc_id AND abs(pos.p - l.p) <= 20
            GROUP BY l.item, l.doc_id, l.p, l.m HAVING count(DISTINCT nth) = l.m - 1),
        near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT item, doc_id, p FROM beside UNION ALL SELECT item, doc_id, p FROM lead_at WHERE m = 1) AS n GROUP BY doc_id),
        own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) AS d GROUP BY doc_id)
        SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id LEFT JOIN own ON docs.doc_id = own.doc_id LEFT JOIN near ON docs.doc_id = near.doc_id""",
    "op6_warc_revisits": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
        SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(concat('0x', substr(h, CAST(5 * k // 4 + 1 AS INTEGER), 2)) AS BIGINT) // CAST(pow(2, 3 - 5 * k % 4) AS BIGINT)) % 32) + 1 AS INTEGER), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f ON p.html = f.html""",
    "op7_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op11_chat_format": f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(coalesce(role, ''), chr(10), coalesce(text, ''), chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + length('<turn >') + length('</turn>') + 1) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op13_asof_join": f"""WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        c AS (SELECT click_id, client_id, epoch_us(ts) AS us, {_CRC.format("CAST(click_id AS VARCHAR)")} AS h FROM (SELECT DISTINCT click_id, client_id, ts FROM clicks) AS d, bits),
        s AS (SELECT sale_id, client_id, CAST(floor(100 * total + 0.5) AS BIGINT) AS total_cents, priority, epoch_us(sold_at) AS us, {_CRC.format("CAST(sale_id AS VARCHAR)")} AS h FROM sales, bits),
        o AS (SELECT client_id, {_FLOORED} AS sold, sale_id, priority, total_cents FROM s UNION ALL SELECT client_id, {_FLOORED}, -1 - sale_id, 6 - priority, total_cents FROM s WHERE h % 3 <> 0),
        best AS (SELECT * FROM (SELECT client_id, sold, sale_id, total_cents, row_number() OVER (PARTITION BY client_id, sold ORDER BY priority DESC NULLS LAST, sale_id) AS nth,
            count(*) OVER (PARTITION BY client_id, sold) AS n_tied FROM o WHERE client_id IS NOT NULL AND sold IS NOT NULL) AS b WHERE nth = 1),
        k AS (SELECT click_id, client_id, {_FLOORED} AS ts_us FROM c),
        m AS (SELECT k.click_id, k.client_id, k.ts_us, best.sold, best.sale_id, best.total_cents, best.n_tied, k.ts_us - best.sold <= 259200000000 AS near FROM k ASOF LEFT JOIN best ON k.client_id = best.client_id AND k.ts_us >= best.sold)
        SELECT click_id, client_id, ts_us, CASE WHEN near THEN sale_id END AS sale_id, CASE WHEN near THEN ts_us - sold END AS lag_us, CASE WHEN near THEN total_cents END AS total_cents, CASE WHEN near THEN n_tied ELSE 0 END AS n_tied FROM m""",
}
