"""Registered queries of this subpackage, each over its whole table, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import langid, merkle, privacy, quality
from chalkline.llm.exact import exact_dedup
from chalkline.llm.leaks import find_leaks
from chalkline.llm.mixing import mix_sources
from chalkline.llm.packing import pack_documents
from chalkline.llm.repeats import remove_repeats
from chalkline.llm.similar import similar_documents
from chalkline.llm.trie import prefix_trie
from chalkline.llm.warc import read_archives, shared_folder, write_archives
from chalkline.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = " ".join(sql.split())
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op3_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@query("op2_mix_sources")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


@query(
    "op9_warc_bundles",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head,
                     sha1(coalesce(html, '')) AS x FROM pages)
       SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
              array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
              CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
              CASE WHEN page_id <> head THEN head END AS refers_to
       FROM p""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    index = write_archives(table(spark, folder, "pages"), shared_folder(spark, "warc"))
    return read_archives(index).drop("url")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(langid.fifth("doc_id") == 0, F.lit(False))
    model = langid.train(docs.where(langid.fifth("doc_id") != 0))
    return langid.identify(docs, model).withColumn("held_out", held_out)


@query("op7_private_data")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.digest(privacy.find_private(table(spark, folder, "documents")))


@query("op5_merkle_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, folder, "documents"))


@query(
    "op8_remove_repeats",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20),
             g AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 19], ' ')) AS k FROM s),
             f AS (SELECT k, min(ROW(doc_id, p)) AS head FROM g GROUP BY k),
             gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM g JOIN f USING (k) WHERE ROW(doc_id, p) > head),
             x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
             kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


@query(
    "op10_similar_documents",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0),
             s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS x FROM g),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
             link AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
             r AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(table(spark, folder, "documents"), words=4, num=85, den=100)


@query("op1_quality_perplexity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, folder, "labels"))
    return quality.judge_quality(table(spark, folder, "documents"), trusted)


@query(
    "op11_prefix_trie",
    r"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             own AS (SELECT conv_id, list(struct_pack(role := role, text := text)
                       ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS ts FROM t GROUP BY conv_id),
             h AS (SELECT conv_id, ts, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))),
                       4294967295) % 4)::INT AS h FROM own),
             re AS (SELECT c.conv_id, list_concat(coalesce(p.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM h c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 20),
             m AS (SELECT conv_id, len(ts) AS l, unnest(range(len(ts) + 1)) AS d, ts FROM re),
             n AS (SELECT ts[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(ts[d]['text']) AS last,
                     coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '') AS ends FROM m GROUP BY ALL),
             kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
             f AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
                     CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(last, '[^\x20\x09-\x0D]+')) END AS s FROM n LEFT JOIN kids USING (k, d)),
             up AS (SELECT k, s, n_children, unnest(range(d + 1)) AS a FROM f),
             sub AS (SELECT k[1:a] AS k, a AS d, sum(s)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
        SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN sub ON sub.k = f.k AND sub.d = f.d LEFT JOIN n p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


@query("op12_whiten_embeddings")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


@query(
    "op13_benchmark_leaks",
    r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
             i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
             p AS (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 8, 2))) AS s FROM i WHERE len(ws) > 0),
             w AS (SELECT DISTINCT item, k, array_to_string(ws[s:s + k - 1], ' ') AS x FROM p),
             g AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k),
             o AS (SELECT r, s, k, item FROM (SELECT r, s, k, array_to_string(ws[s:s + k - 1], ' ') AS x FROM g) JOIN w USING (k, x)),
             hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(s, s + k)) AS j FROM o) GROUP BY r),
             its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
               hit.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN its ON its.r = d.r""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
