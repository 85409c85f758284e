"""The thin queries over the given tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, decontaminate, exact, language, mixing, pages, pii, secrets, simhash, substrings, suffixes, variants, whiten
from .common import read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.of_documents(read(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("long"))
    web = language.of_pages(read(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long"))
    return language.identify(docs.unionByName(web))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, counts=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.neighbours(read(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whitened(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_language, op2_suffix_array, op3_pages, op4_pii, op5_simhash, op6_decontamination, op7_substrings, op8_secrets, op9_mixing, op10_fingerprints)
    return {f.__name__: f for f in (*first, op11_variants, op12_whitening, op13_exact)}


#: Every alignment with an equal token, whatever the seeds.
OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS t FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS p FROM d),
bw AS (SELECT item_id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS q FROM b WHERE len(t) >= 5),
eq AS (SELECT doc_id, item_id, n, p - q AS shift, q FROM dw JOIN bw USING (w)),
many AS (SELECT doc_id, item_id, shift, count(*) AS n_equal FROM eq GROUP BY ALL HAVING count(*) >= least(min(n), 10)),
summed AS (SELECT doc_id, item_id, shift, n_equal, n, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS in_window FROM eq JOIN many USING (doc_id, item_id, shift)),
aligned AS (SELECT doc_id, item_id, shift, n_equal, n AS n_tokens, max(in_window) AS best FROM summed GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_equal AS BIGINT) AS n_equal, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(best AS BIGINT) AS best, CAST(shift AS BIGINT) AS "at"
FROM aligned WHERE best >= CASE WHEN n_tokens < 13 THEN n_tokens ELSE 10 END QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, best DESC, shift) = 1
"""

OP7_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s : s + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w WHERE len(ws) >= 13)),
firsts AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM (SELECT doc_id, s, unnest(range(0, 13)) AS k FROM win JOIN firsts USING (g) WHERE m < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS text FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


#: Bytes as pairs of hexadecimal digits, in pieces, as a place far into a string takes long to find.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
pieces AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 2400) AS h FROM (SELECT *, unnest(range(0, n, 1000)) AS c FROM d)),
win AS (SELECT doc_id, c + i AS s, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, c, h, unnest(range(0, least(1000, n - 199 - c))) AS i FROM pieces)),
hits AS (SELECT doc_id, s FROM win SEMI JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) r USING (g)),
marked AS (SELECT b.doc_id, p, pair, max(s) OVER (PARTITION BY b.doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
 FROM (SELECT doc_id, c + i AS p, substr(h, 2 * i + 1, 2) AS pair FROM (SELECT doc_id, c, h, unnest(range(0, least(1000, n - c))) AS i FROM pieces)) b LEFT JOIN hits ON hits.doc_id = b.doc_id AND s = p),
kept AS (SELECT doc_id, count(CASE WHEN gone THEN 1 END) AS n_removed, count(CASE WHEN gone AND NOT coalesce(before, false) THEN 1 END) AS n_spans, string_agg(CASE WHEN NOT gone THEN pair END, '' ORDER BY p) AS k
 FROM (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM marked) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


#: The checksum by its rule (a table of 256 entries, a step for each byte), then near words through equal rests: a
#: replaced letter leaves what is around it, a deleted one the shorter word.
OP11_SQL = r"""
WITH shift AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(CAST(x AS BIGINT), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, w, n, hex(encode(concat(doc_id, ':', w))) AS h FROM runs WHERE length(w) >= 6),
sums AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST(('0x' || substr(h, i, 2)) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM bytes, shift),
spoilt AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(w, 1, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
 UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (WITH RECURSIVE s AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT s.word, f.form, k + 1 FROM s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, k) AS root FROM s GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN steps USING (word)
"""

OP13_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: the others hash, train, permute by key, parse, decompose or round at random."""
    return {"op2_suffix_array": OP2_SQL, "op6_decontamination": OP6_SQL, "op7_substrings": OP7_SQL, "op11_variants": OP11_SQL, "op13_exact": OP13_SQL}
