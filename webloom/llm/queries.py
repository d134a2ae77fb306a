"""One query per operator over the given tables, and its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import chunk_dedup, decontaminate, langid, line_dedup, lm_scoring, minhash, packing, prefix_trie, quality, sharding, toxicity, warc, whitening
from webloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every document in 40 shards whose row counts are at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shuffled(table(spark, folder, "documents"), shards=40).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the verdict of the distribution divergence for every document."""
    return quality.assess(table(spark, folder, "documents")).drop("record", "class_distance", "word_distance")


ORACLES["op10_quality_rules"] = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D.,;:!?"()\[\]]+'), lambda x: x <> '') AS terms,
         regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM base),
chars AS (
  SELECT *, translate(bare, '#*$%&|<>', '') AS plain, regexp_replace(translate(bare, '#*$%&|<>', ''), '\p{L}+', '', 'g') AS no_letter FROM tokens),
parts AS (
  SELECT *, regexp_replace(no_letter, '\p{Nd}+', '', 'g') AS no_digit,
         length(regexp_replace(plain, '[^\p{Lu}]+', '', 'g')) AS capitals FROM chars),
classed AS (
  SELECT doc_id, lang, w, lines, terms, bare, plain,
         [length(plain) - length(no_letter) - capitals, capitals, length(no_letter) - length(no_digit), length(text) - length(bare),
          length(no_digit) - length(translate(no_digit, '.,;:!?"''()[]-', '')), length(bare) - length(plain),
          length(translate(no_digit, '.,;:!?"''()[]-', ''))] AS classes
  FROM parts),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS pos, w FROM classed WHERE len(w) > 5),
grams AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, list_slice(w, pos, pos + 4)) AS n FROM windows),
repeated AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM grams, (SELECT unnest(range(0, 5)) AS k) WHERE grams.n > 1 GROUP BY doc_id),
class_sums AS (
  SELECT lang, i, sum(classes[i]) AS n FROM classed, (SELECT unnest(range(1, 8)) AS i) GROUP BY lang, i),
class_shares AS (
  SELECT lang, i, n / greatest(sum(n) OVER (PARTITION BY lang), 1) AS q FROM class_sums),
word_counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(terms) AS word FROM classed) GROUP BY lang, word),
ranked AS (
  SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS q, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM word_counts),
common AS (SELECT * FROM ranked WHERE rank <= 50),
doc_words AS (
  SELECT d.doc_id, c.q, count(*) / any_value(len_terms) AS p
  FROM (SELECT doc_id, lang, len(terms) AS len_terms, unnest(terms) AS word FROM classed) d JOIN common c ON c.lang = d.lang AND c.word = d.word
  GROUP BY d.doc_id, c.word, c.q),
others AS (
  SELECT k.doc_id, 1 - coalesce(c.q, 0) AS q, 1 - coalesce(d.p, 0) AS p
  FROM classed k LEFT JOIN (SELECT lang, sum(q) AS q FROM common GROUP BY lang) c ON c.lang = k.lang
  LEFT JOIN (SELECT doc_id, sum(p) AS p FROM doc_words GROUP BY doc_id) d ON d.doc_id = k.doc_id),
word_bins AS (SELECT * FROM doc_words UNION ALL SELECT * FROM others),
word_distance AS (
  SELECT doc_id, 0.5 + sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) - 0.5 * q) AS d
  FROM word_bins GROUP BY doc_id),
class_bins AS (
  SELECT k.doc_id, s.q, k.classes[s.i] / greatest(list_sum(k.classes), 1) AS p FROM classed k JOIN class_shares s ON s.lang = k.lang),
class_distance AS (
  SELECT doc_id, sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                          + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) AS d
  FROM class_bins GROUP BY doc_id),
counted AS (
  SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars,
         CAST(length(bare) - length(plain) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed
  FROM classed k LEFT JOIN repeated r ON r.doc_id = k.doc_id)
SELECT c.*, NOT (c.base_failed OR (n_words >= 40 AND (sqrt(greatest(x.d, 0)) > 0.25 OR sqrt(greatest(y.d, 0)) > 0.47))) AS kept
FROM counted c LEFT JOIN class_distance x ON x.doc_id = c.doc_id LEFT JOIN word_distance y ON y.doc_id = c.doc_id
"""


@query
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by 85 percent of their three-word shingles."""
    return minhash.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


ORACLES["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS s
    FROM tokens)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id) + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, n.component_id, d.doc_id = n.component_id AS kept
FROM documents d JOIN named n ON n.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 70 percent of a benchmark item, in any order of its parts."""
    return decontaminate.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def byte_bpe() -> tuple[str, str, dict[str, int]]:
    """Rank file, pattern and added tokens of the public byte-level vocabulary; its ids are those of byte_bpe_50k.json."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as ranks, open(public_tokenizers.path("byte_bpe_50k.json")) as whole:
        added = {token["content"]: token["id"] for token in json.load(whole)["added_tokens"]}
        return ranks.read(), public_tokenizers.PATTERN, added


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.packed(packing.pieces(table(spark, folder, "documents"), *byte_bpe()))


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of at least 90 bytes that several documents share."""
    return chunk_dedup.repeated_spans(table(spark, folder, "documents"))


@query
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Lattice and base log probabilities of every document; six sevenths of the documents train."""
    import public_tokenizers

    docs = table(spark, folder, "documents")
    model = lm_scoring.train(docs, *lm_scoring.load_pieces(public_tokenizers.path("piece_bpe_32k.model")), training=lm_scoring.remainder(7) != 2)
    return lm_scoring.score(docs, model, counted=True).select(
        "doc_id", (lm_scoring.remainder(7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to dictionary-compressed archives and read back."""
    return warc.archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '00' AS h FROM pages),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM hashed)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * i // 4 AS INT) + 1, 3) AS INT) >> CAST(7 - (5 * i) % 4 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM owned
"""


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of all documents without repeated and nearly repeated lines."""
    return line_dedup.deduplicate(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLES["op5_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line FROM split WHERE text IS NOT NULL),
firsts AS (
  SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
same_size AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON a.n >= 20 AND a.n = b.n AND a.first < b.first
   AND (substr(a.line, 1, a.n // 2) = substr(b.line, 1, a.n // 2) OR substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2 + 1))
  WHERE len(list_filter(range(1, a.n + 1), lambda i: substr(a.line, i, 1) <> substr(b.line, i, 1))) = 1),
one_more AS (
  SELECT s.line AS short, t.line AS long, s.first AS short_first, t.first AS long_first
  FROM firsts s JOIN firsts t ON s.n >= 20 AND t.n = s.n + 1
   AND (substr(s.line, 1, t.n // 2) = substr(t.line, 1, t.n // 2) OR substr(s.line, t.n // 2) = substr(t.line, t.n // 2 + 1))
  WHERE len(list_filter(range(1, t.n + 1), lambda i: substr(t.line, 1, i - 1) || substr(t.line, i + 1) = s.line)) > 0),
late AS (
  SELECT line FROM same_size UNION SELECT long FROM one_more WHERE short_first < long_first
  UNION SELECT short FROM one_more WHERE long_first < short_first),
marked AS (
  SELECT l.doc_id, l.pos, l.line,
         f.line IS NOT NULL AND ((l.doc_id, l.pos) <> f.first OR l.line IN (SELECT line FROM late)) AS gone
  FROM lines l LEFT JOIN firsts f ON f.line = l.line),
joined AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines,
         count(*) FILTER (WHERE gone) AS n_dropped FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
       CAST(coalesce(j.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(j.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id
"""


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; three quarters of the documents may train."""
    docs = table(spark, folder, "documents")
    held_out = lm_scoring.remainder(4) == 2
    model = langid.train(docs.filter(~held_out))
    return langid.tag(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", F.greatest(F.size("spans") - 1, F.lit(0)).alias("n_switches"))


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; three quarters of the labelled documents may train."""
    docs = table(spark, folder, "documents")
    held_out = lm_scoring.remainder(4) == 2
    model = toxicity.train(docs.filter(~held_out), table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen whitened components of every embedding, fitted on the distinct vectors."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


ORACLES["op13_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS l FROM turns GROUP BY conv_id),
bits AS (
  SELECT o.conv_id, o.l, coalesce(b.l, []) AS lent, CAST(o.conv_id AS VARCHAR) AS s FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
crc AS (
  WITH RECURSIVE step AS (
    SELECT conv_id, s, 1 AS i, 4294967295::BIGINT AS c FROM bits
    UNION ALL
    SELECT conv_id, s, i + 1, list_reduce([xor(c, ascii(substr(s, i, 1))::BIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END) FROM step WHERE i <= length(s))
  SELECT conv_id, xor(c, 4294967295::BIGINT) % 4 AS h FROM step WHERE i = length(s) + 1),
convs AS (SELECT b.conv_id, list_concat(b.lent[1:h], b.l[h + 1:]) AS l FROM bits b JOIN crc USING (conv_id)),
prefixes AS (SELECT conv_id, d, l[1:d] AS k, l[d].text AS last, d = len(l) AS at_end FROM convs, unnest(range(0, len(l) + 1)) AS r(d)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n,
         (count(*) - 1) * coalesce(len(list_filter(regexp_split_to_array(any_value(last), '[ 	-
]+'), lambda x: x <> '')), 0) AS saved,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE at_end), '') AS ends
  FROM prefixes GROUP BY d, k),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
listed AS (SELECT n.*, coalesce(c.n, 0) AS children FROM nodes n LEFT JOIN kids c ON c.k = n.k),
below AS (
  SELECT k[1:a] AS k, sum(saved) AS saved, count(*) FILTER (WHERE children = 0) AS leaves FROM listed, unnest(range(0, d + 1)) AS r(a) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(n.children AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM listed n JOIN below b ON b.k = n.k LEFT JOIN nodes p ON n.d > 0 AND p.k = n.k[1:n.d - 1]
"""
