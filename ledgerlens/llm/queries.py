"""The registered queries over the operators, with production parameters.
Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import alignment, bpe, chat, decontaminate, language, line_dedup, log_bilinear, merkle, ngram_join, pii, quality_rules, rule_ensemble, warc
from ledgerlens.llm.common import materialize, read_table


def word_vocabulary() -> str:
    """Path of the default vocabulary (installed beside the interpreter)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_vocabulary() -> str:
    """Path of the default vocabulary of pieces for many languages."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sha256_hex(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.code(docs, vocabulary or word_vocabulary()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that match an earlier line."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs, count="n_removed")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, base ones counted by kind."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.spans_column("text").alias("pii"))
    base = F.filter("pii", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.KINDS]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{k}") for k, n in zip(pii.KINDS, counts, strict=True)]
    return found.select(
        "doc_id",
        *counts,
        sha256_hex(pii.span_list(base)).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size(base)).cast("long").alias("n_added"),
    )


def held_out(modulus: int, remainder: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def op4_language(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    split = F.coalesce(held_out(4, 2), F.lit(False))
    model = language.fit(docs.where(~split).select("text", "lang"), vocabulary or piece_vocabulary())
    found = docs.select("doc_id", split.alias("held_out"), language.predict_column(spark, model, "text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on which the archive of the pages and a damaged replica disagree."""
    pages = read_table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged_replica(pages))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the weakly supervised verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(quality_rules.statistics(docs), "quality-rules")
    judged = quality_rules.judge(stats)
    failed = quality_rules.base_failed()
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "p_good",
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        sha256_hex(items).alias("items_sha256"), "contaminated",
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and near-duplicate component of every document."""
    found = ngram_join.similar_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    stats = materialize(rule_ensemble.with_statistics(docs), "text-statistics")
    train = labels.where(~held_out(5, 0) & F.col("quality").isin(0, 1)).join(stats, "doc_id")
    model = rule_ensemble.fit(materialize(train, "quality-train"), "quality")
    scored = stats.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= rule_ensemble.THRESHOLD, 1).otherwise(0))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and what a tampered copy folds to."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.sha256_of(merkle.leaf_text(*fields, F.col("text")))
    changed = merkle.sha256_of(merkle.leaf_text(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(held_out(2, 0), changed).otherwise(leaf).alias("tampered"))
    proved = merkle.prove(rows, "source", "doc_id", "leaf")
    folded = proved.withColumn("folded", merkle.fold(F.col("tampered"), F.col("proof")))
    digests = [merkle.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return folded.select(
        "doc_id", *digests, sha256_hex(merkle.proof_text(F.col("proof"))).alias("proof_sha256"),
        merkle.hex_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under unigram counts and the log-bilinear model,
    both learned from those not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(held_out(5, 1), F.lit(False)).alias("held_out"))
    model = log_bilinear.fit(docs.where("NOT held_out"), "text")
    return log_bilinear.score(docs, model, "text", keep=["doc_id", "held_out"])


def byte_vocabulary() -> str:
    """Path of the default byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Groups and links of two tokenizers over every document, links by how many
    documents have their pair."""
    vocab = alignment.vocabularies(spark, a or byte_vocabulary(), b or piece_vocabulary())
    docs = read_table(spark, sf_dir, "documents").select("doc_id", alignment.align_column(vocab, "text").alias("x"))
    digest = F.when(F.col("x.n_a") > 0, sha256_hex(F.col("x.groups"))).otherwise("")
    rows = docs.select("doc_id", "x.n_a", "x.n_b", "x.n_groups", "x.n_links", digest.alias("groups_sha256"), "x.pair_steps", "x.pair_counts")
    rows = materialize(rows, "alignment", compression="zstd")
    table = alignment.pair_table(materialize(alignment.pair_counts(rows, vocab), "alignment-counts"), vocab)
    found = alignment.with_link_counts(rows, vocab, table)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_chat": op5_chat,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_token_alignment": op13_token_alignment,
}

#: Words of whole texts, their 13-word windows (or the whole of a shorter item),
#: windows joined as strings, and the document words that any of them covers.
OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS win FROM (
    SELECT item_id, unnest(CASE WHEN len(w) <= 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) END) AS x
    FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

#: Conversations as lists of distinct rows; a is dropped if it equals the part
#: of another up to a's last turn, and of equal ones all but the smallest id.
OP5_SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -9223372036854775808) AS turn, role, text FROM conversations),
pre AS (
  SELECT DISTINCT conv_id, turn,
         list({'t': turn, 'r': role, 'x': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST)
           OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l
  FROM t),
k AS (SELECT conv_id, turn, len(l) AS n, md5(CAST(list_sort(l) AS VARCHAR)) AS h FROM pre),
whole AS (SELECT conv_id, max(turn) AS turn, max(n) AS n, arg_max(h, turn) AS h FROM k GROUP BY conv_id),
one AS (SELECT n, h, min(conv_id) AS conv_id FROM whole GROUP BY n, h),
longer AS (SELECT DISTINCT k.n, k.h FROM k JOIN whole w ON k.conv_id IS NOT DISTINCT FROM w.conv_id WHERE k.n < w.n),
kept AS (SELECT conv_id, n FROM one WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.n = one.n AND g.h = one.h))
SELECT t.conv_id, t.turn >> 6 AS part, max(kept.n) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                  ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS text
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY t.conv_id, t.turn >> 6
"""

#: Both archives record by record, without a tree.
OP6_SQL = """
WITH a AS (SELECT 0 AS side, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
b AS (
  SELECT 1 AS side, page_id, url,
         CASE page_id % 100 WHEN 1 THEN '~' || substr(html, 2) WHEN 2 THEN substr(html, 1, length(html) // 2) ELSE html END AS html
  FROM a WHERE page_id % 100 IS DISTINCT FROM 3),
c AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT 1, page_id + 1000000000, url, html FROM b WHERE page_id % 100 = 4),
r AS (
  SELECT side, page_id, encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: '
         || CAST(octet_length(encode(html)) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS body
  FROM c),
v AS (SELECT side, page_id, octet_length(body) AS bytes, sha256(body) AS h, count(*) AS copies FROM r GROUP BY ALL),
e AS (SELECT side, page_id, sum(bytes * copies) AS bytes, string_agg(h || ':' || copies, ',' ORDER BY h || ':' || copies) AS versions FROM v GROUP BY side, page_id),
o AS (SELECT *, CAST(floor(page_id / 128) AS BIGINT) AS file,
             CAST(coalesce(sum(bytes) OVER (PARTITION BY side, floor(page_id / 128) ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at
      FROM e),
j AS (
  SELECT coalesce(x.page_id, y.page_id) AS page_id, coalesce(x.file, y.file) AS file, x.at AS offset, y.at AS replica_offset,
         CASE WHEN y.side IS NULL THEN 'missing' WHEN x.side IS NULL THEN 'extra' WHEN x.versions <> y.versions THEN 'changed'
              WHEN x.at <> y.at THEN 'moved' END AS status
  FROM (SELECT * FROM o WHERE side = 0) x FULL JOIN (SELECT * FROM o WHERE side = 1) y ON x.page_id IS NOT DISTINCT FROM y.page_id)
SELECT * FROM j WHERE status IS NOT NULL
"""

#: All pairs that share a shingle, by their intersections; then the smallest id
#: reachable.
OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, hash(list(g ORDER BY g)) AS h FROM s GROUP BY doc_id),
rep AS (SELECT h, min(doc_id) AS r FROM sets GROUP BY h),
one AS (SELECT s.doc_id, s.g FROM s JOIN rep ON s.doc_id = rep.r),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link UNION SELECT r, r FROM rep),
reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (h) LEFT JOIN comp ON comp.x = rep.r
"""

#: Distinct word sets of lines, their pairs by common words, and the lines that
#: match an earlier one (by document, then line).
OP2_SQL = """
WITH l AS (
  SELECT doc_id, i, x, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS s
  FROM (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))),
big AS (SELECT doc_id, i, s FROM l WHERE len(s) >= 1),
c AS (SELECT row_number() OVER (ORDER BY min((doc_id, i))) AS k, s, len(s) AS n, min((doc_id, i)) AS head FROM big GROUP BY s),
w AS (SELECT k, n, unnest(s) AS w FROM c),
f AS (SELECT w, count(*) AS df FROM w GROUP BY w),
o AS (SELECT k, n, w.w, row_number() OVER (PARTITION BY k ORDER BY df, w.w) AS p FROM w JOIN f USING (w)),
pre AS (SELECT k, n, w FROM o WHERE p <= n - CAST(ceil(n * 80 / 100.0) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.k AS x, b.k AS y FROM pre a JOIN pre b ON a.w = b.w AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
hit AS (SELECT y FROM cand JOIN c p ON p.k = x JOIN c q ON q.k = y WHERE 180 * len(list_intersect(p.s, q.s)) >= 80 * (p.n + q.n)),
gone AS (SELECT doc_id, i FROM big JOIN c USING (s) WHERE k IN (SELECT y FROM hit) OR (doc_id, i) <> head)
SELECT d.doc_id, coalesce(t.text, d.text) AS text, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN (
  SELECT l.doc_id, coalesce(string_agg(CASE WHEN g.i IS NULL THEN x END, chr(10) ORDER BY l.i), '') AS text, count(g.i) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id) t ON d.doc_id = t.doc_id
"""

ORACLE: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op9_ngram_join": OP9_SQL,
    "op5_chat": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_decontamination": OP8_SQL,
}
