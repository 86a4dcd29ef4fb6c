"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm import abuse, ann, conversations, leakage, mixing, ocr, pii, residue, splitter
from lorespark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.pairs(ann.nearest(table(spark, sf_dir, "chunks"), "id", "embedding"))


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the exact neighbours of every chunk whose id is divisible by 100."""
    c = table(spark, sf_dir, "chunks")
    return ann.recall_of(ann.nearest(c, "id", "embedding"), c, "id", "embedding")


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same chunks: the number of exact neighbours, and whether at least nine in ten are found."""
    c = table(spark, sf_dir, "chunks")
    per = ann.recall_per_query(ann.nearest(c, "id", "embedding"), c, "id", "embedding")
    return per.select("id", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("enough"))


QUERIES = {"p1_found": p1_found, "p1_recall": p1_recall, "p1_check": p1_check}
SQL: dict[str, str] = {"p1_check": """
WITH v AS (SELECT id FROM chunks WHERE id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT id, least(10, (SELECT count(*) FROM v) - 1) AS neighbours, true AS enough FROM v WHERE id % 100 = 0"""}


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where(f"words >= {leakage.MIN_WORDS}").select("item_id", "doc_id").distinct()


QUERIES["p8_found"] = p8_found
_WORDS = """regexp_extract_all(replace(lower(regexp_replace({}, '[\\x{{00AD}}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+')"""
SQL["p8_found"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_items),
ds AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
es AS (SELECT item_id, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT item_id, doc_id FROM es JOIN ds USING (s)"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations.conversations(spark, f"{sf_dir}/messages.parquet")
    reasons = F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in ("broken", "empty", "missing_reply")]), lambda x: x.isNotNull())
    return c.select("peer_id", "msg_from", "msg_to", F.explode(reasons).alias("reason")).distinct()


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/messages.parquet"
    kept = conversations.conversations(spark, path).where("not (broken or empty or missing_reply)")
    return conversations.turns(spark, path, kept)


QUERIES |= {"p7_found": p7_found, "p7_turns": p7_turns}
_P7 = """
WITH m AS (
  SELECT *, epoch_us(sent_at) AS us FROM messages WHERE peer_id IS NOT NULL AND vk_msg_id IS NOT NULL),
dated AS (SELECT * FROM m WHERE us IS NOT NULL),
once AS (SELECT peer_id, vk_msg_id, min(us) AS us FROM dated GROUP BY 1, 2),
flagged AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 10800000000 THEN 0 ELSE 1 END AS fresh
  FROM once WINDOW w AS (PARTITION BY peer_id ORDER BY us, vk_msg_id)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY peer_id ORDER BY us, vk_msg_id ROWS UNBOUNDED PRECEDING) AS sid FROM flagged),
facts AS (
  SELECT n.peer_id, n.sid, arg_min(n.vk_msg_id, (n.us, n.vk_msg_id)) AS msg_from, arg_max(n.vk_msg_id, (n.us, n.vk_msg_id)) AS msg_to,
    min(n.vk_msg_id) AS lo, max(n.vk_msg_id) AS hi,
    bool_or(d.sender IS NULL OR trim(d.sender) = '' OR coalesce((d.sender = 'Вы') <> d.is_own, true)) AS broken,
    bool_or(regexp_matches(d.text, '[\\p{L}\\p{N}]')) AS speaks, bool_or(d.is_own) AS any_own, bool_and(coalesce(d.is_own, false)) AS all_own
  FROM numbered n JOIN dated d USING (peer_id, vk_msg_id) GROUP BY 1, 2),
judged AS (
  SELECT f.*, broken OR EXISTS (SELECT 1 FROM m WHERE m.us IS NULL AND m.peer_id = f.peer_id AND m.vk_msg_id BETWEEN f.lo AND f.hi) AS torn FROM facts f)
"""
SQL["p7_found"] = _P7 + """
SELECT peer_id, msg_from, msg_to, 'broken' AS reason FROM judged WHERE torn
UNION SELECT peer_id, msg_from, msg_to, 'empty' FROM judged WHERE NOT speaks
UNION SELECT peer_id, msg_from, msg_to, 'missing_reply' FROM judged WHERE all_own OR NOT any_own"""
SQL["p7_turns"] = _P7 + """
SELECT j.peer_id, j.msg_from, n.vk_msg_id, n.us AS sent_us, CASE WHEN arg_min(d.is_own, d.id) THEN 'own' ELSE 'other' END AS speaker, arg_min(d.text, d.id) AS text
FROM judged j JOIN numbered n USING (peer_id, sid) JOIN dated d USING (peer_id, vk_msg_id)
WHERE NOT torn AND speaks AND any_own AND NOT all_own GROUP BY 1, 2, 3, 4"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("src"), F.col(i).alias("row_id"), F.col(c).alias("text"))
             for t, i, c in (("messages", "id", "text"), ("voice_transcripts", "attachment_id", "transcript"), ("chunks", "id", "text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitter.cuts(_texts(spark, sf_dir), ["src", "row_id"]).select("src", "row_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitter.pieces(_texts(spark, sf_dir), ["src", "row_id"]).drop("h")


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized record: its length, and whether its pieces cover it in order, keep the limit and overlap as asked at most."""
    texts = _texts(spark, sf_dir)
    w = Window.partitionBy("src", "row_id").orderBy("piece")
    p = splitter.pieces(texts, ["src", "row_id"]).withColumn("was", F.lag("end").over(w)).withColumn("size", F.col("end") - F.col("start"))
    kept = (F.length("text") == F.col("size")) & (F.col("size") <= splitter.LIMIT) & (F.col("size") > 0)
    joined = F.coalesce((F.col("start") <= F.col("was")) & (F.col("was") - F.col("start") <= splitter.OVERLAP) & (F.col("end") > F.col("was")), F.col("start") == 0)
    got = p.groupBy("src", "row_id").agg(F.max("end").alias("n_chars"), F.min(kept).alias("fits"), F.min(joined).alias("covered"))
    whole = texts.where(F.length("text") > splitter.OVERSIZED).select("src", "row_id", F.length("text").alias("length"))
    return got.join(whole, ["src", "row_id"], "right").select("src", "row_id", F.col("length").cast("long").alias("n_chars"), "fits", (F.col("covered") & (F.col("n_chars") == F.col("length"))).alias("covered"))


QUERIES |= {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_check": p5_check}
SQL["p5_check"] = """
SELECT 'messages' AS src, id AS row_id, length(text) AS n_chars, true AS fits, true AS covered FROM messages WHERE length(text) > 2600
UNION ALL SELECT 'voice_transcripts', attachment_id, length(transcript), true, true FROM voice_transcripts WHERE length(transcript) > 2600
UNION ALL SELECT 'chunks', id, length(text), true, true FROM chunks WHERE length(text) > 2600"""
SQL["p5_found"] = """
SELECT 'messages' AS src, id AS row_id FROM messages WHERE length(text) > 2600
UNION SELECT 'voice_transcripts', attachment_id FROM voice_transcripts WHERE length(transcript) > 2600
UNION SELECT 'chunks', id FROM chunks WHERE length(text) > 2600"""


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by the exponent at which the weights have the entropy of the targets."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), by="entropy")[1]


def p9_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by the smallest exponent at which no source exceeds its limit."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), by="limit")[1]


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its goal, its documents, and whether the mixture keeps the cap, uses each document at most once a pass, and gives the tokens that the report says."""
    mixture, report = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    per = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.count_distinct("pass").alias("passes"), F.sum("n_tokens").alias("t"))
    got = per.groupBy("source").agg(F.max("uses").alias("most"), F.min(F.col("uses") == F.col("passes")).alias("once"), F.sum("t").alias("t"))
    return report.join(got, "source", "left").select("source", "target_share", "max_repeats", "records", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"), F.coalesce("once", F.lit(True)).alias("once"),
                                                     (F.coalesce("t", F.lit(0)) == F.col("tokens_used")).alias("told"))


SQL["p9_check"] = """
SELECT g.source, target_share, max_repeats, count(d.doc_id) AS records, true AS capped, true AS once, true AS told
FROM mix_targets g LEFT JOIN documents d ON lower(trim(d.source, ' ')) = g.source AND length(d.text) > 0 GROUP BY 1, 2, 3"""
QUERIES |= {"p9_check": p9_check, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_entropy": p9_entropy, "p9_limit": p9_limit}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue.detect(table(spark, sf_dir, "voice_transcripts"), "attachment_id", "transcript")
    return found.where("excluded and attachment_id is not null").select("attachment_id").distinct()


QUERIES |= {"p2_found": p2_found}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.noise(table(spark, sf_dir, "photo_analysis"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repaired(table(spark, sf_dir, "photo_analysis"))


QUERIES |= {"p6_found": p6_found, "p6_repaired": p6_repaired}


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"), keep=("source",))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(_abuse(spark, sf_dir))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).drop("source")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_abuse(spark, sf_dir))


QUERIES |= {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where("src <> 'chunks'")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_records(spark, sf_dir), ["src", "row_id"]).where("row_id is not null").select("src", "row_id", "kind").distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(_records(spark, sf_dir), ["src", "row_id"])


QUERIES |= {"p4_found": p4_found, "p4_masked": p4_masked}
