"""The registered queries of the training-data operators: each applies its operator to its whole table."""

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import chat, decontaminate, linededup, media, neardup, packing, repeats, sharding, toxicity, warc
from logloom.llm.common import UPPER, Scratch, read_table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, shards=16).hint("rebalance")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hit = decontaminate.n_hit(F.col("hits"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP2_SQL = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM iw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) WHERE len(w) > 0
), keys AS (SELECT DISTINCT n, k FROM win), lens AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hit AS (SELECT occ.* FROM occ JOIN keys USING (n, k)),
hit_words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, n)) AS j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit JOIN win USING (n, k)) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs, "doc_id", "text", *paths).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


#: A conversation of control strings that is formatted with the table's.
HARD_CONVERSATION = [(-7, t, role, "\\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_CONVERSATION, "conv_id long, turn long, role string, text string")
    return digest_examples(chat.format_conversations(turns.unionByName(hard)))


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the examples of a conversation say when they are read back; streams over runs of one conversation."""

    def read(batches):
        rows, fields = [], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)
        for conv, last, learned, chars in runs(batches):
            turns = chat.parse(last)
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            loss = "".join(learned)
            rows.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
            if len(rows) == 5000:
                yield make()
                rows = []
        if rows:
            yield make()

    def runs(batches):
        """Only the last example of a conversation is kept whole: it has all turns."""
        now = None
        for b in batches:
            for conv, _, text, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield now
                    now = (conv, "", [], 0)
                now = (conv, text, [*now[2], chat.unescape(text[start:end])] if start >= 0 else now[2], now[3] + len(text))
        if now is not None:
            yield now

    return examples.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("raw"))
    n = F.length("raw")
    fill = F.greatest(F.lit(64), F.ceil(n / 64).cast("int") * 64) - n
    stored = media.store_samples(docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat("raw", F.unhex(F.repeat(F.lit("00"), fill))).alias("payload")))
    sniffed = media.sniff(stored.drop("payload"))
    whole = F.col("spans")[0]
    read = sniffed.withColumn("payload", media.piece(F.col("media"), whole["body_start"], whole["body_end"]))
    size = F.length("payload")
    kinds = F.array_join(F.transform("spans", lambda s: F.concat(s["type"], F.lit("@"), s["start"].cast("string"), F.lit("+"), (s["end"] - s["start"]).cast("string"))), ";")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 63, F.lit(64))).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", "true_type", F.when(F.col("corrected"), F.lit("corrected")).otherwise(F.lit("declared")), kinds).alias("feature"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents")).hint("rebalance")


#: Cheap on the smaller tables only: it lists all shingles and counts what each pair of documents shares.
OP6_SQL = f"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM dw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM dw UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
SELECT dw.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id, dw.doc_id = least_id AS kept
FROM dw LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmap(F.col("text"), F.col("drops"))
    return linededup.dedup_lines(docs).select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), "n_dropped",
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    ).hint("rebalance")


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT doc_id, pos, line, coalesce(keyed.doc_id > first_doc, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"]).alias("n_shared_words"),
    ).hint("rebalance")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    archives = scratch.table(warc.write_archives(warc.elect(read_table(spark, sf_dir, "pages"))), "monolithic")
    normalised = scratch.table(warc.normalise(archives), "normalised")
    records = warc.read_records(normalised, scratch.table(warc.sidecar(normalised), "sidecar"))
    return records.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"),
    )


QUERIES = {
    "op1_shard": op1_shard, "op2_decontaminate": op2_decontaminate, "op3_pack": op3_pack, "op4_chat": op4_chat, "op5_media": op5_media,
    "op6_near_dedup": op6_near_dedup, "op7_toxicity": op7_toxicity, "op8_line_dedup": op8_line_dedup, "op9_repeats": op9_repeats, "op10_warc": op10_warc,
}
ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op6_near_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL}
