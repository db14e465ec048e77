"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations
from .chat_digest import read_back
from .common import table, written
from .decontaminate import find_leaks
from .fill_middle import fill_in_middle, restored
from .langid import fit, held_out, identify
from .licenses import scan_licenses
from .line_dedup import drop_boilerplate_lines
from .neighbours import near_vectors
from .pii import KINDS, find_personal_data
from .pieces import round_trip
from .quality import judge
from .repair import damaged, diagnose, digests, repair
from .sharding import assign_slots, rendezvous_shard
from .simhash import near_duplicates

SHARDS = 24
#: A public SentencePiece model of this box; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(id AS BIGINT) turn, IF(id = 0, 'user', 'assistant') role,"
        " '</s>[INST] ok [/INST]' text FROM range(2)"
    )
    return read_back(format_conversations(turns.unionByName(planted)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate_lines(docs, F.col("source")).select("doc_id", "text", "n_dropped")


def op3_rendezvous_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), [1.0] * SHARDS).alias("shard"),
        rendezvous_shard(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
    return assign_slots(docs, "shard", "doc_id", [F.col("size"), F.col("text_crc32")]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = [k.name for k in KINDS if k.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k.name) for k in KINDS),
        (F.size("spans") > 0).alias("has_personal_data"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the output takes the place of the text, which is not carried along
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("output"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_in_middle(docs, text_col="output").select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    found = written(diagnose(rows), "repairs")
    texts = digests(repair(rows, found)).select(F.col("conv_id").alias("conv"), "sha256")
    empty = F.sha2(F.lit(b""), 256)
    return found.join(texts, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", empty).alias("repaired_sha256")
    )


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_line_dedup, op3_rendezvous_shard, op4_language_id, op5_personal_data, op6_license_scan, op7_quality, op8_decontamination, op9_simhash_dedup, op10_sentencepiece, op11_fill_in_middle, op12_conversation_repair, op13_embedding_dedup)}


FILL_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), f AS (
  SELECT doc_id, t, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), c AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM f
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c"""


def _repair_sql() -> str:
    """The cheapest edits by recursion over each conversation, from its last row back."""
    say = "'{}'".format
    after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    option = lambda cost, edit, rest, rows: f"{{'c': l{rest}.c + {cost}, 'e': '{edit}' || l{rest}.e, 't': list_concat({rows}, l{rest}.t)}}"
    none = "[]::VARCHAR[]"
    used = []
    for state, (role, rest) in after.items():
        ways = [option("2", "D", state, none)]
        ways.append(f"CASE WHEN NOT must_go THEN {option('1 + extra', 'R', rest, f'[{say(role + ":")} || text]')} END")
        ways.append(f"CASE WHEN NOT must_go AND initial = '{role[0]}' THEN {option('extra', 'K', rest, "[role || ':' || text]")} END")
        if state == 0:
            ways.append(f"CASE WHEN NOT must_go AND initial = 's' THEN {option('extra', 'K', 1, "[role || ':' || text]")} END")
        used.append(f"list_min([{', '.join(ways)}]) AS r{state}")
    put = lambda state, rest, role: f"list_min([r{state}, {{'c': r{rest}.c + 5, 'e': 'I' || r{rest}.e, 't': list_concat(['{role}:'], r{rest}.t)}}])"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), t AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(key, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT)) % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM t WHERE kind <> 0
), n AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS ending
  FROM d
), f AS (
  SELECT conv_id, turn, role, text, i, role[1:1] AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN ending = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN ending[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM n
), g AS (
  SELECT conv_id, role, text, i, initial, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM f
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, n AS i, {{'c': 0, 'e': '', 't': {none}}} AS l0, {{'c': 10, 'e': 'II', 't': ['user:', 'assistant:']}} AS l1,
    {{'c': 5, 'e': 'I', 't': ['assistant:']}} AS l2, {{'c': 0, 'e': '', 't': {none}}} AS l3
  FROM c
  UNION ALL
  SELECT conv_id, i - 1, {put(0, "x", "user")} AS l0, {put(1, "x", "user")} AS l1, x AS l2, {put(3, "x", "user").replace("rx", "r2")} AS l3
  FROM (
    SELECT *, {put(2, 3, "assistant")} AS x FROM (SELECT dp.conv_id, dp.i, {", ".join(used)} FROM dp JOIN g ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.i = g.i)
  )
), best AS (
  SELECT conv_id, l0.c AS cost, l0.e AS audit, array_to_string(l0.t, chr(10)) AS repaired FROM dp WHERE i = 0
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id""".replace("rx.", "x.")


REPAIR_SQL = _repair_sql()


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": """
WITH l AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line
  FROM documents
), c AS (
  SELECT source, line, count(*) AS n FROM l WHERE source IS NOT NULL GROUP BY source, line HAVING count(*) > 1
), b AS (
  SELECT c.source, list(c.line) AS bad FROM c JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) t USING (source)
  WHERE c.n > 0.05::DOUBLE * t.pages GROUP BY c.source
)
SELECT doc_id,
  CASE WHEN bad IS NULL OR text IS NULL THEN text
       ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (trim(x, ' ') <> '' AND list_contains(bad, trim(x, ' ')))), chr(10)) END AS text,
  CASE WHEN bad IS NULL OR text IS NULL THEN 0
       ELSE len(string_split(text, chr(10))) - len(list_filter(string_split(text, chr(10)), lambda x: NOT (trim(x, ' ') <> '' AND list_contains(bad, trim(x, ' '))))) END::BIGINT AS n_dropped
FROM documents LEFT JOIN b USING (source)""",
        "op11_fill_in_middle": FILL_SQL,
        "op12_conversation_repair": REPAIR_SQL,
    }
