"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.llm import chat
from codeaudit.llm.common import LOWER, UPPER, table
from codeaudit.llm.decontaminate import contained_items
from codeaudit.llm.exact_dedup import dedup_groups
from codeaudit.llm.langid import document_evidence, document_model, identify, page_evidence
from codeaudit.llm.licenses import scan_licenses
from codeaudit.llm.mixing import mixed
from codeaudit.llm.periodic import periodic_runs
from codeaudit.llm.quality import scored, train as train_quality
from codeaudit.llm.simhash import near_duplicates
from codeaudit.llm.tokens import token_counts
from codeaudit.llm.urlfilter import judge, rule_labels, train
from codeaudit.llm.variants import spelling_variants
from codeaudit.llm.warc import archive_and_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op1_warc", """
WITH t AS (SELECT page_id, coalesce(html, '') AS p, url FROM pages),
     k AS (SELECT *, strlen(p) AS payload_bytes, sha1(p) AS payload_digest, max(page_id) OVER (PARTITION BY p) AS top FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to,
       url, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S') AS captured,
       row_number() OVER (PARTITION BY lower(coalesce(regexp_extract(url, '://([^#]*)', 1), '')) ORDER BY page_id) AS history_no
FROM k
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table has no capture times; they are the page's number of seconds into 2024."""
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")), "yyyyMMddHHmmss")
    return archive_and_index(table(spark, sf_dir, "pages").withColumn("captured", when)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "captured", "history_no")


@query("op2_decontaminate", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
     i AS (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
     s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS shingle
           FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
     n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
     widths AS (SELECT DISTINCT k FROM i),
     t AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS shingle
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, widths WHERE len(w) >= k)),
     shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM t JOIN s USING (k, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(floor(log2(n_shingles)) AS INTEGER) AS size_class, n_shingles, n_shared,
       n_shared / n_shingles AS containment
FROM shared JOIN n USING (item_id) WHERE n_shared * 10 >= n_shingles * 8
""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no labels of their own; the trees learn from the urls that the rules decide."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, train(rule_labels(pages, URL_RULES)))


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


CONTROL_TURN = "</s>[INST] ok [/INST]"


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


@query("op6_chat_format", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TURN}'), (-1, 1, 'assistant', '{CONTROL_TURN}')),
     e AS (SELECT *, sha256(text) AS digest, {_sql_escaped('role')} AS r, {_sql_escaped('text')} AS x FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, digest)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, digest) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(x) + {len(chat.TURN + chat.TEXT + chat.END) + 1}) AS formatted_chars
FROM e GROUP BY conv_id
""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_events(chat.conversation_events(rows))
    turns = done.withColumn("turns", chat.read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: chat.unescaped(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (page_id null) and all pages (doc_id null), judged together."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    rows = document_evidence(docs).unionByName(page_evidence(pages), allowMissingColumns=True)
    return identify(rows, document_model(docs), ["doc_id", "page_id"])


@query("op9_exact_dedup", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(table(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), deleted=199)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; where 10 divides the crc32 h of the id, the words from number a on repeat the p words there."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g = F.floor(F.col("h") / 10)
    planted = F.when((F.col("h") % 10 == 0) & (F.size(words) > 0), words)
    cut = (rows.withColumn("w", planted).withColumn("n", F.size("w")).withColumn("a", (g % F.col("n")).cast("int"))
           .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int")))
    tail = F.col("n") - F.col("a")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(tail / F.col("p")).cast("int"))), F.lit(1), tail)
    return cut.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(
        F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # The greatest length, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").cast("double").alias("label"))
    return scored(docs, train_quality(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        "n_passages", "top_passage", "top_weight")
