"""Language identification by Bayesian fusion of four kinds of evidence.

1. Text: a naive Bayes model over hashed byte trigrams (A-Z lower-cased, other
   ASCII as blanks), fitted on a bounded sample of the labelled rows of every
   language, however rare it is.  The mean log-likelihood counts as at most SATURATION trigrams, so that a long text
   outweighs the other evidence without silencing it.
2. Declared language (markup or metadata): how often each declaration comes with
   each language of the text is counted over all rows and smoothed.
3. Address suffix: a country suffix speaks for its language.
4. Host: the posteriors of 1-3 are summed by host, parent domain and suffix
   (grouped aggregation); each level is smoothed by the one above, the suffixes
   by all rows.  A row's own share is taken out of its host before it is judged.

`und`, a uniform model, stands for texts in none of the languages.  A row is
`kept` when its language is not `und` and has at least `least` = 0.5 of the
posterior.

Defined results: a null or empty text gives no text evidence; the other evidence
decides.  A null or unknown declaration gives no evidence; a null host shares the
host ''.  Without a single labelled row nothing is judged: language and posterior
are null and every row is kept.  Repeated rows and rows without ids are judged
like any other.  Empty tables give empty results; other columns do not take part.
Texts are read whole, in pieces of bounded length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import join_checked, row_mark, rows_without, stored

BUCKETS = 1 << 15
# Labelled rows of each language.
SAMPLE_ROWS = 4000
SATURATION = 40.0
HOST_WEIGHT = 10.0
LEAST = 0.5
CHUNK = 1 << 21
UND = "und"
# --- Fixed values: country suffixes and the language they speak for ---------------
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es", "fr": "fr",
    "it": "it", "jp": "ja", "kr": "ko", "nl": "nl", "pl": "pl", "br": "pt", "pt": "pt", "ru": "ru", "tr": "tr",
    "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en",
}
# --- end of fixed values ----------------------------------------------------------
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def trigrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, where each begins, bucket and validity of the trigrams, in chunks of bounded length."""
    raw, at = _buffers(column)
    ends = at[1:][at[1:] > at[:-1]]
    rows = np.flatnonzero(at[1:] > at[:-1])
    begins = at[rows]
    for low in range(0, len(raw) - 2, CHUNK):
        high = min(low + CHUNK, len(raw) - 2)
        u = _FOLD[raw[low: high + 2]].astype(np.uint32)
        mixed = (u[:-2] << np.uint32(16) | u[1:-1] << np.uint32(8) | u[2:]) * np.uint32(2654435761)
        bucket = (mixed >> np.uint32(17)).astype(np.int32)
        valid = (u[:-2] != 32) | (u[1:-1] != 32) | (u[2:] != 32)
        for back in (1, 2):
            cut = ends[np.searchsorted(ends, low + back): np.searchsorted(ends, high + back)] - back - low
            valid[cut] = False
        first = np.searchsorted(begins, low, "right") - 1
        last = np.searchsorted(begins, high, "left")
        yield rows[first:last], np.maximum(begins[first:last] - low, 0), bucket, valid


def fit_text_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray] | None:
    """Languages (und last) and log-likelihood tables from labelled(id, text, lang).

    Every language of a labelled row whose text has a trigram is known.  The sample
    of a language is the rows whose hash falls below sample_rows / all its rows, some
    `sample_rows` of them, and that of the smallest hash; whole texts are used.
    """
    # Without a letter among three bytes there is no trigram to learn from.
    named = labelled.filter((F.col("lang") != UND) & (F.octet_length("text") >= 3) & F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20))
    shares = [(r["lang"], max(int(min(1.0, sample_rows / r["n"]) * (1 << 20)), r["least"] + 1)) for r in
              named.groupBy("lang").agg(F.count("*").alias("n"), F.min(drawn).alias("least")).collect()]
    if not shares:
        return None
    side = F.broadcast(labelled.sparkSession.createDataFrame(shares, "__lang string, __share long"))
    sample = named.join(side, F.col("lang") == F.col("__lang")).filter(drawn < F.col("__share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, begins, bucket, valid in trigrams(batch.column(1)):
                stops = np.append(begins[1:], len(bucket))
                for row, begin, stop in zip(rows, begins, stops):
                    total = totals.setdefault(langs[row], np.zeros(BUCKETS, np.int64))
                    total += np.bincount(bucket[begin:stop][valid[begin:stop]], minlength=BUCKETS)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [total.tobytes()]})

    counted = sample.select("lang", F.col("text").cast("binary").alias("text")).repartition(8).mapInArrow(
        count, "lang string, counts binary").collect()
    counts: dict[str, np.ndarray] = {}
    for row in counted:
        counts[row["lang"]] = counts.get(row["lang"], 0) + np.frombuffer(row["counts"], np.int64)
    languages = sorted(counts)
    smoothed = np.stack([counts[lang] + 0.5 for lang in languages])
    tables = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
    return languages + [UND], np.vstack([tables, np.full(BUCKETS, -math.log(BUCKETS))]).astype(np.float32)


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str]) -> DataFrame:
    """The columns of carry and `score`: the saturated log-likelihood of each row's text per language."""
    tables = model[1]
    n_carry = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, grams = np.zeros((batch.num_rows, len(tables))), np.zeros(batch.num_rows)
            for found, begins, bucket, valid in trigrams(batch.column(n_carry)):
                grams[found] += np.add.reduceat(valid, begins, dtype=np.int64)
                for k, logs in enumerate(tables):
                    sums[found, k] += np.add.reduceat(logs[bucket] * valid, begins, dtype=np.float64)
            n = np.maximum(grams, 1)[:, None]
            score = sums / n * (SATURATION * n / (SATURATION + n)) * (grams > 0)[:, None]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_carry], pa.array(list(score), pa.list_(pa.float64()))], names=[*carry, "score"])

    chosen = rows.select(*carry, F.col("text").cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in carry)
    return chosen.mapInArrow(run, schema + ", score array<double>")


def softmax(scores: Column) -> Column:
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def plus(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, add), arrays)


def _declared_evidence(scored: DataFrame, languages: list[str]) -> Column:
    """log P(declaration | language of the text), counted over all rows, as an array column by `declared`."""
    known = languages[:-1]
    likeliest = F.expr("array_position(score, array_max(score))") - 1
    table = {(r["declared"], r["best"]): r["n"] for r in scored.filter(
        F.col("declared").isin(known) & F.exists("score", lambda x: x != 0)).groupBy(
        "declared", likeliest.alias("best")).agg(F.count("*").alias("n")).collect()}
    none = F.array(*[F.lit(0.0)] * len(languages))
    out = none
    for d in known:
        logs = []
        for k, lang in enumerate(languages):
            # Before any row is counted, a declaration is right nine times of ten, and says nothing about `und`.
            prior = 1 / len(known) if lang == UND else 0.9 if lang == d else 0.1 / max(1, len(known) - 1)
            total = sum(table.get((x, k), 0) for x in known)
            logs.append(math.log((table.get((d, k), 0) + 20 * prior) / (total + 20)))
        out = F.when(F.col("declared") == d, F.array(*map(F.lit, logs))).otherwise(out)
    return out


def _suffix_evidence(languages: list[str]) -> Column:
    known = languages[:-1]
    out = F.array(*[F.lit(0.0)] * len(languages))
    for suffix, spoken in SUFFIX_LANGUAGE.items():
        if spoken in known and len(known) > 1:
            logs = [math.log(1 / len(known) if x == UND else 0.6 if x == spoken else 0.4 / (len(known) - 1)) for x in languages]
            out = F.when(F.col("suffix") == suffix, F.array(*map(F.lit, logs))).otherwise(out)
    return out


def _smoothed(table: DataFrame, above: list[Column], n: int) -> list[Column]:
    total = reduce(add, [F.col(f"c{k}") for k in range(n)])
    return [(F.col(f"c{k}") + HOST_WEIGHT * above[k]) / (total + HOST_WEIGHT) for k in range(n)]


def host_priors(first: DataFrame, n: int) -> DataFrame:
    """host and, per language, the sum h of its posteriors and the prior p of the level above it."""
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]
    hosts = stored(first.groupBy("host", "parent", "suffix").agg(*[F.sum(F.col("post")[k]).alias(f"c{k}") for k in range(n)]))
    parents = stored(hosts.groupBy("parent", "suffix").agg(*sums))
    suffixes = parents.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(*sums).first()
    total = sum(x or 0.0 for x in whole)
    everywhere = [F.lit(((x or 0.0) + 0.1) / (total + 0.1 * n)) for x in whole]
    upper = stored(suffixes.select("suffix", *[c.alias(f"s{k}") for k, c in enumerate(_smoothed(suffixes, everywhere, n))]))
    parents = join_checked(parents, upper, ["suffix"])
    middle = stored(parents.select("parent", "suffix", *[
        c.alias(f"p{k}") for k, c in enumerate(_smoothed(parents, [F.col(f"s{k}") for k in range(n)], n))]))
    return stored(join_checked(hosts, middle, ["parent", "suffix"]).select(
        "host", F.array(*[f"c{k}" for k in range(n)]).alias("h"), F.array(*[f"p{k}" for k in range(n)]).alias("p")))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray] | None, carry: list[str], least: float = LEAST) -> DataFrame:
    """rows(text, declared, host, and the columns of carry) judged.

    Returns the columns of carry, language, posterior, text_language, declared,
    host and kept.
    """
    if model is None:
        return rows.select(*carry, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(None).cast("string").alias("text_language"), "declared",
                           F.coalesce("host", F.lit("")).alias("host"), F.lit(True).alias("kept"))
    languages = model[0]
    n = len(languages)
    names = F.array(*map(F.lit, languages))
    declared = F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), r"^\s*([A-Za-z]{2,3})", 1))
    prepared = rows.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("declared", F.nullif(declared, F.lit("")))
    scored = stored(text_scores(prepared, model, [*carry, "host", "declared"]))
    levels = (scored.withColumn("parent", F.regexp_extract("host", r"^[^.]*\.(.*)$", 1))
              .withColumn("suffix", F.regexp_extract("host", r"\.([^.]*)$", 1)))
    evidence = plus(F.col("score"), _declared_evidence(scored, languages), _suffix_evidence(languages))
    first = stored(levels.withColumn("evidence", evidence).withColumn("post", softmax(F.col("evidence"))))
    judged = join_checked(first.drop("parent", "suffix"), host_priors(first, n), ["host"])
    # The host without this row: h - post, smoothed by the levels above.
    others = F.zip_with("h", "post", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x) - 1
    prior = F.zip_with(others, F.transform("p", lambda x: x * HOST_WEIGHT),
                       lambda a, b: F.log((a + b) / (F.greatest(total, F.lit(0.0)) + HOST_WEIGHT)))
    final = judged.withColumn("final", softmax(plus(F.col("evidence"), prior)))
    best = F.expr("array_position(final, array_max(final))").cast("int")
    said = F.expr("array_position(score, array_max(score))").cast("int")
    return final.select(
        *carry, F.element_at(names, best).alias("language"), F.array_max("final").alias("posterior"),
        F.when(F.exists("score", lambda x: x != 0), F.element_at(names, said)).alias("text_language"), "declared", "host",
        ((best < n) & (F.array_max("final") >= least)).alias("kept"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared and host of pages(page_id, url, html)."""
    html = F.coalesce(pages["html"], F.lit(""))
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    lang = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    host = F.lower(F.regexp_extract(F.coalesce(pages["url"], F.lit("")), r"://([^/?#]*)", 1))
    return pages.select("page_id", plain.alias("text"), F.nullif(lang, F.lit("")).alias("declared"), host.alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, text, declared (the lang column) and host (the source) of docs."""
    return docs.select("doc_id", "text", docs["lang"].alias("declared"), docs["source"].alias("host"))


def document_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS):
    return fit_text_model(docs.select(docs["doc_id"].alias("id"), "text", "lang"), sample_rows)


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the documents whose language is not told.

    A row is known by doc_id and text, so rows that share one of them are judged apart.
    """
    rows = document_evidence(docs).withColumn("mark", row_mark(docs))
    judged = identify(rows, document_model(docs), ["mark"], least)
    return rows_without(docs, stored(judged.filter(~F.col("kept")).select("mark").distinct()))
