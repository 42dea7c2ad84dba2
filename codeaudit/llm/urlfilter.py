"""URL filtering: host and path rules, and boosted trees on lexical features for the rest.

Rules are (host, path, verdict).  A rule fits its host and every subdomain when
the url's path starts with the rule's; of several the longest host + path wins,
then the smallest text.  The list is part of the code: each rule is one branch of
one expression.

Urls that no rule decides are judged by gradient-boosted trees.  Features: lengths
of url, host, path and query, path and host depth, digit, letter and other ratios,
entropy of the characters, number of parameters, hyphens, percent signs, longest
label, scheme, and statistics of the suffix (the last host label) and of its
parent domain: how many labelled urls carry it and what smoothed share of them is
blocked, counted by grouped aggregation over all labelled urls.  In training, the
statistics of a url come from the other folds of the labels (with only its own
label left out, they would give it away), and each url is learned once more with
its statistics hidden, for suffixes that no label has.  The trees are fitted on a bounded
sample of labelled rows, some `sample_rows` = 20,000 different ones chosen by the
hash of url and label, in the order of that hash: the model does not depend on
how rows are dealt out.

Defined results: a null url, or one without `://`, has an empty host and path, no
rule fits it, and it is judged by its features like any other.  With no labelled
url, or labels of one kind, there is nothing to learn: the verdict is that kind,
else allow.  Rows that repeat are judged one by one; a null page_id is carried.
Empty tables give empty results; other columns do not take part.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import UPPER, LOWER, join_checked, stored

SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 42
FOLDS = 5
PRIOR_ROWS = 20.0
LEXICAL = ["n_url", "n_host", "n_path", "n_query", "depth", "labels", "digit_ratio", "letter_ratio", "other_ratio", "entropy",
           "params", "hyphens", "percents", "longest_label", "secure", "host_digits"]
STATISTICS = ["suffix_n", "suffix_rate", "domain_n", "domain_rate"]
FEATURES = LEXICAL + STATISTICS


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to / ? # (A-Z lower-cased), then the path up to ? or #."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text (host + path) and the verdict of the rule that wins, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character over letters (any case), each digit as one, and each other ASCII mark."""
    n = F.greatest(F.char_length(text), F.lit(1))
    low = F.lower(text)
    kinds = [F.char_length(low) - F.char_length(F.replace(low, F.lit(c))) for c in "abcdefghijklmnopqrstuvwxyz0123456789-_./?=&%#:"]
    return reduce(add, [F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0) for k in kinds])


def lexical_features(rows: DataFrame) -> DataFrame:
    """Add LEXICAL, suffix and domain to rows(url, host, path)."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1))
    digits = F.char_length(url) - F.char_length(F.regexp_replace(url, "[0-9]", ""))
    letters = F.char_length(url) - F.char_length(F.regexp_replace(url, r"\p{L}", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c)))
    values = {
        "n_url": F.char_length(url), "n_host": F.char_length("host"), "n_path": F.char_length("path"), "n_query": F.char_length(query),
        "depth": F.size(F.array_remove(F.split("path", "/"), "")), "labels": F.size(F.array_remove(F.split("host", r"\."), "")),
        "digit_ratio": digits / n, "letter_ratio": letters / n, "other_ratio": (F.char_length(url) - digits - letters) / n,
        "entropy": _entropy(url), "params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "hyphens": count(F.col("host"), "-"),
        "percents": count(url, "%"), "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.char_length)),
        "secure": F.startswith(F.lower(url), F.lit("https:")).cast("int"),
        "host_digits": F.char_length("host") - F.char_length(F.regexp_replace("host", "[0-9]", "")),
    }
    out = rows.select("*", *[v.cast("double").alias(k) for k, v in values.items()])
    return out.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _statistics(rows: DataFrame, level: str) -> DataFrame:
    """Labelled and blocked urls per value of level: in all, and in each fold."""
    inside = lambda what, f: F.sum(F.when(_fold() == f, what).otherwise(0.0))
    return rows.groupBy(level).agg(
        F.count("*").cast("double").alias(f"{level}_all"), F.sum("blocked").alias(f"{level}_bad"),
        F.array(*[inside(F.lit(1.0), f) for f in range(FOLDS)]).alias(f"{level}_fold_all"),
        F.array(*[inside(F.col("blocked"), f) for f in range(FOLDS)]).alias(f"{level}_fold_bad"))


def _with_statistics(rows: DataFrame, tables: dict[str, DataFrame], overall: float, training: bool) -> DataFrame:
    """Add the smoothed block share and the number of labelled urls per suffix and domain; in training, of the other folds."""
    for level, stats in tables.items():
        rows = join_checked(rows, stats, [level], "left")
        n, bad = (F.coalesce(f"{level}_{x}", F.lit(0.0)) - (
            F.coalesce(F.col(f"{level}_fold_{x}")[_fold()], F.lit(0.0)) if training else F.lit(0.0)) for x in ("all", "bad"))
        rows = rows.withColumn(f"{level}_rate", (bad + PRIOR_ROWS * overall) / (n + PRIOR_ROWS)).withColumn(
            f"{level}_n", F.log1p(n)).drop(*[f"{level}_{x}" for x in ("all", "bad", "fold_all", "fold_bad")])
    return rows


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


class UrlModel:
    """Boosted trees with the suffix statistics they were trained on, or a constant verdict."""

    def __init__(self, trees: GBTClassificationModel | None, tables: dict[str, DataFrame], overall: float):
        self.trees, self.tables, self.overall = trees, tables, overall

    def block_probability(self, rows: DataFrame) -> DataFrame:
        """Add `block_probability` to the rows that `lexical_features` returns."""
        if self.trees is None:
            return rows.withColumn("block_probability", F.lit(self.overall))
        ready = _assembled(_with_statistics(rows, self.tables, self.overall, False))
        return self.trees.transform(ready).withColumn("block_probability", vector_to_array("probability")[1])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> UrlModel:
    """Fit on labelled(url, blocked), blocked being 0.0 or 1.0; rows without a label are left out."""
    host, path = host_and_path(F.col("url"))
    rows = lexical_features(labelled.filter("blocked IS NOT NULL").select("url", "blocked", host.alias("host"), path.alias("path")))
    tables = {level: stored(_statistics(rows, level)) for level in ("suffix", "domain")}
    total, bad = tables["suffix"].agg(F.sum("suffix_all"), F.sum("suffix_bad")).first()
    if not total or bad in (0.0, total):
        return UrlModel(None, {}, (bad or 0.0) / (total or 1.0))
    # Drawn by content, so that the model does not depend on how rows are dealt out; a url counts once for each label it has.
    drawn = F.xxhash64(F.struct("url", "blocked"))
    n = rows.agg(F.approx_count_distinct(drawn)).first()[0]
    share = int(min(1.0, sample_rows / n) * (1 << 20))
    sample = rows.filter(F.pmod(drawn, F.lit(1 << 20)) < share).dropDuplicates(["url", "blocked"])
    known = _with_statistics(sample, tables, bad / total, True)
    # Each row once more as if its suffix were new, so that the trees can judge such urls by the rest.
    hidden = known.withColumns({c: F.lit(bad / total if c.endswith("rate") else 0.0) for c in STATISTICS})
    # A bounded sample: one task holds it, in the order of its content.
    ready = stored(_assembled(known.unionByName(hidden)).select("features", "blocked", drawn.alias("drawn"), "url").repartition(1)
                   .sortWithinPartitions("drawn", "url", "blocked", F.col("features").cast("string")).select("features", "blocked"))
    model = GBTClassifier(labelCol="blocked", maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(ready)
    return UrlModel(model, tables, bad / total)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability of every row of pages(page_id, url)."""
    host, path = host_and_path(pages["url"])
    rows = lexical_features(pages.select("page_id", "url", host.alias("host"), path.alias("path")))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return model.block_probability(rows.withColumn("rule", rule).withColumn("said", said)).select(
        "page_id", "host", "path", "rule", F.coalesce("said", learned).alias("verdict"), "block_probability")


def rule_labels(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Labelled urls where no other labels exist: those that a rule decides."""
    _, said = matching_rule(*host_and_path(pages["url"]), rules)
    return pages.select("url", F.when(said == "block", 1.0).when(said == "allow", 0.0).alias("blocked"))
