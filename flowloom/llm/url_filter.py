"""URL filter: host and path rules, and for the rest a Bayes score of segmented words.

Words that names run together are split by a unigram Viterbi search: counts of all words in the pages' texts give the
probabilities. A multinomial naive Bayes model, learned from the pages that a rule decides, scores the host and path
words of those that none decides. Counts, substring look-ups and scores are joins and aggregates over distinct words
or tokens; only the search inside one word runs in Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import broadcast_if_small, cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[a-z\u0080-￿]+"
_PART = r"[a-z\u0080-￿]+|[0-9]+"
#: Rows of a rule, word or token table that may be broadcast.
SMALL_ROWS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decided) of the distinct (host, path) that a rule fits; the longest rule wins.

    ``rules`` has host, path and verdict. A rule fits its host and every subdomain where the path starts with its own.
    Equal rules with two verdicts block. Rules with a null are left out.
    """
    r = rules.dropna().select(
        F.col("host").alias("suffix"), F.col("path").alias("start"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("decided")
    )
    labels = F.split("host", r"\.", -1)
    most = r.agg(F.max(F.size(F.split("suffix", r"\.", -1)))).first()[0] or 1  # no rule has more labels
    begin = F.greatest(F.size(labels) - most + 1, F.lit(1))
    suffixes = F.transform(F.sequence(begin, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.where("host != ''").select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = each.join(broadcast_if_small(r, SMALL_ROWS), "suffix").where(F.startswith("path", "start"))
    best = F.max(F.struct(F.length("rule"), "rule", F.col("decided") == "block"))
    return fits.groupBy("host", "path").agg(best.alias("b")).select(
        "host", "path", F.col("b.rule").alias("rule"), F.when(F.col("b.col3"), "block").otherwise("allow").alias("decided")
    )


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over all words of the pages' texts: markup and script left out, lower case."""
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.lower(F.regexp_replace(text, r"(?s)<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _heads(longest: int):
    """For each letter of a word and each level 1, 2, 4, ... up to ``longest``: the ``level`` letters from there, and
    what follows up to the next level."""
    levels = [1 << k for k in range(max(longest, 1).bit_length())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for no, word in zip(batch["no"].to_pylist(), batch["word"].to_pylist()):
                for a in range(len(word)):
                    out += [(no, a + 1, word[a : a + k], word[a + k : a + 2 * k - 1]) for k in levels if a + k <= len(word)]
                    if len(out) >= 1 << 15:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["no", "a", "head", "more"])
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["no", "a", "head", "more"])

    return run


def segment_words(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, parts) for each distinct ``word``: the likeliest split into words of ``counts``.

    A stretch of ``l`` letters that is no known word has probability 10 / (total * 10^l), so it stays whole unless
    known words cover it. Of equally likely splits the one whose last word is longest is taken. Words and stretches may
    have any length. Known words of ``k`` to ``2 k - 1`` letters (``k`` a power of two) are looked up by their first ``k``
    letters, and only where these stand are the lengths that follow them tried: a word of ``n`` letters sends ``n`` rows
    for each power of two up to the longest known word, and one for each known word in it.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    known = counts.where(F.length("word") <= longest).select(F.col("word").alias("sub"), "n", F.length("word").alias("l"))
    most = known.agg(F.max("l")).first()[0]
    words = cut_lineage(words.select("word", F.monotonically_increasing_id().alias("no")))
    level = F.pow(F.lit(2.0), F.floor(F.log2(F.col("l") + 0.5))).cast("int")
    heads = known.select(F.substr("sub", F.lit(1), level).alias("head"), "l").groupBy("head").agg(F.collect_set("l").alias("lengths"))
    starts = words.mapInArrow(_heads(most or 0), "no bigint, a bigint, head string, more string")
    size = F.length("head") + F.length("more")
    subs = starts.join(broadcast_if_small(heads, SMALL_ROWS), "head").select(
        "no", "a", F.concat("head", "more").alias("tail"), F.explode(F.filter("lengths", lambda l: l <= size)).alias("l")
    )
    subs = subs.select("no", "a", "l", F.substr("tail", F.lit(1), F.col("l")).alias("sub"))
    found = subs.join(broadcast_if_small(known.drop("l"), SMALL_ROWS), "sub").groupBy("no").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), "l", "n")).alias("found"))

    @F.pandas_udf("array<string>")
    def split(word: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_viterbi(w, f, total) for w, f in zip(word, found)])

    return words.join(found, "no", "left").select("word", split("word", "found").alias("parts"))


def _viterbi(word: str, found, total: int) -> list[str]:
    known = {}
    for r in found if found is not None else ():
        known.setdefault(r["a"] - 1 + r["l"], []).append((r["l"], r["n"]))
    best, far = [(0.0, 0)], (-math.inf, 0)  # far: where an unknown stretch that ends here begins best, by the least place
    for end in range(1, len(word) + 1):
        far = max(far, (best[-1][0] + (end - 1) * math.log(10), 1 - end))
        size = end + far[1]
        options = [(best[end - size][0] + math.log(10 / total) - size * math.log(10), size)]
        options += [(best[end - l][0] + math.log(n / total), l) for l, n in known.get(end, ())]
        best.append(max(options))
    out, end = [], len(word)
    while end:
        out.append(word[end - best[end][1] : end])
        end -= best[end][1]
    return out[::-1]


def url_tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(``url_no``, token) with one row per token of each row of ``urls``; a run of digits is the token ``0``."""
    parts = F.concat(
        F.regexp_extract_all(F.col("host"), F.lit(_PART), F.lit(0)), F.regexp_extract_all(F.lower("path"), F.lit(_PART), F.lit(0))
    )
    each = cut_lineage(urls.select("url_no", F.explode(parts).alias("word")))
    words = each.where(~F.col("word").rlike("^[0-9]")).select("word").distinct()
    split = segment_words(words, counts)
    tokens = F.coalesce("parts", F.array(F.lit("0")))
    return each.join(broadcast_if_small(split, SMALL_ROWS), "word", "left").select("url_no", F.explode(tokens).alias("token"))


def token_weights(tokens: DataFrame, labelled: DataFrame) -> tuple[DataFrame, float]:
    """(token, weight) and the prior: log odds of block by add-one multinomial counts of ``labelled`` rows.

    ``labelled`` has ``url_no``, ``n`` rows and ``decided``. Without rows of both verdicts all weights are zero.
    """
    c = labelled.agg(
        F.sum(F.when(F.col("decided") == "block", F.col("n"))).alias("b"), F.sum(F.when(F.col("decided") == "allow", F.col("n"))).alias("a")
    ).first()
    blocked = F.sum(F.when(F.col("decided") == "block", F.col("n")).otherwise(0)).alias("b")
    allowed = F.sum(F.when(F.col("decided") == "allow", F.col("n")).otherwise(0)).alias("a")
    per = cut_lineage(tokens.join(labelled.select("url_no", "n", "decided"), "url_no").groupBy("token").agg(blocked, allowed))
    if not c["b"] or not c["a"]:
        return per.select("token", F.lit(0.0).alias("weight")), (1.0 if c["b"] else -1.0)
    s = per.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    shift = math.log(((s["a"] or 0) + s["v"]) / ((s["b"] or 0) + s["v"])) if s["v"] else 0.0
    weight = F.log(F.col("b") + 1.0) - F.log(F.col("a") + 1.0) + shift
    return per.select("token", weight.alias("weight")), math.log(c["b"] / c["a"])


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row of ``pages``.

    The verdict is the longest fitting rule's, else block where the Bayes log odds ``score`` are above 0. A null URL or
    one without ``://`` has an empty host and path and no tokens, so the prior decides. Unknown tokens count nothing.
    Repeated rows each count and each return, null ids too; ties: a score of 0 allows. A very long URL is one row of one
    task, in time that grows with its length. An empty table gives an empty one; other columns are not read.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    urls = cut_lineage(urls.withColumn("url_no", F.monotonically_increasing_id()))
    decided = cut_lineage(match_rules(urls, rules))
    counts = cut_lineage(word_counts(pages))
    tokens = cut_lineage(url_tokens(urls, counts))
    weights, prior = token_weights(tokens, urls.join(decided, ["host", "path"]))
    scored = tokens.join(broadcast_if_small(weights, SMALL_ROWS), "token").groupBy("url_no").agg(F.sum("weight").alias("sum"))
    score = F.coalesce("sum", F.lit(0.0)) + prior
    judged = urls.drop("n").join(decided, ["host", "path"], "left").join(scored, "url_no", "left").select(
        "host", "path", "rule", F.coalesce("decided", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score")
    )
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")
