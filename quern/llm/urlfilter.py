"""URL filters: host and path rules, and a character language-model ratio for the urls that no rule fits.

Urls that a rule accepts or rejects train one variable-order Markov model of characters each. A model interpolates
orders 0 to 4 by Witten-Bell smoothing: a context with many different followers trusts its shorter context more. A
url's score is the mean over its characters of the rejecting less the accepting log-probability. Ruled urls are dealt into
folds and each is scored by the models of the other folds; the threshold lies in the middle of the gap between those scores that has
the least mean error. Urls without a rule are scored by the models of all folds.

All of it is DataFrame operations. Characters are only counted as windows of five: the shuffle carries one row per
distinct window and task, every lower order is a sum over windows, and the log-ratios are computed once per distinct
window before they join the urls' positions. Windows that many urls share meet their positions where these lie.
"""

from __future__ import annotations

from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut

ORDER = 4
#: Pads the start; ends the url. Neither is a character of a url.
START, END = "\u0002", "\u0003"
FOLDS = 5
#: A window with more than this share of all positions is broadcast, so at most ``1 / HOT_SHARE`` are.
HOT_SHARE = 1 / 5000
#: Characters that the uniform base of the interpolation assumes.
ALPHABET = 256
#: Scores are calibrated in hundredths between these bounds.
MOST = 10.0


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    after = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def windows(urls: DataFrame) -> DataFrame:
    """One row per character of a url (and its end): the character with the ``ORDER`` before it."""
    padded = F.concat(F.lit(START * ORDER), F.coalesce("url", F.lit("")), F.lit(END))
    places = F.sequence(F.lit(1), F.length(padded) - ORDER)
    return urls.withColumn("w", F.explode(F.transform(places, lambda i: F.substring(padded, i, ORDER + 1))))


def log_ratios(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, w, llr) for windows with counts (*by, w, good, bad): log P(last | before) of the bad model less that of the good one.

    There is a pair of models for each value of ``by``.
    """
    p_good = p_bad = F.lit(1.0 / ALPHABET)
    table = counted
    for k in range(ORDER + 1):
        gram = F.substring("w", ORDER + 1 - k, k + 1)
        grams = counted.groupBy(*by, gram.alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        contexts = grams.groupBy(*by, F.substring("g", 1, k).alias("h")).agg(
            F.sum("good").alias(f"hg{k}"), F.count_if(F.col("good") > 0).alias(f"tg{k}"), F.sum("bad").alias(f"hb{k}"), F.count_if(F.col("bad") > 0).alias(f"tb{k}")
        )
        known = grams.withColumn("h", F.substring("g", 1, k)).join(contexts, [*by, "h"]).select(*by, "g", F.col("good").alias(f"g{k}"), F.col("bad").alias(f"b{k}"), f"hg{k}", f"tg{k}", f"hb{k}", f"tb{k}")
        table = table.withColumn("g", gram).join(known, [*by, "g"]).drop("g")
        p_good = F.when(F.col(f"hg{k}") > 0, (F.col(f"g{k}") + F.col(f"tg{k}") * p_good) / (F.col(f"hg{k}") + F.col(f"tg{k}"))).otherwise(p_good)
        p_bad = F.when(F.col(f"hb{k}") > 0, (F.col(f"b{k}") + F.col(f"tb{k}") * p_bad) / (F.col(f"hb{k}") + F.col(f"tb{k}"))).otherwise(p_bad)
    return table.select(*by, "w", (F.log(p_bad) - F.log(p_good)).alias("llr"))


def calibrate(scored: DataFrame) -> float:
    """The score over which a url is rejected: the middle of a gap between the scores on (verdict, llr).

    Of the gaps with the least mean of both classes' error shares the widest counts, of equally wide ones the lowest. Without both classes,
    or where no gap does better than allowing all, nothing is rejected.
    """
    clamped = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("llr")))
    bins = scored.groupBy(F.floor(clamped * 100).alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")).orderBy("bin").collect()  # at most 2001
    goods, bads = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not goods or not bads:
        return MOST
    gaps, good_below, bad_below = [], 0, 0
    for b, after in pairwise(bins):
        good_below, bad_below = good_below + b["good"], bad_below + b["bad"]
        error = (goods - good_below) * bads + bad_below * goods  # over 2 * goods * bads
        if error < goods * bads:
            gaps.append((error, b["bin"] - after["bin"], b["bin"] + 1, after["bin"]))
    if not gaps:
        return MOST
    _, _, low, high = min(gaps)
    return (low + high) / 200


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, llr (null where a rule decides).

    Null urls and urls without ``://`` have an empty host and path; the models judge them as any other text, but null and empty urls,
    which have nothing to judge, are allowed. Without ruled urls of both kinds to learn from, every url without a rule is allowed.
    Repeated rows are judged each and learnt from each. An empty table gives an empty result. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumn("host", host).withColumn("path", path)
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(FOLDS))
    told = told.withColumn("rule", text).withColumn("verdict", verdict).withColumn("fold", fold).withColumn("row", F.monotonically_increasing_id())
    told = cut(told, "urls")
    ruled, by = F.col("verdict").isNotNull(), ("model",)
    per_fold = windows(told.select("url", "verdict", "fold")).groupBy("w").agg(
        F.count("*").alias("n"),
        *(F.count_if((F.col("verdict") == v) & (F.col("fold") == f)).alias(f"{v}{f}") for v in ("allow", "block") for f in range(FOLDS)),
        *(F.max(ruled & (F.col("fold") == f)).alias(f"asks{f}") for f in range(FOLDS)), F.max(~ruled).alias(f"asks{FOLDS}"),
    )
    per_fold = cut(per_fold, "url-windows")

    def learnt(verdict: str, model: int) -> Column:
        return sum((F.col(f"{verdict}{f}") for f in range(FOLDS) if f != model), F.lit(0).cast("long"))

    # model f has seen all folds but f, the last one all; a window stands in those that learn from it or are asked for it
    models = F.array(*(F.struct(F.lit(m).alias("model"), learnt("allow", m).alias("good"), learnt("block", m).alias("bad"), F.col(f"asks{m}").alias("asked")) for m in range(FOLDS + 1)))
    counted = per_fold.select("w", F.explode(models).alias("m")).select("w", "m.*").filter("asked or good + bad > 0")
    ratios = log_ratios(cut(counted.drop("asked"), "url-models"), by).groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("model", "llr"))).alias("llrs"))  # at most FOLDS + 1
    ratios = cut(ratios.join(per_fold.select("w", "n"), "w"), "url-ratios")
    most = (ratios.agg(F.sum("n").alias("n")).head()["n"] or 0) * HOT_SHARE
    asked = windows(told.select("row", F.when(ruled, F.col("fold")).otherwise(FOLDS).cast("int").alias("model"), "url"))
    hot = F.broadcast(ratios.filter(F.col("n") > most).select("w", "llrs"))
    parts = [asked.join(hot, "w", "left_anti").join(ratios.filter(F.col("n") <= most).select("w", "llrs"), "w"), asked.join(hot, "w")]
    sums = [p.groupBy("row").agg(F.sum(F.col("llrs")[F.col("model")]).alias("llr"), F.count("*").alias("n")) for p in parts]
    scores = sums[0].unionByName(sums[1]).groupBy("row").agg((F.sum("llr") / F.sum("n")).alias("llr"))
    judged = cut(told.join(scores, "row", "left"), "url-scores")
    threshold = calibrate(judged.filter(ruled))
    by_model = F.when((F.col("llr") > threshold) & (F.col("url") != ""), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), F.when(F.col("verdict").isNull(), F.col("llr")).alias("llr"))
