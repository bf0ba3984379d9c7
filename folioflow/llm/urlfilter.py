"""URL verdicts: rules first, then the ratio of two character language models.

Urls that a rule allows or blocks train two variable-order Markov models, of accepted and
of rejected urls. A model's probability of a character after a context of up to ``ORDER``
characters is its relative frequency, smoothed by the probability after the context
shortened by one, down to a uniform distribution over the alphabet. A url's score is the
mean over its characters of the difference of log probabilities; the threshold is the cut
that judges most labelled urls right among those that the models don't see
(``page_id`` divisible by 5), read from a histogram of scores.

The models read the whole url as it is, but for A-Z in lower case, so they see digits, queries and
letters of any script. The table of distinct character runs grows with these; it is broadcast after
its rows are counted, up to ``BROADCAST_ROWS``; a larger one is joined by a shuffle that Spark may
split for hot runs. All of it is DataFrame expressions.

A null url, or one without ``://``, has an empty host and path and is judged by its
characters alone, as an empty text if null. Without labelled urls of either kind every score is as the models are and the
threshold is 0; a score at the threshold is allowed. Repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import ascii_lower, table, written

ORDER = 4
#: The number of code points.
ALPHABET = 0x110000
SMOOTHING = 2.0
STEP = 0.001
BROADCAST_ROWS = 300_000
#: (host, path, verdict); a rule fits a host and its subdomains, and paths that start with its path.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1).alias("path"))


def fitting(rules=RULES):
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def runs():
    """All runs of ORDER + 1 symbols of the padded url; each stands for its last symbol after the others."""
    padded = F.concat(F.lit("^" * ORDER), ascii_lower("url"), F.lit("$"))
    return F.transform(F.array(padded), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - ORDER), lambda i: F.substring(s, i, ORDER + 1)))[0]


def ratios(counted: DataFrame) -> DataFrame:
    """run, ratio: the difference of log probabilities, from ``counted(run, a, r)``, the runs' training counts."""
    level = counted
    tables = []
    for k in range(ORDER, -1, -1):
        level = level.groupBy(F.expr(f"right(run, {k + 1})").alias("run")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        tables.append((k, level))
    below = None
    for k, level in reversed(tables):
        level = level.withColumn("context", F.expr(f"left(run, {k})"))
        of = level.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        level = level.join(of, "context")
        if below is None:
            level = level.withColumn("pa", F.lit(1 / ALPHABET)).withColumn("pr", F.lit(1 / ALPHABET))
        else:
            level = level.withColumn("shorter", F.expr(f"right(run, {k})")).join(below, "shorter")
        smoothed = [((F.col(n) + SMOOTHING * F.col(p)) / (F.col(c) + SMOOTHING)).alias(p) for n, c, p in (("a", "ca", "pa"), ("r", "cr", "pr"))]
        below = level.select(F.col("run").alias("shorter"), *smoothed)
    return below.select(F.col("shorter").alias("run"), (F.log("pa") - F.log("pr")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The cut that judges most urls right, nearest 0 among equals, for ``scored(score, verdict)``."""
    bins = scored.groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r")).collect()
    bins = sorted((b.bin, b.a, b.r) for b in bins)
    allowed, blocked = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allowed or not blocked:
        return 0.0
    best, a, r = [], allowed, 0
    for bin_, na, nr in bins:
        best.append((-(a + r), abs(bin_), bin_))
        a, r = a - na, r + nr
    return min(best)[2] * STEP


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score for each row of ``pages``."""
    rows = with_parts(pages).withColumn("fit", fitting(rules)).withColumn("calibrates", F.coalesce(F.expr("page_id % 5 = 0"), F.lit(False)))
    trains = F.col("fit").isNotNull() & ~F.col("calibrates")
    grams = rows.select(F.when(trains, F.col("fit.verdict")).alias("label"), F.explode(runs()).alias("run"))
    counted = grams.groupBy("run").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r"))
    ratio = written(ratios(written(counted)))
    if ratio.count() <= BROADCAST_ROWS:
        ratio = F.broadcast(ratio)
    key = F.xxhash64("url").alias("url_key")
    score = rows.select("page_id", key, F.explode(runs()).alias("run")).join(ratio, "run").groupBy("page_id", "url_key").agg(F.round(F.avg("ratio"), 9).alias("score"))
    score = score.select(F.col("page_id").alias("_id"), F.col("url_key").alias("_key"), "score")
    keyed = rows.withColumn("url_key", F.xxhash64("url"))
    out = written(keyed.join(score, keyed.page_id.eqNullSafe(score["_id"]) & (keyed.url_key == score["_key"])).select("page_id", "url", "host", "path", "fit", "calibrates", "score"))
    cut = threshold(out.where("calibrates and fit is not null").select("score", "fit.verdict"))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select("page_id", "url", "host", "path", "fit.rule", verdict.alias("verdict"), "score")


def op8_url_lm(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of all pages."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _sql() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in order]
    rule = "case " + " ".join(f"when {f} then '{h}{p}'" for f, (h, p, _) in zip(fits, order)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, (_, _, v) in zip(fits, order)) + " end"
    levels = []
    for k in range(ORDER + 1):
        shorter = f"join t{k - 1} s on s.run = right(l.run, {k})" if k else ""
        pa, pr = ("s.pa", "s.pr") if k else (f"{1 / ALPHABET!r}::double", f"{1 / ALPHABET!r}::double")
        levels.append(
            f"l{k} as (select right(run, {k + 1}) as run, sum(a) as a, sum(r) as r from counted group by 1), c{k} as (select left(run, {k}) as context, sum(a) as ca, sum(r) as cr from l{k} group by 1), "
            f"t{k} as (select l.run, (l.a + {SMOOTHING} * {pa}) / (c.ca + {SMOOTHING}) as pa, (l.r + {SMOOTHING} * {pr}) / (c.cr + {SMOOTHING}) as pr from l{k} l join c{k} c on c.context = left(l.run, {k}) {shorter})"
        )
    return f"""
with p as (select page_id, coalesce(url, '') as url from pages),
h as (select *, {low.format("regexp_extract(url, '://([^/?#]*)', 1)")} as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from p),
f as (select *, {rule} as rule, {verdict} as v, coalesce(page_id % 5 = 0, false) as cal,
  '{"^" * ORDER}' || {low.format("url")} || '$' as s from h),
g as (select page_id, url, case when not cal then v end as label, unnest(list_transform(range(1, length(s) - {ORDER} + 1), lambda i: substring(s, i, {ORDER + 1}))) as run from f),
counted as (select run, count(*) filter (label = 'allow') as a, count(*) filter (label = 'block') as r from g group by 1),
{", ".join(levels)},
sc as (select page_id, url, round(avg(ln(pa) - ln(pr)), 9) as score from g join t{ORDER} using (run) group by 1, 2),
b as (select floor(score / {STEP}) as bin, count(*) filter (v = 'allow') as a, count(*) filter (v = 'block') as r from f join sc using (page_id, url) where cal and v is not null group by 1),
q as (select bin, sum(a) over () as na, sum(r) over () as nr, sum(a) over (order by bin rows between current row and unbounded following) as a1,
  coalesce(sum(r) over (order by bin rows between unbounded preceding and 1 preceding), 0) as r1 from b),
best as (select bin from q where na > 0 and nr > 0 order by a1 + r1 desc, abs(bin), bin limit 1),
cut as (select coalesce((select bin from best), 0) * {STEP} as cut)
select page_id, host, path, rule, coalesce(v, case when score >= cut then 'allow' else 'block' end) as verdict, round(score, 6) as score
from f join sc using (page_id, url), cut
"""


SQL = _sql()
