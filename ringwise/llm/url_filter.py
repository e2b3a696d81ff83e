"""URL filtering by allow and block rules and a character language-model ratio.

Urls that a rule decides train two smoothed variable-order Markov models over characters, one of
accepted and one of rejected urls. The probability of a character after a context of k
characters is interpolated with that after k - 1 (Witten-Bell), down to a uniform one. Other urls
are judged by the difference of the two log-likelihoods divided by the length, against a threshold
calibrated on labelled urls that were kept out of the counts.

DataFrame functions only. The models are counted, never collected. Probabilities are worked out from the
lowest order up, once for each distinct n-gram: each joins the one that is a character shorter, so no join has a key with more rows
than there are characters. An url's n-grams are joined with the ratios and summed, which is combined before the shuffle.
Where the ratios are too large to send to all tasks, only those of hot n-grams are, and the others are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, ascii_lower, bounded, materialise, pick, size_of, table

#: (verdict, host, path) of the production rules.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
START, END = "\u0001", "\u0002"
#: Characters of context of the longest order.
ORDER = 4
#: Equally likely characters of the lowest order.
ALPHABET = 1024
#: Rules up to this many are one expression; more are joined by the host's suffixes.
FEW_RULES = 200


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``ruled``: the longest rule that fits ``host`` and ``path``, and its verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules of equal
    length can't both fit unless they are the same; of the same rule twice, block wins.
    """
    if len(rules) <= FEW_RULES:
        found = [
            F.when(
                ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p)),
                F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
            )
            for v, h, p in rules
        ]
        best = F.array_max(F.filter(F.array(*found), lambda r: r.isNotNull())) if found else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
        return urls.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.verdict")).drop("best")
    each = F.array(*[F.struct(F.lit(h).alias("rhost"), F.lit(p).alias("rpath"), F.lit(h + p).alias("rrule"), F.lit(v).alias("rverdict")) for v, h, p in rules])
    listed = urls.sparkSession.range(1).select(F.explode(each).alias("r")).select("r.*")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = urls.select("_row", "path", F.explode(suffixes).alias("rhost")).join(bounded(listed, 200), "rhost").where(F.startswith("path", "rpath"))
    best = met.groupBy("_row").agg(F.max(F.struct(F.length("rrule").alias("n"), F.col("rrule").alias("rule"), F.col("rverdict").alias("verdict"))).alias("best"))
    return urls.join(best, "_row", "left").withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.verdict")).drop("best")


def grams(url: Column, order: int) -> Column:
    """Each character of a url with the ``order`` before it, the end counting as a character; linear in its length."""
    padded = F.concat(F.lit(START * order), ascii_lower(F.coalesce(url, F.lit(""))), F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))


def model_counts(labelled: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Counts of n-grams of all orders and of their contexts from ``labelled(_url, ruled)``.

    ``(s, a, r)`` and ``(ctx, an, at, rn, rt)``: how often accepted and rejected urls have the
    n-gram; how often the context, and how many different characters follow it.
    """
    longest = labelled.select("ruled", F.explode(grams(F.col("_url"), order)).alias("g")).groupBy("g").agg(
        F.sum((F.col("ruled") == "allow").cast("bigint")).alias("a"), F.sum((F.col("ruled") == "block").cast("bigint")).alias("r")
    )
    suffixes = F.explode(F.array(*[F.expr(f"right(g, {k + 1})") for k in range(order + 1)]))
    counts = materialise(longest.select(suffixes.alias("s"), "a", "r").groupBy("s").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "ngrams")
    contexts = counts.groupBy(F.expr("substring(s, 1, length(s) - 1)").alias("ctx")).agg(
        F.sum("a").alias("an"), F.count_if(F.col("a") > 0).alias("at"), F.sum("r").alias("rn"), F.count_if(F.col("r") > 0).alias("rt")
    )
    return counts, materialise(contexts, "contexts")


def gram_ratios(seen: DataFrame, counts: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``(g, n, llr)``: log-likelihood ratio of the last character of each n-gram of ``seen(g, n)``, which occurs n times.

    ``pa`` and ``pr`` of an n-gram with k characters of context come from those of its last k characters, level by level.
    """
    level = None
    for k in range(order + 1):
        now = seen.select(F.expr(f"right(g, {k + 1})").alias("s")).distinct() if k < order else seen.select(F.col("g").alias("s"), "n")
        now = now.withColumn("ctx", F.expr(f"substring(s, 1, {k})")).withColumn("low", F.expr(f"right(s, {k})"))
        known = now.join(bounded(counts.where(F.length("s") == k + 1), 24), "s", "left")
        if k == 0:  # the empty context is one row
            known = known.join(F.broadcast(contexts.where("ctx = ''")), "ctx", "left").withColumn("low_a", F.lit(1.0 / ALPHABET)).withColumn("low_r", F.lit(1.0 / ALPHABET))
        else:
            known = known.join(bounded(contexts.where(F.length("ctx") == k), 40), "ctx", "left").join(bounded(level, 24), "low")
        p = lambda n, total, kinds, low: F.when(F.col(total) > 0, (F.coalesce(F.col(n), F.lit(0)).cast("double") + F.col(kinds) * F.col(low)) / (F.col(total) + F.col(kinds)).cast("double")).otherwise(F.col(low))
        known = known.withColumn("pa", p("a", "an", "at", "low_a")).withColumn("pr", p("r", "rn", "rt", "low_r"))
        if k == order:
            return known.select(F.col("s").alias("g"), "n", (F.log("pa") - F.log("pr")).alias("llr"))
        level = materialise(known.select(F.col("s").alias("low"), F.col("pa").alias("low_a"), F.col("pr").alias("low_r")), f"order-{k}")


def scores(urls: DataFrame, ratios: DataFrame, order: int, most: int = 32 << 20) -> DataFrame:
    """``(_row, score)``: mean log-likelihood ratio a character; ``ratios(g, n, llr)`` of all n-grams that occur.

    Ratios of up to ``most`` bytes are sent to all tasks, where each url is summed up. Of others the hot ones are: they are
    fewer than ``HOT_SHARE`` times the mean length of an url.
    """
    each = urls.select("_row", F.explode(grams(F.col("_url"), order)).alias("g"))
    total = (F.sum("llr").alias("t"), F.count("llr").alias("n"))
    if size_of(ratios, 24) <= most:
        summed = each.join(F.broadcast(ratios.drop("n")), "g").groupBy("_row").agg(*total)
    else:
        hot = F.col("n") * HOT_SHARE > urls.count()
        often = F.broadcast(ratios.where(hot).drop("n"))
        near = each.join(often, "g").groupBy("_row").agg(*total)
        far = each.join(often.select("g"), "g", "left_anti").join(ratios.where(~hot).drop("n"), "g").groupBy("_row").agg(*total)
        summed = near.unionByName(far).groupBy("_row").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    return summed.select("_row", (F.col("t") / F.col("n")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """Where labelled scores ``(ruled, score)`` lie equally many deviations from both classes' means.

    0 where a class has no row, and the middle where scores don't vary.
    """
    found = {r["ruled"]: (r["m"], r["s"]) for r in scored.groupBy("ruled").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    if len(found) < 2:
        return 0.0
    (ma, sa), (mr, sr) = found["allow"], found["block"]
    return (ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2


def is_kept_out(url: Column) -> Column:
    """A fifth of the urls, by a hash: these calibrate and aren't counted."""
    return F.conv(F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 7), 16, 10).cast("bigint") % 5 == 0


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url", most: int = 32 << 20) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, score``.

    ``verdict`` is the rule's, or else "allow" where the score reaches the threshold. A null url or
    one without "://" has an empty host and path; it is scored as it is, a null one as empty.
    Where one class has no labelled url nothing tells the classes apart and all is scored by the
    other one's model against the uniform one. Repeated rows get equal results; an empty table gives none; urls are read
    whole; other columns are not read, whatever they are called. ``most``: bytes of ratios that are sent to all tasks.
    """
    urls = pick(pages, _id=id_col, _url=url_col).withColumn("_row", F.monotonically_increasing_id())
    urls = materialise(with_rule(urls.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url"))), rules), "urls")
    labelled = urls.where("ruled is not null")
    kept_out = is_kept_out(F.col("_url"))
    counts, contexts = model_counts(labelled.where(~kept_out), order)
    seen = materialise(urls.select(F.explode(grams(F.col("_url"), order)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")), "grams")
    ratios = materialise(gram_ratios(seen, counts, contexts, order), "ratios")
    scored = materialise(scores(urls, ratios, order, most), "scores")
    edge = threshold(labelled.where(kept_out).select("_row", "ruled").join(scored, "_row"))
    out = urls.join(scored, "_row", "left")
    by_model = F.when(F.col("score") >= edge, F.lit("allow")).otherwise(F.lit("block"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")


def _chance(n: str, total: str, kinds: str) -> str:
    """Interpolated probability as nested SQL over the joined orders."""
    p = f"(1.0::DOUBLE / {ALPHABET})"
    for k in range(ORDER + 1):
        p = f"(case when c{k}.{total} > 0 then (coalesce(s{k}.{n}, 0) + c{k}.{kinds} * {p}) / (c{k}.{total} + c{k}.{kinds}) else {p} end)"
    return p


def _rules_sql() -> str:
    fits = [f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{'n': {len(h + p)}, 'rule': '{h + p}', 'verdict': '{v}'}} end" for v, h, p in RULES]
    return f"list_sort(list_filter([{', '.join(fits)}], lambda x: x is not null), 'DESC')[1]"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = f"""
with u as (
  select page_id, coalesce(url, '') as url, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
r as (select *, {_rules_sql()} as best, ('0x' || substr(md5(url), 1, 7))::BIGINT % 5 = 0 as kept_out, repeat(chr(1), {ORDER}) || {_LOWER.format('url')} || chr(2) as p from u),
g as (select page_id, best.verdict as ruled, kept_out, substr(p, i, {ORDER + 1}) as g from (select *, unnest(range(1, length(p) - {ORDER} + 1)) as i from r)),
t as (select g, count_if(ruled = 'allow') as a, count_if(ruled = 'block') as r from g where ruled is not null and not kept_out group by g),
s as (select s, sum(a)::DOUBLE as a, sum(r)::DOUBLE as r from (select right(g, k + 1) as s, a, r from t, range({ORDER + 1}) x(k)) group by s),
c as (select substr(s, 1, length(s) - 1) as ctx, sum(a) as an, count_if(a > 0) as at, sum(r) as rn, count_if(r > 0) as rt from s group by 1),
d as (select distinct g from g),
l as (select d.g, ln({_chance('a', 'an', 'at')}) - ln({_chance('r', 'rn', 'rt')}) as llr from d
  {' '.join(f"left join s s{k} on s{k}.s = right(d.g, {k + 1}) left join c c{k} on c{k}.ctx = substr(d.g, {ORDER + 1 - k}, {k})" for k in range(ORDER + 1))}),
m as (select page_id, avg(llr) as score from g join l using (g) group by page_id),
e as (select best.verdict as v, avg(score) as m, stddev_pop(score) as s from r join m using (page_id) where best is not null and kept_out group by 1),
edge as (select case when count(*) < 2 then 0 when sum(s) > 0 then (max(case when v = 'allow' then m end) * max(case when v = 'block' then s end) + max(case when v = 'block' then m end) * max(case when v = 'allow' then s end)) / sum(s) else avg(m) end as edge from e)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, case when score >= edge then 'allow' else 'block' end) as verdict from r join m using (page_id), edge
"""
