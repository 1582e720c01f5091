"""URL filtering by rules and by an empirical-Bayes host reputation; DataFrame functions only.

A rule (a host and a path prefix) fits its host and all subdomains where the path starts with the rule's; the longest rule
decides. Other pages are judged by their host: page outcomes (good or not) are shrunk through beta-binomial priors from
all pages to the public suffix, from the suffix to the registered domain (suffix and one label), from there to the host.
A level's prior is a beta distribution with the parent's posterior mean and a strength fitted by moments over that level's
groups. A page is blocked if the upper bound of the posterior for good outcomes, the ``LEVEL`` quantile of the beta
distribution, lies below the threshold; that is, if the distribution function at the threshold exceeds ``LEVEL``.

Levels are those of the host without user info, port and final dot; the suffix is one of ``SUFFIXES`` or the last label, and
an address of numbers or in brackets is a registered domain of its own under the suffix "".

Scale: outcomes are counted by host with partial aggregation and written once; the levels above come from those counts, and
the join back has one row a host, so a host with a third of the pages is split by adaptive execution. Only three numbers a
level and the rules reach the driver.

Defined cases: a url that is null or has no "://" has an empty host and path, fits no rule and is judged by the empty host;
outcomes of null page_id or value don't count, of several outcomes of a page the worst does; without outcomes every unruled
page is allowed; of rules of equal length the later one decides; repeated pages are judged each; urls have any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stemma.llm._spark import cut_columnar

#: Public suffixes of two labels under which names are registered.
SUFFIXES = (
    "ac.at ac.il ac.in ac.jp ac.kr ac.nz ac.th ac.uk ac.za co.at co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za "
    "com.ar com.au com.bd com.br com.cn com.co com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.pl com.sg com.tr com.tw com.ua com.vn "
    "edu.au edu.br edu.cn edu.hk edu.in edu.mx edu.pl edu.sg edu.tr edu.tw go.jp go.kr go.th gob.ar gob.mx gov.au gov.br gov.cn gov.in gov.uk gov.za "
    "gouv.fr ltd.uk me.uk ne.jp net.au net.br net.cn net.nz net.uk nhs.uk or.at or.jp or.kr or.th org.ar org.au org.br org.cn org.hk org.il org.in org.mx org.nz org.pl org.tr org.tw org.uk org.za plc.uk sch.uk"
).split()
#: Probability of the bound, and terms of its continued fraction.
LEVEL = 0.95
TERMS = 60

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """The value (name or verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def levels(host: Column) -> dict[str, Column]:
    """suffix and domain (registered) of a host."""
    bare = F.regexp_replace(host, r"^[^@]*@", "")
    bare = F.regexp_replace(bare, r"(?<=[^:]):[0-9]*$|(?<=\]):[0-9]*$", "")
    bare = F.regexp_replace(bare, r"\.$", "")
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")
    double = last(2).isin(*SUFFIXES)
    return {"suffix": F.when(address, "").when(double, last(2)).otherwise(last(1)), "domain": F.when(address, bare).when(double, last(3)).otherwise(last(2))}


def _log_gamma(z: Column) -> Column:
    """Stirling's series above 8, moved up by the recurrence; the error is below 1e-10 for z > 0."""
    shift = F.log(z)
    for k in range(1, 8):
        shift = shift + F.log(z + k)
    x = z + 8
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - shift


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function by convergents from the inside out; settles for x < (a+1)/(a+b+2)."""
    # more terms where the distribution is narrow: they grow with the square root of its size
    terms = F.least(F.lit(4000), F.ceil(TERMS + 3 * F.sqrt(a + b)).cast("int"))

    def step(tail: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / tail)

    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / F.aggregate(F.transform(F.sequence(terms, F.lit(1)), lambda m: m.cast("double")), F.lit(1.0), step))


def beta_cdf(a: Column, b: Column, x: float) -> Column:
    """Distribution function of the beta distribution at x: the regularised incomplete beta function."""
    log_front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(F.lit(x)) + b * F.log(F.lit(1 - x))
    front = F.exp(log_front)
    return F.when(F.lit(x) < (a + 1) / (a + b + 2), front * _fraction(a, b, F.lit(x)) / a).otherwise(1 - front * _fraction(b, a, F.lit(1 - x)) / b)


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength by moments: how much less the groups' shares vary than if each page stood for itself."""
    p = F.col("good") / F.col("n")
    row = groups.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (p - mean) * (p - mean)).alias("between"), F.sum(mean * (1 - mean) * F.col("n")).alias("within"), F.count("*").alias("k")).first()
    if not row["n"] or not row["within"]:
        return 10.0
    sampling = row["within"] / row["n"] * row["k"]  # expected, were all groups alike
    extra = (row["between"] - sampling) / max(row["n"] - row["k"], 1)
    v = row["within"] / row["n"]
    return float(min(1000.0, max(2.0, v / extra - 1))) if extra > 0 else 1000.0


def reputation(pages: DataFrame, outcomes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """host, a, b (posterior), mean, below (probability that good outcomes are rarer than the threshold) for every host of pages.

    pages: page_id, host; outcomes: page_id, good (boolean).
    """
    seen = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    counted = pages.join(seen, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.sum(F.coalesce(F.col("good").cast("int"), F.lit(0))).alias("good"))
    by_host = cut_columnar(counted).withColumns(levels(F.col("host")))
    total = by_host.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    top = ((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 1.0)
    suffix = by_host.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    s = _strength(suffix, F.lit(top))
    suffix = suffix.select("suffix", ((F.col("good") + s * top) / (F.col("n") + s)).alias("prior"))
    domain = by_host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(suffix, "suffix")
    s = _strength(domain, F.col("prior"))
    domain = domain.select("suffix", "domain", ((F.col("good") + s * F.col("prior")) / (F.col("n") + s)).alias("prior"))
    hosts = by_host.join(domain, ["suffix", "domain"])
    s = _strength(hosts, F.col("prior"))
    a, b = F.col("good") + s * F.col("prior"), F.col("n") - F.col("good") + s * (1 - F.col("prior"))
    least = F.lit(1e-9)  # a prior share of 0 or 1 has no distribution
    hosts = hosts.select("host", F.greatest(a, least).alias("a"), F.greatest(b, least).alias("b"))
    return hosts.select("host", "a", "b", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), beta_cdf(F.col("a"), F.col("b"), threshold).alias("below"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation, for every row. pages: page_id, url; other columns are ignored."""
    url = F.col("url").cast("string")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    held = cut_columnar(reputation(own.select("page_id", "host"), outcomes, threshold).select("host", F.col("mean").alias("reputation"), (F.col("below") > LEVEL).alias("bad")))
    host, path = F.col("host"), F.col("path")
    judged = own.join(held, "host")
    method = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule_of(host, path, rules, "name").alias("rule"), F.coalesce(rule_of(host, path, rules, "verdict"), method).alias("verdict"), F.round("reputation", 6).alias("reputation"))
