"""Findings as rows, and audit rules that produce them.

Findings carry codes and paths, never what a page says.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

COLUMNS = ("site", "producer", "code", "severity", "pathname")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _rules(df: DataFrame, rules: Sequence[tuple[Column, str, str]], producer: str = "audit") -> DataFrame:
    """A finding per row and rule that holds: one scan for all rules."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for test, code, sev in rules)))
    return df.select("site", "pathname", F.explode(hits).alias("f")).select("site", F.lit(producer).alias("producer"), "f.code", "f.severity", "pathname")


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF, four bytes in UTF-8, count twice."""
    return F.length(value) + F.length(F.regexp_replace(value, r"[^\x{10000}-\x{10FFFF}]", ""))


def _outside(value: Column, lo: int, hi: int) -> Column:
    return ~utf16_length(value).between(lo, hi)


def build_audit(sites: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of sites without a build (no files at all) or without a page in it.

    ``files`` has (site, href) of whatever was built.
    """
    seen = files.groupBy("site").agg(F.max(F.lower("href").rlike(r"\.html?\z")).alias("has_page"))
    rows = sites.select("site").distinct().join(seen, "site", "left").withColumn("pathname", F.lit("/"))
    return _rules(rows, [(F.col("has_page").isNull(), "no-dist", "error"), (~F.col("has_page"), "no-html", "warning")])


def audited(head: Column) -> Column:
    """Pages the audit looks at: no redirect, not opted out of Markdown, indexable."""
    opted = F.coalesce(head["opt_out"].rlike(r"(?i)\b(skip|no-dotmd)\b"), F.lit(False))
    return ~head["refresh"] & ~opted & ~text.noindex(head["robots"], also_none=True)


def missing_alt(html: Column) -> Column:
    """Number of ``<img>`` without an ``alt`` attribute."""
    images = F.regexp_extract_all(html, F.lit(r"""(?i)<img\b(?:"[^"]*"|'[^']*'|[^>"'])*>"""), F.lit(0))
    return F.size(F.filter(images, lambda t: ~t.rlike(r"(?i)(^|\s)alt\s*=")))


def markdown_links(links: Column) -> Column:
    """Number of alternate links to Markdown."""
    def one(link: Column) -> Column:
        rel = F.split(F.lower(F.coalesce(link["rel"], F.lit(""))), r"\s+")
        return F.array_contains(rel, "alternate") & (F.lower(F.trim(F.coalesce(link["type"], F.lit("")))) == "text/markdown")

    return F.size(F.filter(links, one))


def page_audit(pages: DataFrame) -> DataFrame:
    """Findings of (site, pathname, html, head): titles, images, social tags, robots, alternates."""
    h = F.col("head")
    social = h["og_title"].isNotNull()
    alternates = markdown_links(h["links"])
    rules = [
        ((h["title"] == "") | _outside(h["title"], 30, 60), "title-length", "warning"),
        (missing_alt(F.col("html")) > 0, "img-missing-alt", "error"),
        (social & _outside(F.trim(h["og_title"]), 10, 70), "og-title-length", "warning"),
        (social & _outside(F.trim(h["og_description"]), 50, 200), "og-description-length", "warning"),
        (social & (F.lower(F.trim(h["twitter_card"])) != "summary_large_image"), "twitter-card-type", "warning"),
        (social & h["og_image"].isNull(), "og-image-missing", "warning"),
        (social & ~F.trim(h["og_image"]).rlike(r"(?i)\Ahttps?://"), "og-image-relative", "warning"),
        (h["robots"].isNull(), "robots-meta-missing", "warning"),
        (alternates == 0, "no-alternate-link", "warning"),
        (alternates > 1, "duplicate-alternate-link", "warning"),
    ]
    return _rules(pages.filter(audited(h)), rules)


def index_audit(index: DataFrame) -> DataFrame:
    """Findings of index texts (site, body): heading, sections, entries."""
    lines = text.split_lines(F.col("body"))
    first = F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0))
    heads = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))))
    filled = F.exists(lines, lambda x: F.startswith(x, F.lit("## ")) | x.rlike(r"\A-\s+\[.+\]\(.+\)"))
    rules = [
        (~F.coalesce(F.startswith(first, F.lit("# ")), F.lit(False)), "llms-no-h1", "error"),
        (heads > 1, "llms-multiple-h1", "warning"),
        (~filled, "llms-empty", "warning"),
    ]
    return _rules(index.withColumn("pathname", F.lit("/llms.txt")), rules)


def full_audit(sites: DataFrame) -> DataFrame:
    """Findings of (site, index_body, full_body): missing, empty, without separators."""
    full = F.col("full_body")
    rules = [
        (F.col("index_body").isNull(), "no-llms", "warning"),
        (F.col("index_body").isNotNull() & full.isNull(), "no-llms-full", "warning"),
        (F.trim(full) == "", "empty-llms-full", "warning"),
        ((F.trim(full) != "") & ~F.contains(full, F.lit("\n---")), "llms-full-separators", "warning"),
    ]
    return _rules(sites.withColumn("pathname", F.lit("/llms-full.txt")), rules)


def index_links(index: DataFrame) -> DataFrame:
    """(site, href) of Markdown links in the entries of index texts."""
    found = F.regexp_extract_all("body", F.lit(r"(?m)^-\s+\[[^\]]*\]\(([^)]+\.md)\)"), F.lit(1))
    return index.select("site", F.explode(found).alias("href")).distinct()


def missing_files(links: DataFrame, files: DataFrame, base: str = "") -> DataFrame:
    """Links to Markdown files that are not there."""
    from ..functions import paths

    here = links.withColumn("file", paths.without_base(F.col("href"), base))
    gone = here.join(files.select("site", F.col("href").alias("file")).distinct(), ["site", "file"], "left_anti")
    return gone.select("site", F.lit("audit").alias("producer"), F.lit("missing-md").alias("code"), F.lit("error").alias("severity"), F.col("href").alias("pathname"))


def orphan_files(links: DataFrame, files: DataFrame, opted_out: DataFrame, base: str = "") -> DataFrame:
    """Markdown files that no entry refers to and no page opted out of."""
    from ..functions import paths

    linked = links.select("site", paths.without_base(F.col("href"), base).alias("href")).unionByName(links.select("site", "href")).distinct()
    left = files.select("site", "href").join(linked, ["site", "href"], "left_anti").join(opted_out.select("site", "href").distinct(), ["site", "href"], "left_anti")
    return left.select("site", F.lit("audit").alias("producer"), F.lit("orphan-md").alias("code"), F.lit("warning").alias("severity"), F.col("href").alias("pathname"))


def robots_audit(robots: DataFrame) -> DataFrame:
    """Findings of robots files (site, body), a line at a time."""
    lines = robots.select("site", F.posexplode(text.split_lines(F.col("body"))).alias("n", "raw"))
    line = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\s+#.*\z", ""), r"\A\s+|\s+\z", ""))
    lines = lines.withColumn("line", line).filter("line != '' AND NOT startswith(line, '#')")
    agent = F.trim(F.regexp_extract("line", r"(?i)\AUser-agent\s*:\s*(.+)\z", 1))
    sitemap = F.trim(F.regexp_extract("line", r"(?i)\ASitemap\s*:\s*(.+)\z", 1))
    per_line = _rules(
        lines.withColumn("pathname", F.lit("/robots.txt")),
        [
            (~F.col("line").rlike(r"(?i)\A(User-agent|Allow|Disallow|Sitemap|Crawl-delay|Host)\s*:"), "robots-unknown-line", "warning"),
            ((sitemap != "") & ~sitemap.rlike(r"(?i)\Ahttps?://"), "robots-relative-sitemap", "warning"),
        ],
    )
    agents = lines.groupBy("site").agg(F.max(agent != "").alias("some"), F.max(agent == "*").alias("star")).withColumn("pathname", F.lit("/robots.txt"))
    return per_line.unionByName(_rules(agents, [(F.col("some") & ~F.col("star"), "robots-no-wildcard", "warning")]))


def profile_audit(profiles: DataFrame) -> DataFrame:
    """Findings of domain profiles (site, body): JSON, fields, absolute URLs."""
    v = F.try_parse_json(F.col("body"))
    get = lambda k: F.try_variant_get(v, f"$['{k}']", "string")
    rules = [(v.isNull(), "dp-invalid-json", "error")]
    rules += [(v.isNotNull() & (F.coalesce(get(k), F.lit("")) == ""), "dp-missing-field", "error") for k in ("@context", "@type", "name")]
    rules += [((get(k) != "") & ~get(k).rlike(r"(?i)\Ahttps?://"), "dp-relative-url", "warning") for k in ("url", "logo")]
    return _rules(profiles.withColumn("pathname", F.lit("/.well-known/domain-profile.json")), rules)


def head_conflicts(tags: DataFrame) -> DataFrame:
    """(site, pathname, key, code): head keys that stand twice, equal or not.

    Tags are (site, pathname, key, value); families that may repeat are exempt.
    """
    counted = tags.filter(~F.col("key").rlike(r"\A(og:image|og:locale:alternate|article:author|article:tag|theme-color)")).groupBy("site", "pathname", "key")
    found = counted.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("value", F.lit(""))).alias("values")).filter("n > 1")
    return found.select("site", "pathname", "key", F.when(F.col("values") > 1, "metadata-conflict").otherwise("metadata-duplicate").alias("code"))


def head_keys(pages: DataFrame) -> DataFrame:
    """Tags of heads as (site, pathname, key, value)."""
    metas = pages.select("site", "pathname", F.explode("head.metas").alias("m"))
    key = F.lower(F.coalesce("m.property", "m.name"))
    return metas.filter(key.isNotNull()).select("site", "pathname", key.alias("key"), F.col("m.content").alias("value"))


def canonical_vote(links: DataFrame) -> DataFrame:
    """(site, pathname, canonical, conflict) of valid canonical links: one decides, more conflict."""
    found = links.filter("canonical IS NOT NULL").groupBy("site", "pathname").agg(F.min("canonical").alias("low"), F.max("canonical").alias("high"))
    return found.select("site", "pathname", F.when(F.col("low") == F.col("high"), F.col("low")).alias("canonical"), (F.col("low") != F.col("high")).alias("conflict"))


def distinct(findings: DataFrame, keys: Sequence[str] = ("site", "code", "severity", "pathname")) -> DataFrame:
    return findings.dropDuplicates(list(keys))


def verdict(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, errors, warnings, pages_checked, ok) of every site with a page."""
    counted = findings.groupBy("site").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    checked = pages.groupBy("site").agg(F.count_if(audited(F.col("head"))).alias("pages_checked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return checked.join(counted, "site", "left").select("site", zero("errors"), zero("warnings"), "pages_checked", (F.coalesce("errors", F.lit(0)) == 0).alias("ok"))


def gate(findings: DataFrame, fail_on: str = "error", mandatory: Sequence[str] = ()) -> DataFrame:
    """(site, blocked): a finding of the level, or of a mandatory code, blocks."""
    levels = {"error": ["error"], "warning": ["error", "warning"], "never": []}[fail_on]
    hit = F.col("severity").isin(levels) if levels else F.lit(False)
    if mandatory:
        hit = hit | F.col("code").isin(list(mandatory))
    return findings.groupBy("site").agg(F.max(hit).alias("blocked"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def report(verdicts: DataFrame, strict: bool = False) -> DataFrame:
    """(site, line): a sentence for each site; ``strict`` counts warnings as failures."""
    failed = ~F.col("ok") | (F.lit(strict) & (F.col("warnings") > 0))
    return verdicts.select(
        "site",
        F.format_string("validate: %d error(s), %d warning(s) across %d page(s) - %s", "errors", "warnings", "pages_checked", F.when(failed, "FAIL").otherwise("PASS")).alias("line"),
    )
