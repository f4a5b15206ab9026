"""JSON-LD components and descriptor documents as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def article(headline: Column, url: Column, published: Column, modified: Column, author: Column, kind: str = "Article") -> Column:
    person = F.when(author.isNotNull(), F.struct(F.lit("Person").alias("@type"), author.alias("name")))
    return F.to_json(
        F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), headline.alias("headline"), url.alias("url"), published.alias("datePublished"), modified.alias("dateModified"), person.alias("author"))
    )


def organization(name: Column, url: Column, site: Column, logo: Column, same_as: Column) -> Column:
    """An organisation; without an id of its own it gets the site's."""
    own = F.concat(F.regexp_replace(site, r"/\z", ""), F.lit("/#organization"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), own.alias("@id"), name.alias("name"), url.alias("url"), logo.alias("logo"), same_as.alias("sameAs")))


def faq(items: DataFrame) -> DataFrame:
    """(site, pathname, entity) of (site, pathname, ord, question, answer)."""
    answer = F.struct(F.lit("Answer").alias("@type"), F.col("answer").alias("text"))
    entry = F.struct(F.col("ord"), F.struct(F.lit("Question").alias("@type"), F.col("question").alias("name"), answer.alias("acceptedAnswer")).alias("q"))
    grouped = items.groupBy("site", "pathname").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["q"]).alias("all"))
    return grouped.select("site", "pathname", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.col("all").alias("mainEntity"))).alias("entity"))


def how_to(steps: DataFrame) -> DataFrame:
    """(site, pathname, entity) of (site, pathname, ord, name, text): steps numbered in order."""
    entry = F.struct("ord", "name", "text")
    numbered = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda x, i: F.struct(F.lit("HowToStep").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["text"].alias("text")),
    )
    grouped = steps.groupBy("site", "pathname").agg(numbered.alias("all"))
    return grouped.select("site", "pathname", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("HowTo").alias("@type"), F.col("all").alias("step"))).alias("entity"))


def speakable(url: Column, selectors: Column) -> Column:
    spec = F.struct(F.lit("SpeakableSpecification").alias("@type"), selectors.alias("cssSelector"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebPage").alias("@type"), url.alias("url"), spec.alias("speakable")))


def script(entity: Column) -> Column:
    """A JSON text that may stand inside an HTML script."""
    out = entity
    for char in "<\u2028\u2029":
        out = F.replace(out, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return out


def descriptor_document(title: Column, description: Column, language: Column) -> Column:
    """A minimal page for what only a catalog knows."""
    lang = F.when(F.coalesce(language, F.lit("")) != "", F.concat(F.lit(' lang="'), text.escape_attribute(language), F.lit('"'))).otherwise("")
    about = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit('<meta name="description" content="'), text.escape_attribute(description), F.lit('">'))).otherwise("")
    return F.concat(F.lit("<!doctype html><html"), lang, F.lit("><head><title>"), text.escape_text(F.coalesce(title, F.lit(""))), F.lit("</title>"), about, F.lit("</head><body></body></html>"))


def page_helper(df: DataFrame, defaults: dict[str, str | None]) -> DataFrame:
    """Authored page rows with defaults where a value is absent, directives all present."""
    for name, value in defaults.items():
        now = F.col(name) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.coalesce(now, F.lit(value).cast("string")))
    return df
