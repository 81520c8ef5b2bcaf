"""Works of a bibliographic service, from its JSON: flat metadata, references, abstracts, and encoded names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORK = (
    "id string, title string, doi string, cited_by_count long, publication_year string, publication_date string, concepts array<struct<display_name:string>>, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, referenced_works array<string>, "
    "abstract_inverted_index map<string,array<int>>"
)


def extract_id(url: Column) -> Column:
    """The last segment of a path, without blanks around it."""
    return F.trim(F.substring_index(url, "/", -1))


def url_encode(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``-._~`` alone."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_doi(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^https?://(dx\.)?doi\.org/", "")


def abstract(index: Column) -> Column:
    """Text from a map of words to their positions; gaps are empty, blanks at the ends are dropped."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("at"), e.key.alias("word")))))
    # Sorted by place, each word fills the gap up to its own: as many separators as places passed.
    ordered = F.array_sort(places)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda s, p: F.struct(p.at.alias("at"), F.concat(s.text, F.repeat(F.lit(" "), p.at - s.at), p.word).alias("text"))
    return F.trim(F.aggregate(ordered, start, step, lambda s: s.text))


def paper_metadata(works: DataFrame, body: str = "body", key: str = "node_id") -> DataFrame:
    """One flat row a work from its JSON text; a work that could not be fetched (null or no JSON) has placeholders."""
    w = F.from_json(body, WORK)
    df = works.select(F.col(key).alias("id"), w.alias("w"), F.try_parse_json(body).isNotNull().alias("ok"))
    name = F.col("w.authorships")[0]["author"]["display_name"]
    author = F.when(F.size("w.authorships") > 1, F.concat(F.coalesce(name, F.lit("Unknown")), F.lit(" et al."))).when(F.size("w.authorships") == 1, F.coalesce(name, F.lit("Unknown"))).otherwise("Unknown")
    venue = F.when(F.col("w.primary_location.source").isNotNull(), F.coalesce("w.primary_location.source.display_name", F.lit("Unknown Venue"))).otherwise("N/A")
    text = F.when(F.size("w.abstract_inverted_index") > 0, abstract(F.col("w.abstract_inverted_index")))
    either = lambda c, missing, failed: F.when(F.col("ok"), F.coalesce(c, F.lit(missing))).otherwise(F.lit(failed))
    return df.select(
        "id", either(F.col("w.title"), "Untitled", "Fetch Failed").alias("title"), either(F.col("w.doi"), "N/A", "N/A").alias("doi"), either(F.col("w.cited_by_count"), 0, 0).alias("citations"),
        either(F.col("w.publication_year"), "N/A", "N/A").alias("year"), either(F.col("w.publication_date"), "N/A", "N/A").alias("date"), either(author, "Unknown", "Unknown").alias("author"), either(venue, "N/A", "N/A").alias("journal"),
        F.coalesce(F.transform(F.slice("w.concepts", 1, 5), lambda c: c.display_name), F.array().cast("array<string>")).alias("concepts"),
        F.coalesce(F.transform("w.referenced_works", extract_id), F.array().cast("array<string>")).alias("references"), F.coalesce(text, F.lit("No abstract.")).alias("abstract"),
    )
