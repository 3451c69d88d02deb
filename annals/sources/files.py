"""File sources: each a DataFrame over a path that Spark reads, compressed files included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = "struct<kind:string, year:int, month:int, day:int, start_year:int, end_year:int, surface:string>"
RECORD = (
    "external_id string, title string, text string, language string, canonical_url string, document_type string, "
    f"published {TIME}, contributors array<string>, external_ids array<array<string>>, license string, provider_metadata string"
)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Dump records from JSON lines, with line (the raw line), usable and broken. Blank lines are skipped; broken lines stay as rows with broken = true."""
    rows = spark.read.schema(f"{RECORD}, line string").option("columnNameOfCorruptRecord", "line").json(path)
    return with_flags(rows)


def with_flags(rows: DataFrame) -> DataFrame:
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return rows.withColumns(
        {
            "document_type": F.coalesce("document_type", F.lit("unspecified")),
            "broken": F.col("line").isNotNull(),
            "usable": F.col("line").isNull() & full(F.col("external_id")) & full(F.col("text")),
        }
    )


def plan(rows: DataFrame, language: str | None = None, subject: str | None = None) -> DataFrame:
    """Adds what ingest does with each record: broken, unusable, other_language, off_subject or ingest."""
    status = F.when(F.col("broken"), "broken").when(~F.col("usable"), "unusable")
    if language is not None:
        status = status.when(F.lower("language") != language.lower(), "other_language")  # records without a language pass
    if subject is not None:
        both = F.lower(F.concat_ws(" ", "title", "text"))
        status = status.when(~F.contains(both, F.lit(subject.lower())), "off_subject")
    return rows.withColumn("plan", status.otherwise("ingest"))


def multistream_index(spark: SparkSession, path: str) -> DataFrame:
    """offset, page_id, title of ``offset:page_id:title`` lines; titles may hold colons, bad numbers count as 0, rows without a title are skipped."""
    f = F.split(F.trim("value"), ":", 3)
    rows = spark.read.text(path).select(f.alias("f")).filter("size(f) = 3 and f[2] <> ''")
    number = lambda i: F.coalesce(F.expr(f"try_cast(f[{i}] as bigint)"), F.lit(0)).cast("long")
    return rows.select(number(0).alias("offset"), number(1).alias("page_id"), F.col("f")[2].alias("title"))


def wiki_pages(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """page_id, title, revision_id, text of article pages in MediaWiki XML; with wanted (page_id), only those."""
    schema = "title string, ns int, id long, revision struct<id:long, text:string>"
    rows = spark.read.schema(schema).option("rowTag", "page").xml(path).filter("ns = 0")
    rows = rows.select(F.col("id").alias("page_id"), "title", F.col("revision.id").alias("revision_id"), F.col("revision.text").alias("text"))
    return rows if wanted is None else rows.join(wanted.select("page_id"), "page_id", "left_semi")


def dump_date(name: Column) -> Column:
    """The date of eight digits in a file name; null without one."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(?:^|[^0-9])([0-9]{8})(?:[^0-9]|$)", 1), F.lit("")), "yyyyMMdd")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """title of each line that is neither blank nor a comment."""
    return spark.read.text(path).select(F.trim("value").alias("title")).filter("title <> '' and not startswith(title, '#')")


ENTITY = (
    "type string, id string, labels map<string, struct<language:string, value:string>>, "
    "claims map<string, array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>, sitelinks map<string, struct<title:string>>"
)


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Items of an entity dump: one JSON object a line, with or without the brackets and commas of an array."""
    line = F.regexp_replace(F.trim("value"), r"\s*,+\s*$", "")
    rows = spark.read.text(path).select(line.alias("line")).filter("line not in ('', '[', ']')")
    return rows.select(F.from_json("line", ENTITY).alias("e")).select("e.*").filter("type = 'item'")


def _values(prop: str) -> Column:
    return F.transform(F.coalesce(F.try_element_at("claims", F.lit(prop)), F.array()), lambda c: c["mainsnak"]["datavalue"]["value"])


def claim_year(prop: str) -> Column:
    """The first year of a time claim."""
    years = F.transform(_values(prop), lambda v: F.regexp_extract(F.coalesce(F.get_json_object(v, "$.time"), F.lit("")), r"^\+?(-?[0-9]+)-", 1))
    return F.try_element_at(F.filter(years, lambda y: y != ""), F.lit(1)).cast("int")


def humans(items: DataFrame, languages: tuple[str, ...] = ("en", "fr")) -> DataFrame:
    """qid, label, birth_year, death_year, occupations (label, or qid where no item of the dump has one), sitelinks of people.

    Labels of occupations come from a join, so their order in the dump doesn't matter.
    """
    best = F.coalesce(*[F.try_element_at("labels", F.lit(x))["value"] for x in languages], F.try_element_at(F.map_values("labels"), F.lit(1))["value"], F.col("id"))
    labels = items.select(F.col("id").alias("occupation"), best.alias("occupation_label"))
    ids = lambda p: F.transform(_values(p), lambda v: F.get_json_object(v, "$.id"))
    people = items.filter(F.array_contains(ids("P31"), "Q5")).select(
        F.col("id").alias("qid"), best.alias("label"), claim_year("P569").alias("birth_year"), claim_year("P570").alias("death_year"), F.explode_outer(ids("P106")).alias("occupation"),
        F.to_json(F.transform_values("sitelinks", lambda k, v: v["title"])).alias("sitelinks"),
    )
    known = people.join(labels, "occupation", "left").withColumn("occupation", F.coalesce("occupation_label", "occupation"))
    return known.groupBy("qid", "label", "birth_year", "death_year", "sitelinks").agg(F.sort_array(F.collect_set("occupation")).alias("occupations"))


CELL = "struct<type:string, value:string>"
NAMES = ("event", "battle", "eventLabel", "battleLabel", "date", "place", "placeLabel", "evType", "geo", "pgeo")
BINDINGS = f"results struct<bindings:array<struct<{', '.join(f'{n}:{CELL}' for n in NAMES)}>>>"


def sparql_events(spark: SparkSession, path: str) -> DataFrame:
    """event_id, label, date, place_label, kind, lat, lon of query results; each event once, rows without an event or date are dropped."""
    rows = spark.read.schema(BINDINGS).option("multiLine", "true").json(path).select(F.inline("results.bindings"))
    value = lambda *names: F.coalesce(*[F.nullif(F.col(f"{n}.value"), F.lit("")) for n in names])
    point = value("geo", "pgeo")
    number = lambda i: F.nullif(F.regexp_extract(point, r"Point\(\s*(\S+)\s+(\S+)\s*\)", i), F.lit("")).cast("double")
    ident = F.nullif(F.regexp_extract(value("event", "battle"), r"([^/]+)$", 1), F.lit(""))
    date = F.nullif(F.regexp_extract(value("date"), r"^\+?(.{4}-.{5})", 1), F.lit(""))
    rows = rows.select(
        ident.alias("event_id"), F.coalesce(value("eventLabel", "battleLabel"), ident).alias("label"), date.alias("date"), value("placeLabel").alias("place_label"),
        F.coalesce(value("evType"), F.lit("historical_fact")).alias("kind"), number(2).alias("lat"), number(1).alias("lon"),
    ).filter("event_id is not null and date is not null")
    first = F.min(F.struct("date", "label", "place_label", "kind", "lat", "lon")).alias("x")
    return rows.groupBy("event_id").agg(first).select("event_id", "x.label", "x.date", "x.place_label", "x.kind", "x.lat", "x.lon")


WORK = (
    "id string, doi string, title string, display_name string, publication_year int, type string, language string, open_access struct<oa_status:string, oa_url:string>, "
    "authorships array<struct<author:struct<display_name:string, orcid:string>>>, abstract_inverted_index map<string, array<long>>"
)


def works(spark: SparkSession, path: str) -> DataFrame:
    """Bibliographic works, normalised: external_id, title, abstract rebuilt from its inverted index, year, document_type, academic_status, authors, doi."""
    w = spark.read.schema(f"results array<struct<{_struct(WORK)}>>").option("multiLine", "true").json(path).select(F.inline("results"))
    slots = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    abstract = F.array_join(F.transform(F.array_sort(slots), lambda s: s["word"]), " ")
    kind = F.lower(F.coalesce("type", F.lit("article")))
    title = F.trim(F.coalesce("display_name", "title", F.lit("")))
    return w.select(
        F.col("id").alias("external_id"), title.alias("title"), F.nullif(abstract, F.lit("")).alias("abstract"), F.col("publication_year").alias("year"),
        F.when(kind == "dissertation", "thesis").when(kind.isin("book", "book-chapter"), "bibliographic_notice").otherwise("academic_article").alias("document_type"),
        F.when(kind == "dissertation", "doctoral_defended").when(kind == "preprint", "academic_unreviewed").otherwise("peer_reviewed").alias("academic_status"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.lower(F.regexp_replace("doi", "^https?://doi[.]org/", "")).alias("doi"),
    ).filter("external_id is not null and title <> ''")


def _struct(ddl: str) -> str:
    """Fields of a table schema as those of a struct."""
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)
