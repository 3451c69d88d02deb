"""Catalogue answers as rows: records of library catalogues, with a notice about the subject that was searched for.

Payloads are one record a row: JSON objects, or XML of one record. Rows without an identifier are left out; broken
payloads have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals.functions.place import best_in_text
from annals.functions.text import fold


def json_first(payload: Column, *names: str) -> Column:
    """The first of the fields with a text: a string or number, the first such item of an array, or of an object the entry def, en or any."""

    def field(name: str) -> Column:
        raw = F.get_json_object(payload, f"$.{name}")
        some = lambda c: F.nullif(c, F.lit(""))
        items = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull() & (x != ""))
        entry = F.from_json(F.when(F.startswith(raw, F.lit("{")), raw), "map<string,string>")
        listed = F.try_element_at(items, F.lit(1))
        named = F.coalesce(F.try_element_at(entry, F.lit("def")), F.try_element_at(entry, F.lit("en")), F.try_element_at(F.map_values(entry), F.lit(1)))
        return F.when(F.startswith(raw, F.lit("[")), listed).when(F.startswith(raw, F.lit("{")), some(named)).otherwise(some(raw))

    return F.coalesce(*[field(n) for n in names])


def json_texts(payload: Column, name: str) -> Column:
    """Array of the texts of an array field, empty without one."""
    items = F.filter(F.from_json(F.get_json_object(payload, f"$.{name}"), "array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(items, F.array().cast("array<string>"))


def xml_texts(record: Column, tag: str) -> Column:
    """Array of the texts of the elements, entities decoded, empty ones left out."""
    found = F.regexp_extract_all(record, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)

    def decoded(x: Column) -> Column:
        for name, c in (("&quot;", '"'), ("&amp;", "&"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
            x = F.replace(x, F.lit(name), F.lit(c))
        return F.regexp_replace(x, r"^\s+|\s+$", "")

    return F.filter(F.transform(found, decoded), lambda x: x != "")


def first(texts: Column) -> Column:
    return F.try_element_at(texts, F.lit(1))


def catalog_year(text: Column) -> Column:
    """The first four digits of a text, from 1000 to 2100."""
    digits = F.substring(F.regexp_replace(text, "[^0-9]", ""), 1, 4)
    return F.when(F.length(digits) == 4, F.when(digits.cast("int").between(1000, 2100), digits.cast("int")))


def names_match(person: Column, candidate: Column) -> Column:
    """Whether one name has the other, without accents and case."""
    p, c = fold(person), fold(candidate)
    return (p != "") & (F.contains(c, p) | F.contains(p, c))


def within_life(year: Column, birth: Column, death: Column) -> Column:
    """From five years before birth to two after death; with neither known from 1000 to 2100."""
    known = (birth.isNull() | (year >= birth - 5)) & (death.isNull() | (year <= death + 2))
    return F.when(birth.isNull() & death.isNull(), year.between(1000, 2100)).otherwise(known)


def notice(subject: Column, title: Column, year: Column, place: Column, description: Column, authored: Column) -> Column:
    """What the record says: who published what, when and where, if the subject is an author; else the title. The description follows on a line."""
    told = F.concat(subject, F.lit(' published "'), title, F.lit('" in '), year.cast("string"), F.coalesce(F.concat(F.lit(" in "), F.nullif(place, F.lit(""))), F.lit("")), F.lit("."))
    return F.concat_ws("\n", F.when(authored & year.isNotNull(), told).otherwise(title), F.nullif(F.trim(description), F.lit("")))


def noticed(rows: DataFrame, high: int, low: int) -> DataFrame:
    """rows (subject, birth_year, death_year, external_id, title, year, authors, place, description, ...) as notices: works that the subject
    would have written outside their life are left out; relevance in hundredths, high for authors."""
    rows = rows.filter("external_id <> ''").withColumn("authored", F.exists("authors", lambda a: names_match(F.col("subject"), a)))
    rows = rows.filter(~F.coalesce(F.col("authored") & ~within_life(F.col("year"), F.col("birth_year"), F.col("death_year")), F.lit(False)))
    rows = rows.withColumn("place", best_in_text(F.col("place"), "title"))
    return rows.select(
        "subject", "external_id", "url", "title", "language", "year", "place", "authored", F.when(F.col("authored"), high).otherwise(low).alias("relevance"),
        notice(F.col("subject"), F.col("title"), F.col("year"), F.col("place"), F.col("description"), F.col("authored")).alias("notice"),
    )


def editions(answers: DataFrame) -> DataFrame:
    """Search answers of an edition catalogue (subject, birth_year, death_year, payload: one item of docs) as notices."""
    p = F.col("payload")
    year = F.coalesce(F.get_json_object(p, "$.first_publish_year").try_cast("int"), catalog_year(json_first(p, "publish_year")))
    rows = answers.select(
        "subject", "birth_year", "death_year", F.coalesce(F.get_json_object(p, "$.key"), F.lit("")).alias("external_id"), F.coalesce(json_first(p, "title"), F.lit("Untitled")).alias("title"), year.alias("year"),
        json_texts(p, "author_name").alias("authors"), json_first(p, "publish_place", "place").alias("place"), json_first(p, "subtitle").alias("description"), json_first(p, "language").alias("language"),
    )
    return noticed(rows.withColumn("url", F.concat(F.lit("https://openlibrary.org"), "external_id")), 82, 55)


def digitized(answers: DataFrame) -> DataFrame:
    """Dublin Core records of a digital library (subject, birth_year, death_year, payload: XML of one record) as notices."""
    of = lambda tag: xml_texts(F.col("payload"), f"dc:{tag}")
    idents = of("identifier")
    ident = F.coalesce(first(F.filter(idents, lambda x: F.contains(x, F.lit("gallica.bnf.fr")) | F.contains(x, F.lit("ark:")))), first(idents), F.lit(""))
    rows = answers.select(
        "subject", "birth_year", "death_year", ident.alias("external_id"), ident.alias("url"), F.coalesce(first(of("title")), F.lit("Sans titre")).alias("title"),
        first(F.filter(F.transform(of("date"), catalog_year), lambda y: y.isNotNull())).alias("year"), of("creator").alias("authors"), F.coalesce(first(of("coverage")), first(of("publisher"))).alias("place"),
        first(of("description")).alias("description"), first(of("language")).alias("language"),
    )
    return noticed(rows, 80, 54)


def heritage_items(payload: DataFrame) -> DataFrame:
    """Items of a heritage portal (payload: JSON, the item itself or below object): external_id, url, title, description, creator, year, language, kind, publisher."""
    p = F.coalesce(F.get_json_object("payload", "$.object"), F.col("payload"))
    rows = payload.select(
        json_first(p, "id").alias("external_id"), json_first(p, "edmIsShownAt", "guid", "edmIsShownBy").alias("url"), json_first(p, "title", "dcTitle").alias("title"),
        json_first(p, "dcDescription", "description").alias("description"), json_first(p, "dcCreator", "creator").alias("creator"), catalog_year(json_first(p, "year")).alias("year"),
        json_first(p, "language", "dcLanguage").alias("language"), json_first(p, "type").alias("kind"), json_first(p, "dataProvider", "provider").alias("publisher"),
    )
    rows = rows.withColumn("url", F.coalesce("url", F.concat(F.lit("https://www.europeana.eu/item"), "external_id")))
    return rows.filter("external_id is not null and title is not null")


def archive_items(payload: DataFrame) -> DataFrame:
    """Items of a web archive's library (payload: JSON, fields at the top or below metadata), with the same columns."""
    p = F.coalesce(F.get_json_object("payload", "$.metadata"), F.col("payload"))
    ident = F.coalesce(json_first(F.col("payload"), "identifier"), json_first(p, "identifier"))
    rows = payload.select(
        ident.alias("external_id"), F.concat(F.lit("https://archive.org/details/"), ident).alias("url"), json_first(p, "title").alias("title"), json_first(p, "description").alias("description"),
        json_first(p, "creator").alias("creator"), catalog_year(json_first(p, "year", "date")).alias("year"), json_first(p, "language").alias("language"), json_first(p, "mediatype").alias("kind"),
        F.lit(None).cast("string").alias("publisher"),
    )
    return rows.filter("external_id is not null and title is not null")
