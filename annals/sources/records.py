"""Bibliographic records with nested parts: theses, deposits, and Dublin Core from library answers. One shape for all:

external_id, canonical_url, document_type, title, language, abstract_text, academic_status, access_level,
full_text_available, publisher_or_institution, year, identifiers, contributions, subjects, snapshot_text,
problem. ``problem`` is null for a record that can be used, else what it lacks (broken, no identifier,
no title). The arrays are exploded by ``parts``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals.functions.ident import normalize_identifier
from annals.functions.place import LOWER, UPPER

# Fixed values.
THESIS_PEOPLE = [("auteurs", "author"), ("directeurs", "thesis_advisor"), ("membresJury", "jury_member"), ("rapporteurs", "rapporteur")]
THESIS_BODIES = [("etabCotutelle", "cotutelle_institution"), ("ecolesDoctorales", "doctoral_school"), ("partenairesRecherche", "research_partner")]
DEPOSIT_TYPES = {"THESE": "thesis", "HDR": "thesis", "BOOK": "bibliographic_notice", "COUV": "bibliographic_notice", "DOUV": "bibliographic_notice", "CHAPTER": "bibliographic_notice"}

PERSON, BODY, TOPIC = "struct<nom: string, prenom: string, ppn: string>", "struct<nom: string, ppn: string>", "struct<keyword: string, libelle: string, ppn: string, query: string>"
THESIS = (
    "struct<nnt: string, id: string, numSujet: string, doi: string, titrePrincipal: string, status: string, isSoutenue: boolean, accessible: string, resumes: struct<fr: string, en: string>, langues: array<string>,"
    f" etabSoutenance: {BODY}, dateSoutenance: string, datePremiereInscriptionDoctorat: string, presidentJury: {PERSON}, mapSujets: map<string, array<{TOPIC}>>, sujetsRameau: array<{TOPIC}>, sujets: array<{TOPIC}>,"
    + ", ".join([f"{k}: array<{PERSON}>" for k, _ in THESIS_PEOPLE] + [f"{k}: array<{BODY}>" for k, _ in THESIS_BODIES])
    + ", _broken: string>"
)
IDENTIFIERS = "array<struct<scheme: string, value_raw: string, value: string>>"
CONTRIBUTIONS = "array<struct<role: string, name: string, name_normalized: string, identifier_scheme: string, identifier: string, ordinal: int>>"
SUBJECTS = "array<struct<scheme: string, label: string, identifier: string>>"
SHAPE = [
    "external_id", "canonical_url", "document_type", "title", "language", "abstract_text", "academic_status", "access_level", "full_text_available", "publisher_or_institution", "year",
    "identifiers", "contributions", "subjects", "snapshot_text", "problem",
]


def some(text: Column) -> Column:
    """Trimmed; null for empty."""
    return F.nullif(F.trim(text), F.lit(""))


def low(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def year_of(date: Column) -> Column:
    return F.regexp_extract(F.trim(date), "^([0-9]{4})", 1).try_cast("int")


def listed(values: Column, kind: str) -> Column:
    """The array without nulls, empty for null."""
    return F.coalesce(F.array_compact(values), F.array().cast(kind)).cast(kind)


def joined(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.concat(a, b), arrays)


def identifier(scheme: str, raw: Column) -> Column:
    value = normalize_identifier(F.lit(scheme), raw)
    return F.when(value.isNotNull(), F.struct(F.lit(scheme).alias("scheme"), F.trim(raw).alias("value_raw"), value.alias("value")))


def contribution(role: str, name: Column, normal: Column, ppn: Column, ordinal: Column) -> Column:
    number = normalize_identifier(F.lit("ppn"), ppn)
    return F.struct(
        F.lit(role).alias("role"), name.alias("name"), normal.alias("name_normalized"), F.when(number.isNotNull(), "ppn").alias("identifier_scheme"), number.alias("identifier"), ordinal.cast("int").alias("ordinal")
    )


def person(role: str, p: Column, ordinal: Column) -> Column:
    """A person with a first or last name; names are joined first name first, their normal form in lower case (A-Z)."""
    name = F.concat_ws(" ", some(p["prenom"]), some(p["nom"]))
    return F.when(name != "", contribution(role, name, low(name), p["ppn"], ordinal))


def body(role: str, b: Column, ordinal: Column) -> Column:
    return F.when(some(b["nom"]).isNotNull(), contribution(role, F.trim(b["nom"]), low(F.trim(b["nom"])), b["ppn"], ordinal))


def topic(scheme: Column, label: Column, ident: Column) -> Column:
    return F.when(some(label).isNotNull(), F.struct(scheme.alias("scheme"), F.trim(label).alias("label"), ident.alias("identifier")))


def snapshot(title: Column, abstract: Column, name: str, topics: Column) -> Column:
    """Lines that say what they hold; missing ones are left out."""
    told = F.concat(F.lit(f"{name}: "), F.nullif(topics, F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("TITLE: "), title), F.concat(F.lit("ABSTRACT: "), abstract), told)


def problems(broken: Column) -> Column:
    return F.when(broken, "broken").when(F.col("external_id").isNull(), "no identifier").when(F.col("title").isNull(), "no title")


def theses(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Thesis details (JSON, one a row) as records; the columns of rows stay."""
    t = F.from_json(payload, THESIS, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    out = rows.withColumn("_t", t)
    c = lambda name: F.col(f"_t.{name}")
    defended = F.coalesce(c("isSoutenue"), low(c("status")) == "soutenue", F.lit(False)) | F.coalesce(low(c("status")) == "soutenue", F.lit(False))
    going = F.coalesce(low(c("status")).isin("encours", "en_cours"), F.lit(False))
    status = F.when(defended, "doctoral_defended").when(going, "academic_unreviewed").otherwise("catalog_record")
    is_open = F.coalesce(low(c("accessible")) == "oui", F.lit(False))
    external = F.coalesce(some(c("nnt")), some(c("id")), some(c("numSujet")))
    each = lambda make, k, role: listed(F.transform(c(k), lambda x, i: make(role, x, i)), CONTRIBUTIONS)
    people, bodies = [each(person, k, role) for k, role in THESIS_PEOPLE], [each(body, k, role) for k, role in THESIS_BODIES]
    single = listed(F.array(person("jury_president", c("presidentJury"), F.lit(0)), body("institution", c("etabSoutenance"), F.lit(0))), CONTRIBUTIONS)
    keyed = F.array_sort(F.map_entries(c("mapSujets")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    scheme = lambda key: F.when(F.contains(low(key), F.lit("rameau")), "rameau").otherwise("keyword")
    mapped = F.flatten(F.transform(keyed, lambda e: F.transform(e["value"], lambda x: topic(scheme(e["key"]), F.coalesce(x["keyword"], x["libelle"]), F.coalesce(x["ppn"], x["query"])))))
    rameau = F.transform(c("sujetsRameau"), lambda x: topic(F.lit("rameau"), x["libelle"], x["ppn"]))
    words = F.transform(c("sujets"), lambda x: topic(F.lit("keyword"), F.coalesce(x["libelle"], x["keyword"]), F.lit(None).cast("string")))
    out = out.withColumns(
        {
            "external_id": external,
            "canonical_url": F.concat(F.lit("https://theses.fr/"), F.coalesce(F.nullif(c("nnt"), F.lit("")), external)),
            "document_type": F.when(defended, "thesis").otherwise("bibliographic_notice"),
            "title": some(c("titrePrincipal")),
            "language": F.try_element_at(c("langues"), F.lit(1)),
            "abstract_text": some(F.coalesce(c("resumes.fr"), c("resumes.en"))),
            "academic_status": status,
            "access_level": F.when(is_open, "open").otherwise("metadata_only"),
            "full_text_available": is_open,
            "publisher_or_institution": c("etabSoutenance.nom"),
            "year": year_of(F.coalesce(c("dateSoutenance"), c("datePremiereInscriptionDoctorat"))),
            "identifiers": listed(F.array(*[identifier(s, some(c(f))) for s, f in (("nnt", "nnt"), ("doi", "doi"), ("num_sujet", "numSujet"))]), IDENTIFIERS),
            "contributions": joined(*people, single, *bodies),
            "subjects": joined(*[listed(x, SUBJECTS) for x in (mapped, rameau, words)]),
        }
    )
    topics = F.array_join(F.transform("subjects", lambda s: F.concat_ws(":", s["scheme"], s["label"])), " | ")
    out = out.withColumns({"snapshot_text": snapshot(F.col("title"), F.col("abstract_text"), "SUBJECTS", topics), "problem": problems(c("_broken").isNotNull() | F.col("_t").isNull())})
    return out.select(*rows.columns, *SHAPE)


def texts(payload: Column, field: str) -> Column:
    """The texts of a JSON field that is an array or one text, trimmed, without empty ones."""
    raw = F.get_json_object(payload, f"$.{field}")
    many = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
    return F.filter(F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def deposits(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Documents of an open archive (JSON, one a row) as records; the columns of rows stay."""
    p = F.col(payload)
    field = lambda name: F.get_json_object(p, f"$.{name}")
    first = lambda name: F.try_element_at(texts(p, name), F.lit(1))
    is_open = F.coalesce(field("openAccess_bool") == "true", F.lit(False))
    kind = reduce(lambda a, kv: a.when(F.upper(field("docType_s")) == kv[0], kv[1]), list(DEPOSIT_TYPES.items())[1:], F.when(F.upper(field("docType_s")) == "THESE", "thesis"))
    access = F.when(is_open, "open").otherwise("metadata_only")
    none = F.lit(None).cast("string")
    author = lambda a, i: F.struct(F.lit("author").alias("role"), a.alias("name"), F.lower(a).alias("name_normalized"), none.alias("identifier_scheme"), none.alias("identifier"), i.cast("int").alias("ordinal"))
    own = F.struct(F.lit("hal_id").alias("scheme"), field("halId_s").alias("value_raw"), field("halId_s").alias("value"))
    out = rows.withColumns(
        {
            "external_id": F.nullif(field("halId_s"), F.lit("")), "canonical_url": field("uri_s"), "document_type": kind.otherwise("academic_article"), "title": first("title_s"), "language": field("language_s"),
            "abstract_text": first("abstract_s"), "academic_status": F.lit("peer_reviewed"), "access_level": access, "full_text_available": is_open, "publisher_or_institution": none,
            "year": year_of(field("producedDate_tdate")), "identifiers": listed(F.array(own, identifier("doi", first("doi_s"))), IDENTIFIERS),
            "contributions": F.transform(texts(p, "authFullName_s"), author).cast(CONTRIBUTIONS),
            "subjects": F.transform(texts(p, "keyword_s"), lambda k: F.struct(F.lit("keyword").alias("scheme"), k.alias("label"), none.alias("identifier"))).cast(SUBJECTS),
        }
    )
    topics = F.array_join(F.transform("subjects", lambda s: s["label"]), ", ")
    broken = F.try_parse_json(p).isNull()
    return out.withColumns({"snapshot_text": snapshot(F.col("title"), F.col("abstract_text"), "KEYWORDS", topics), "problem": problems(broken)}).select(*rows.columns, *SHAPE)


CORE = "struct<title: array<string>, creator: array<string>, subject: array<string>, description: array<string>, date: array<string>, publisher: array<string>, language: array<string>, identifier: array<string>>"
#: Answers of a search by URL, and of a harvest with its token for the next page.
SEARCH = f"records struct<record: array<struct<recordData: struct<dc: {CORE}>>>>, _broken string"
HARVEST = f"ListRecords struct<record: array<struct<header: struct<identifier: string>, metadata: struct<dc: {CORE}>>>, resumptionToken: string>, _broken string"


def dublin_core(answers: DataFrame, payload: str = "payload", harvest: bool = False) -> DataFrame:
    """Dublin Core records of XML answers (a page a row), read with a schema: one row a record, and one for a page that can't be read.

    The columns of answers stay; ``token`` is where a harvest goes on, null at its end. A search's
    records are library notices addressed by their ARK; a harvest's are articles addressed by the
    header, or else by their first identifier.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "valueTag": "_text"}
    page = answers.withColumn("_x", F.from_xml(payload, HARVEST if harvest else SEARCH, options))
    broken = F.col("_x").isNull() | F.col("_x._broken").isNotNull()
    found = F.col("_x.ListRecords.record") if harvest else F.col("_x.records.record")
    token = some(F.col("_x.ListRecords.resumptionToken")) if harvest else F.lit(None).cast("string")
    # what is read of the page as a whole comes first: its records would each carry all of it otherwise
    page = page.select(*answers.columns, broken.alias("_bad"), token.alias("token"), found.alias("_found"))
    rows = page.select(*answers.columns, "_bad", "token", F.explode_outer("_found").alias("_r"))
    rows = rows.filter(F.col("_bad") | F.col("_r").isNotNull())
    dc = F.col("_r.metadata.dc") if harvest else F.col("_r.recordData.dc")
    every = lambda name: F.filter(F.transform(F.coalesce(dc[name], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    first = lambda name: F.try_element_at(every(name), F.lit(1))
    ark = F.regexp_replace(F.regexp_extract(first("identifier"), "(ark:.*)$", 1), "/+$", "")
    external = F.coalesce(some(F.col("_r.header.identifier")), first("identifier")) if harvest else F.coalesce(F.nullif(ark, F.lit("")), first("identifier"))
    none = F.lit(None).cast("string")
    author = lambda a, i: F.struct(F.lit("author").alias("role"), a.alias("name"), low(a).alias("name_normalized"), none.alias("identifier_scheme"), none.alias("identifier"), i.cast("int").alias("ordinal"))
    authors = F.transform(every("creator") if harvest else F.slice(every("creator"), 1, 1), author).cast(CONTRIBUTIONS)
    own = lambda x: F.struct(F.when(F.startswith(x, F.lit("ark:")), "ark").otherwise("other").alias("scheme"), x.alias("value_raw"), low(x).alias("value"))
    subjects = F.transform(every("subject") if harvest else F.array().cast("array<string>"), lambda s: F.struct(F.lit("keyword").alias("scheme"), s.alias("label"), none.alias("identifier"))).cast(SUBJECTS)
    http = F.try_element_at(F.filter(every("identifier"), lambda x: F.startswith(x, F.lit("http"))), F.lit(1))
    out = rows.withColumns(
        {
            "external_id": external, "canonical_url": F.coalesce(http, F.when(~F.lit(harvest), F.concat(F.lit("https://catalogue.bnf.fr/"), external))), "document_type": F.lit("academic_article" if harvest else "bibliographic_notice"),
            "title": first("title"), "language": first("language"), "abstract_text": first("description"), "academic_status": F.lit("peer_reviewed" if harvest else "catalog_record"),
            "access_level": F.lit("open" if harvest else "metadata_only"), "full_text_available": F.lit(harvest), "publisher_or_institution": first("publisher"), "year": year_of(first("date")),
            "contributions": authors, "subjects": subjects,
        }
    )
    out = out.withColumn("identifiers", F.when(F.col("external_id").isNotNull(), F.array(own(F.col("external_id")))).otherwise(F.array()).cast(IDENTIFIERS))
    topics = F.array_join(F.transform("subjects", lambda s: s["label"]), ", ")
    text = snapshot(F.col("title"), F.col("abstract_text"), "KEYWORDS", topics) if harvest else F.concat_ws("\n\n", "title", "abstract_text")
    return out.withColumns({"snapshot_text": text, "problem": problems(F.col("_bad"))}).select(*answers.columns, "token", *SHAPE)


def parts(records: DataFrame, name: str) -> DataFrame:
    """external_id and the fields of each of the record's identifiers, contributions or subjects; records with a problem have none."""
    # no filter on what is read, nor one that the optimiser derives from an inner explosion: either would go below the reading and repeat it for each field it names
    usable = F.when(F.col("problem").isNull(), F.col(name))
    exploded = records.select("external_id", F.inline_outer(usable))
    return exploded.filter(F.col(exploded.columns[1]).isNotNull())  # role or scheme, which each part has
