"""Queries over bibliographic records that are written from the given tables and read back by the record readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.sources import records

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


SENT = """select o_orderkey, case when o_orderkey % 19 = 0 then '{"nnt": broken' else '{"nnt":"' || case when o_orderkey % 3 = 0 then '' else cast(o_orderkey as string) || 'ab' end || '","numSujet":"' || case when o_orderkey % 6 = 0 then '' else 's' || cast(o_orderkey as string) end
    || '","titrePrincipal":" Study ' || cast(o_orderkey as string) || ' ","status":"' || case o_orderkey % 4 when 0 then 'soutenue' when 1 then 'enCours' when 2 then 'x' else 'Soutenue' end || '","accessible":"' || case when o_orderkey % 5 = 0 then 'OUI' else 'non' end
    || '","resumes":{"' || case when o_orderkey % 2 = 0 then 'fr' else 'en' end || '":"About ' || o_orderpriority || '"},"langues":["fr","en"],"dateSoutenance":"' || cast(o_orderdate as string) || '","auteurs":[{"nom":"CLERK","prenom":"' || 'Clerk ' || cast(o_custkey as string) || '","ppn":"ppn 0' || cast(o_custkey as string)
    || '"},{"nom":" "}],"directeurs":[{"nom":"Dir"}],"etabSoutenance":{"nom":"' || o_orderstatus || ' University"},"mapSujets":{"sujetsRameau":[{"keyword":"' || o_orderstatus || '","ppn":"7"}],"mots":[{"libelle":"m"},{"libelle":""}]},"sujets":[{"libelle":"' || o_orderpriority || '"}]}' end as payload from {orders}"""
KNOWN = "o_orderkey % 19 <> 0 and not (o_orderkey % 6 = 0)"
DEFENDED = "o_orderkey % 4 in (0, 3)"


def over(spark, sf_dir, sql: str, table: str, dealt_by: str | None = None):
    """SQL with braces of its own over a given table, named in braces; with a key, its rows are dealt out by number first (few bytes and much work)."""
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"{{{{{table}}}}}", f"{{{table}}}")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if dealt_by is not None:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt_by)
    return spark.sql(text, **{table: rows})


def thesis_rows(spark, sf_dir):
    return records.theses(over(spark, sf_dir, SENT, "orders", dealt_by="o_orderkey"))


@query(
    "thesis_records",
    f"""select o_orderkey, case when o_orderkey % 19 = 0 then 'broken' when o_orderkey % 6 = 0 then 'no identifier' end as problem, case when {KNOWN} then case when o_orderkey % 3 = 0 then 's' || o_orderkey else o_orderkey || 'ab' end end as external_id,
        case when o_orderkey % 19 <> 0 then case when {DEFENDED} then 'thesis' else 'bibliographic_notice' end end as document_type,
        case when o_orderkey % 19 <> 0 then case when {DEFENDED} then 'doctoral_defended' when o_orderkey % 4 = 1 then 'academic_unreviewed' else 'catalog_record' end end as academic_status,
        case when o_orderkey % 19 <> 0 then case when o_orderkey % 5 = 0 then 'open' else 'metadata_only' end end as access_level, case when o_orderkey % 19 <> 0 then year(o_orderdate)::int end as year,
        case when o_orderkey % 19 <> 0 then 'TITLE: Study ' || o_orderkey || chr(10) || 'ABSTRACT: About ' || o_orderpriority || chr(10) || 'SUBJECTS: keyword:m | rameau:' || o_orderstatus || ' | keyword:' || o_orderpriority end as snapshot_text
    from orders""",
)
def thesis_records(spark, sf_dir):
    """Theses, defended or under way, with what can't be used named."""
    rows = thesis_rows(spark, sf_dir)
    told = F.col("problem").eqNullSafe("broken")
    keep = [F.when(~told, F.col(c)).alias(c) for c in ("document_type", "academic_status", "access_level", "year", "snapshot_text")]
    return rows.select("o_orderkey", "problem", "external_id", *keep)


@query(
    "thesis_contributions",
    f"""with r as (select *, case when o_orderkey % 3 = 0 then 's' || o_orderkey else o_orderkey || 'ab' end as external_id from orders where {KNOWN})
    select external_id, 'author' as role, 'Clerk ' || o_custkey || ' CLERK' as name, 'clerk ' || o_custkey || ' clerk' as name_normalized, 'ppn' as identifier_scheme, '0' || o_custkey as identifier, 0 as ordinal from r
    union all select external_id, 'thesis_advisor', 'Dir', 'dir', null, null, 0 from r union all select external_id, 'institution', o_orderstatus || ' University', lower(o_orderstatus) || ' university', null, null, 0 from r""",
)
def thesis_contributions(spark, sf_dir):
    """People and bodies of the theses, one row each."""
    return records.parts(thesis_rows(spark, sf_dir), "contributions")


HELD = """select p_partkey, '{"halId_s":"' || case when p_partkey % 11 = 0 then '' else 'hal-' || cast(p_partkey as string) end || '","title_s":' || case when p_partkey % 2 = 0 then '["' || p_name || '"]' else '"' || p_name || '"' end
    || ',"docType_s":"' || case p_partkey % 4 when 0 then 'THESE' when 1 then 'art' when 2 then 'COUV' else 'OTHER' end || '","producedDate_tdate":"' || cast(1900 + p_size as string) || '-01-01T00:00:00Z","openAccess_bool":' || case when p_partkey % 3 = 0 then 'true' else 'false' end
    || ',"doi_s":["https://doi.org/10.1/' || p_brand || '"],"authFullName_s":["Maker ' || p_brand || '"," ","B ' || p_brand || '"],"keyword_s":["' || p_type || '"]}' as payload from {part}"""


@query(
    "deposit_records",
    """select p_partkey, case when p_partkey % 11 <> 0 then 'hal-' || p_partkey end as external_id, case when p_partkey % 11 = 0 then 'no identifier' end as problem, p_name as title,
        case p_partkey % 4 when 0 then 'thesis' when 2 then 'bibliographic_notice' else 'academic_article' end as document_type, case when p_partkey % 3 = 0 then 'open' else 'metadata_only' end as access_level,
        (1900 + p_size)::int as year, '10.1/' || lower(p_brand) as doi, 'maker ' || lower(p_brand) || ';b ' || lower(p_brand) as authors, 'TITLE: ' || p_name || chr(10) || 'KEYWORDS: ' || p_type as snapshot_text from part""",
)
def deposit_records(spark, sf_dir):
    """Documents of an open archive."""
    rows = records.deposits(over(spark, sf_dir, HELD, "part"))
    doi = F.filter("identifiers", lambda i: i["scheme"] == "doi")[0]["value"]
    authors = F.array_join(F.transform("contributions", lambda c: c["name_normalized"]), ";")
    return rows.select("p_partkey", "external_id", "problem", "title", "document_type", "access_level", "year", doi.alias("doi"), authors.alias("authors"), "snapshot_text")


ITEM = """<{box}><oai_dc:dc xmlns:dc="d" xmlns:oai_dc="o"><dc:title>Part &amp; ' || p_name || '</dc:title>' || case when p_partkey % 3 = 0 then '' else '<dc:creator>Maker ' || p_brand || '</dc:creator><dc:creator>Other</dc:creator>' end
    || '<dc:subject>' || p_type || '</dc:subject><dc:date>' || cast(1900 + p_size as string) || '-05</dc:date><dc:identifier>' || {link} || '</dc:identifier></oai_dc:dc></{box}>"""
# an answer has the parts of ten thousand keys: pages don't grow with the table
SEARCHED = """select p_brand, max(case when p_brand like '%3' then 1 else 0 end) as spoiled, array_join(array_sort(collect_list(concat('<srw:record>""" + ITEM.format(
    box="srw:recordData", link="case when p_partkey % 7 = 0 then '' else 'https://catalogue.bnf.fr/ark:/12148/cb' || cast(p_partkey as string) || '/' end"
) + """</srw:record>'))), '') as items from {part} group by p_brand, floor(p_partkey / 10000)"""


@query(
    "library_notices",
    """with b as (select p_brand, max((p_brand like '%3')::int) as spoiled from part group by p_brand)
    select p_brand, null as external_id, null as title, null::int as year, null as author, 'broken' as problem from b where spoiled = 1
    union all select p_brand, case when p_partkey % 7 <> 0 then 'ark:/12148/cb' || p_partkey end, 'Part & ' || p_name, (1900 + p_size)::int, case when p_partkey % 3 <> 0 then 'maker ' || lower(p_brand) end, case when p_partkey % 7 = 0 then 'no identifier' end
    from part join b using (p_brand) where spoiled = 0""",
)
def library_notices(spark, sf_dir):
    """Records of search answers, a search for each brand, in pages of bounded size; searches that can't be read are one row each."""
    pages = over(spark, sf_dir, SEARCHED, "part")
    payload = F.concat(F.lit('<srw:searchRetrieveResponse xmlns:srw="s"><srw:records>'), "items", F.when(F.col("spoiled") == 1, "</srw:rec").otherwise("</srw:records></srw:searchRetrieveResponse>"))
    rows = records.dublin_core(pages.select("p_brand", payload.alias("payload")))
    rows = rows.select("p_brand", "external_id", "title", "year", F.try_element_at("contributions", F.lit(1))["name_normalized"].alias("author"), "problem")
    broken = F.col("problem").eqNullSafe("broken")
    return rows.filter(~broken).unionByName(rows.filter(broken).distinct())


HARVESTED = """select p_brand, array_join(array_sort(collect_list(concat('<record><header><identifier>oai:' || cast(p_partkey as string) || '</identifier></header>""" + ITEM.format(
    box="metadata", link="'http://x/' || cast(p_partkey as string)"
) + """</record>'))), '') as items from {part} group by p_brand, floor(p_partkey / 10000)"""


@query(
    "harvested_articles",
    """select 'oai:' || p_partkey as external_id, 'http://x/' || p_partkey as canonical_url, 'Part & ' || p_name as title, (1900 + p_size)::int as year, case when p_partkey % 3 <> 0 then 2 else 0 end as n_authors, p_type as subject,
        case when p_brand < 'Brand#4' then 'after ' || p_brand end as token from part""",
)
def harvested_articles(spark, sf_dir):
    """Records of a harvest with the token of the next page."""
    pages = over(spark, sf_dir, HARVESTED, "part")
    token = F.when(F.col("p_brand") < "Brand#4", F.concat(F.lit("<resumptionToken>after "), "p_brand", F.lit("</resumptionToken>"))).otherwise("<resumptionToken/>")
    payload = F.concat(F.lit("<OAI-PMH><ListRecords>"), "items", token, F.lit("</ListRecords></OAI-PMH>"))
    rows = records.dublin_core(pages.select(payload.alias("payload")), harvest=True)
    return rows.select("external_id", "canonical_url", "title", "year", F.size("contributions").alias("n_authors"), F.try_element_at("subjects", F.lit(1))["label"].alias("subject"), "token")
