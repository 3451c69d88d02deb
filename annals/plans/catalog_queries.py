"""Queries over catalogue answers, derived from orders, customers and parts in SQL that both engines run."""

from __future__ import annotations

from annals.sources import catalogs

QUERIES, SQL = {}, {}

PERSON = "case when c_custkey % 7 = 0 then 'Élise ' else 'Person ' end || cast(c_custkey as string)"
SUBJECT = f"{PERSON} as subject, cast(case when c_custkey % 4 > 0 then 1930 + c_custkey % 60 end as int) as birth_year, cast(case when c_custkey % 3 > 0 then 1990 + c_custkey % 9 end as int) as death_year"
WHERE = "case o_orderkey % 6 when 0 then 'Paris : Plon' when 1 then 'near Rome, 1900' when 2 then 'nowhere' when 3 then 'New York' when 4 then 'Amiens' else '' end"
AUTHOR = f"case o_orderkey % 3 when 0 then 'by ' || upper({PERSON}) when 1 then 'Another' else replace({PERSON}, 'É', 'e') end"
YEAR = "cast(year(o_orderdate) as string)"
EDITIONS = f"""
    select o_orderkey, {SUBJECT}, case when o_orderkey % 37 = 0 then '{{{{broken' else '{{{{"title": ' || case when o_orderkey % 5 = 0 then '["", "Title ' || cast(o_orderkey as string) || '"]' when o_orderkey % 5 = 1 then '""' else '"Title"' end
        || case when o_orderkey % 29 > 0 then ', "key": "/works/OL' || cast(o_orderkey as string) || 'W"' else '' end || case when o_orderkey % 2 = 0 then ', "first_publish_year": ' || {YEAR} else ', "publish_year": ["' || {YEAR} || '-01"]' end
        || ', "author_name": ["", "' || {AUTHOR} || '"], "publish_place": ["' || {WHERE} || '"]' || case when o_orderkey % 4 = 0 then ', "subtitle": " Sub "' else '' end || ', "language": {{{{"en": "eng"}}}}}}}}' end as payload
    from {{orders}} join {{customer}} on c_custkey = o_custkey"""
RECORDS = f"""
    select o_orderkey, {SUBJECT}, '<srw:record><dc:title>' || case when o_orderkey % 5 = 0 then ' ' else 'A &amp; B ' || cast(o_orderkey as string) end || '</dc:title><dc:creator>' || {AUTHOR} || '</dc:creator>'
        || case when o_orderkey % 29 > 0 then '<dc:identifier>x' || cast(o_orderkey as string) || '</dc:identifier>' else '' end || case when o_orderkey % 3 = 0 then '<dc:identifier>ark:/1/' || cast(o_orderkey as string) || '</dc:identifier>' else '' end
        || '<dc:date>no</dc:date><dc:date>[' || {YEAR} || ']</dc:date>' || case when o_orderkey % 2 = 0 then '<dc:coverage xml:lang="fr">' || {WHERE} || '</dc:coverage>' else '' end
        || '<dc:publisher>Plon (Rome)</dc:publisher><dc:language>fre</dc:language></srw:record>' as payload
    from {{orders}} join {{customer}} on c_custkey = o_custkey"""
ITEMS = """
    select case when p_partkey % 4 = 0 then '{{"object": ' else '' end || '{{"id": "/' || cast(p_partkey as string) || '"' || case when p_partkey % 3 > 0 then ', "title": ["' || p_brand || '"]' else ', "dcTitle": {{"def": "' || p_brand || '"}}' end
        || case when p_partkey % 5 = 0 then ', "guid": "http://g/' || cast(p_partkey as string) || '"' else '' end || ', "year": ["c. 18' || lpad(cast(p_partkey % 100 as string), 2, '0') || '"], "provider": "' || p_type || '"}}' || case when p_partkey % 4 = 0 then '}}' else '' end as payload from {part}"""


def tables(spark, sf_dir, sql: str, *names: str):
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


QUERIES |= {
    "catalog_editions": lambda spark, sf_dir: catalogs.editions(tables(spark, sf_dir, EDITIONS, "orders", "customer")),
    "catalog_digitized": lambda spark, sf_dir: catalogs.digitized(tables(spark, sf_dir, RECORDS, "orders", "customer")),
    "catalog_heritage": lambda spark, sf_dir: catalogs.heritage_items(tables(spark, sf_dir, ITEMS, "part")).select("external_id", "url", "title", "year", "publisher"),
}

PLACE = "case o_orderkey % 6 when 0 then 'Paris' when 1 then 'Rome' when 3 then 'New York' when 4 then 'Amiens' end"
FOLD = "lower(strip_accents({}))"
AUTHORED = f"(o_orderkey % 3 <> 1 or contains({FOLD.format(PERSON)}, 'another'))"
TOLD = """case when authored and year is not null then subject || ' published "' || title || '" in ' || year || coalesce(' in ' || place, '') || '.' else title end"""
ALIVE = "case when birth_year is null and death_year is null then year between 1000 and 2100 else coalesce(year >= birth_year - 5, true) and coalesce(year <= death_year + 2, true) end"
EVERY = f"select o_orderkey, {SUBJECT}, year(o_orderdate)::int as year, {AUTHORED} as authored from orders join customer on c_custkey = o_custkey"
SQL |= {
    "catalog_editions": f"""with a as ({EVERY}), b as (select *, '/works/OL' || o_orderkey || 'W' as external_id, case o_orderkey % 5 when 0 then 'Title ' || o_orderkey when 1 then 'Untitled' else 'Title' end as title, {PLACE} as place from a
        where o_orderkey % 37 > 0 and o_orderkey % 29 > 0 and not (authored and not ({ALIVE})))
        select subject, external_id, 'https://openlibrary.org' || external_id as url, title, 'eng' as language, year, place, authored, case when authored then 82 else 55 end as relevance, {TOLD} || case when o_orderkey % 4 = 0 then chr(10) || 'Sub' else '' end as notice from b""",
    "catalog_digitized": f"""with a as ({EVERY}), b as (select *, case when o_orderkey % 3 = 0 then 'ark:/1/' || o_orderkey else 'x' || o_orderkey end as external_id, case when o_orderkey % 5 = 0 then 'Sans titre' else 'A & B ' || o_orderkey end as title,
        case when o_orderkey % 2 = 0 and {WHERE.replace('string', 'varchar')} <> '' then {PLACE} else 'Rome' end as place from a where (o_orderkey % 29 > 0 or o_orderkey % 3 = 0) and not (authored and not ({ALIVE})))
        select subject, external_id, external_id as url, title, 'fre' as language, year, place, authored, case when authored then 80 else 54 end as relevance, {TOLD} as notice from b""",
    "catalog_heritage": """select '/' || p_partkey as external_id, case when p_partkey % 5 = 0 then 'http://g/' || p_partkey else 'https://www.europeana.eu/item/' || p_partkey end as url, p_brand as title, (1800 + p_partkey % 100)::int as year, p_type as publisher from part""",
}
