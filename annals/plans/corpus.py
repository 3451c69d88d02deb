"""Queries over documents, pages, conversations and the trade tables that stand in for entities and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annals import rules
from annals.functions import ident, text
from annals.operators import assembly, corpus
from annals.plans.events import M, mentions, o

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "narrative_context_band",
    """with e as (select distinct conv_id, turn from conversations where contains(text, 'the'))
    select c.conv_id, c.turn, c.role, exists (select 1 from e where e.conv_id = c.conv_id and e.turn = c.turn) as is_evidence
    from conversations c where exists (select 1 from e where e.conv_id = c.conv_id and abs(e.turn - c.turn) <= 2)""",
)
def narrative_context_band(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.contains("text", F.lit("the")).alias("hit"))
    return assembly.context_band(c, c.filter("hit"), "conv_id", "turn", 2).select("conv_id", "turn", "role", "is_evidence")


@query(
    "narrative_context_whole",
    """with e as (select distinct conv_id, turn from conversations where contains(text, 'the'))
    select c.conv_id, c.turn, c.role, exists (select 1 from e where e.conv_id = c.conv_id and e.turn = c.turn) as is_evidence
    from conversations c where exists (select 1 from e where e.conv_id = c.conv_id and abs(e.turn - c.turn) <= 2)""",
)
def narrative_context_whole(spark, sf_dir):
    """The band around every turn of evidence."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.contains("text", F.lit("the")).alias("hit"))
    return assembly.context_band(c, c.filter("hit"), "conv_id", "turn", 2).select("conv_id", "turn", "role", "is_evidence")


@query(
    "evidence_list",
    """select c.conv_id, c.turn, d.source, d.lang, l.quality from conversations c left join documents d on d.doc_id = c.conv_id left join labels l on l.doc_id = d.doc_id""",
)
def evidence_list(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "source", "lang")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    known = d.join(labels, "conv_id", "left")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn").join(known, "conv_id", "left")


@query(
    "source_refs",
    "select conv_id, string_agg(role || ':' || turn, ',' order by turn, role) as refs, count(distinct role) as roles from conversations group by conv_id",
)
def source_refs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    refs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["role"], x["turn"].cast("string"))), ",")
    return c.groupBy("conv_id").agg(refs.alias("refs"), F.countDistinct("role").alias("roles"))


@query(
    "entity_search_counts",
    """select c_custkey, c_name, count(o_orderkey) as events from customer left join orders on o_custkey = c_custkey where c_name ilike '%1%'
    group by c_custkey, c_name order by events desc, c_custkey limit 200""",
)
def entity_search_counts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter(F.ilike("c_name", F.lit("%1%"))).select(F.col("c_custkey").alias("key"), "c_name")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    found = corpus.counts_with_zero(c, orders, "key", "o_orderkey", "events")
    return found.select(F.col("key").alias("c_custkey"), "c_name", "events").orderBy(F.desc("events"), "c_custkey").limit(200)


@query(
    "entity_hygiene",
    f"select person, count(*) as n from (select case event_id % 9 when 0 then 'he' when 1 then '== ' || person else person end as person from ({M})) where length(person) between 2 and 120 and not contains(person, '==') and lower(person) not in ('he', 'she', 'they', 'it', 'his', 'her') group by all",
)
def entity_hygiene(spark, sf_dir):
    n = F.col("event_id") % 9
    rows = mentions(spark, sf_dir).select(F.when(n == 0, "he").when(n == 1, F.concat(F.lit("== "), F.col("person"))).otherwise(F.col("person")).alias("person"))
    clean = F.length("person").between(2, 120) & ~F.contains("person", F.lit("==")) & ~F.lower("person").isin("he", "she", "they", "it", "his", "her")
    return rows.filter(clean).groupBy("person").agg(F.count("*").alias("n"))


PAGE = "select d.doc_id, n_chars, quality from documents d join labels l using (doc_id)"


@query("documents_keyset_first", f"{PAGE} order by n_chars desc, d.doc_id desc limit 50")
def documents_keyset_first(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return corpus.keyset_page(rows, "n_chars", "doc_id", 50)


@query("documents_keyset_next", f"select * from ({PAGE}) where n_chars < 2000 or (n_chars = 2000 and doc_id < 500) order by n_chars desc, doc_id desc limit 50")
def documents_keyset_next(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return corpus.keyset_page(rows, "n_chars", "doc_id", 50, (2000, 500))


@query(
    "locator_resolution",
    """with e as (select event_id, case event_id % 3 when 0 then 'id:' || event_id % 300 when 1 then 'source:' || event_id % 40 else 'none' end as locator from events),
    ids as (select 'id:' || doc_id as k, doc_id from documents), srcs as (select 'source:' || replace(source, 'src', '') as k, min(doc_id) as doc_id from documents group by 1)
    select event_id, locator, coalesce(ids.doc_id, srcs.doc_id) as doc_id from e left join ids on ids.k = locator left join srcs on srcs.k = locator""",
)
def locator_resolution(spark, sf_dir):
    n = F.col("event_id")
    e = read(spark, sf_dir, "events").select("event_id", F.when(n % 3 == 0, F.concat(F.lit("id:"), n % 300)).when(n % 3 == 1, F.concat(F.lit("source:"), n % 40)).otherwise("none").alias("locator"))
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    ids = d.select(F.concat(F.lit("id:"), "doc_id").alias("k"), "doc_id")
    sources = d.groupBy(F.concat(F.lit("source:"), F.replace("source", F.lit("src"), F.lit(""))).alias("k")).agg(F.min("doc_id").alias("doc_id"))
    return corpus.resolve_in_order(e, (ids, "k", "locator"), (sources, "k", "locator"), value="doc_id", name="doc_id")


@query("profile_catalog", "select p_type as slug, min(p_name) as label, count(*) as n from part group by p_type")
def profile_catalog(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("slug")).agg(F.min("p_name").alias("label"), F.count("*").alias("n"))


PERIODS = "(values (0, 'revolution', 1789, 1799), (1, 'consulate', 1799, 1804), (2, 'empire', 1804, 1815), (3, 'restoration', 1814, 1830))"


@query(
    "period_overlap",
    f"""select c_custkey, period from (select c_custkey, 1750 + c_custkey % 90 as start_year, 1750 + c_custkey % 90 + c_custkey % 40 as end_year from customer)
    join (select * from {PERIODS} as p(k, period, first_year, last_year)) on end_year >= first_year and start_year <= last_year""",
)
def period_overlap(spark, sf_dir):
    key = F.col("c_custkey")
    spans = read(spark, sf_dir, "customer").select("c_custkey", (1750 + key % 90).alias("start_year"), (1750 + key % 90 + key % 40).alias("end_year"))
    periods = spark.sql(f"select period, first_year, last_year from {PERIODS} as p(k, period, first_year, last_year)")
    return corpus.overlapping(spans, periods).select("c_custkey", "period")


@query(
    "density_report",
    """select user_id % 20 as subject, count(*) as events, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'purchase') as purchases, count(*) filter (value is not null and value > 50) as mapped,
    case when count(*) filter (event_type = 'click') <= count(*) filter (event_type = 'purchase') and count(*) filter (event_type = 'click') <= count(*) filter (value is not null and value > 50) then 'clicks'
         when count(*) filter (event_type = 'purchase') <= count(*) filter (value is not null and value > 50) then 'purchases' else 'mapped' end as bottleneck from events group by 1""",
)
def density_report(spark, sf_dir):
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    counts = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("subject")).agg(
        F.count("*").alias("events"), n(F.col("event_type") == "click").alias("clicks"), n(F.col("event_type") == "purchase").alias("purchases"), n(F.col("value") > 50).alias("mapped")
    )
    return counts.withColumn("bottleneck", corpus.bottleneck([(c, F.col(c)) for c in ("clicks", "purchases", "mapped")]))


@query("pending_without_label", "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_without_label(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("geocode_pending", f"select distinct place_surface as place from ({M}) where place_surface not in ('Paris', 'London', '')")
def geocode_pending(spark, sf_dir):
    m = mentions(spark, sf_dir).filter("place_surface <> ''").select(F.col("place_surface").alias("place")).distinct()
    return m.join(spark.sql("select * from values ('Paris'), ('London') as k(place)"), "place", "left_anti")


@query(
    "kind_conditional_upsert",
    """with o as (select c_custkey as key, case c_custkey % 4 when 0 then 'unknown' when 1 then 'person' else 'place' end as kind from customer where c_custkey % 3 <> 0),
    n as (select c_custkey as key, case c_custkey % 5 when 0 then 'work' else 'unknown' end as kind from customer where c_custkey % 2 = 0)
    select key, coalesce(case when o.kind <> 'unknown' then o.kind end, n.kind, o.kind) as kind from o full join n using (key)""",
)
def kind_conditional_upsert(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.alias("key"), F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "person").otherwise("place").alias("old"), F.when(k % 5 == 0, "work").otherwise("unknown").alias("new"))
    old, new = c.filter("key % 3 <> 0").select("key", F.col("old").alias("kind")), c.filter("key % 2 = 0").select("key", F.col("new").alias("kind"))
    return corpus.conditional_upsert(old, new, "key", "kind")


@query("content_hash_duplicates", "select sha256(text) as key, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def content_hash_duplicates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("text is not null")
    return corpus.duplicates(d, F.sha2(F.encode("text", "utf-8"), 256), "doc_id")


@query(
    "text_normal_forms",
    f"""select doc_id, sha256({o.normal("text")}) as normal, sha256(lower(translate(text, '{text.FOLD_FROM}', '{text.FOLD_TO}'))) as folded,
    length(regexp_replace(regexp_replace(lower(translate(text, '{text.FOLD_FROM}', '{text.FOLD_TO}')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug_length from documents where text is not null""",
)
def text_normal_forms(spark, sf_dir):
    t = F.col("text")
    h = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    d = read(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", h(text.normalize_surface(t)).alias("normal"), h(text.fold(t)).alias("folded"), F.length(text.slug(t)).alias("slug_length"))


CLAUSES = "list_filter(list_transform(regexp_split_to_array(text, '[;.]'), lambda c: trim(c)), lambda c: c <> '')"


@query(
    "clauses_split",
    f"select conv_id, turn, (unnest(range(len({CLAUSES}))))::int as clause_index, unnest({CLAUSES}) as clause from conversations",
)
def clauses_split(spark, sf_dir):
    return text.clauses(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "clause_index", "clause")


@query(
    "heading_chunks",
    """with c as (select conv_id, turn, regexp_split_to_array(role || ' == Turn == ' || text || ' === End === ', '={2,}[^=]+={2,}') as p from conversations),
    x as (select conv_id, turn, (unnest(range(len(p))))::int as chunk_index, trim(unnest(p)) as chunk from c) select * from x where chunk <> ''""",
)
def heading_chunks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" == Turn == "), "text", F.lit(" === End === ")).alias("text"))
    return text.heading_chunks(c).select("conv_id", "turn", "chunk_index", "chunk")


HTML = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _n, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_n}', '{_c}')"


@query("html_to_plain", f"select page_id, trim(regexp_replace({HTML}, '\\s+', ' ', 'g')) as plain from pages")
def html_to_plain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.html_to_plain(F.col("html")).alias("plain"))


SCHEMES = ["nnt", "ppn", "doi", "isbn13", "ark", "num_sujet", "isbn10"]
RAW = "case o_orderkey % 7 when 0 then ' 2010-PA-' || o_orderkey when 1 then 'PPN' || o_orderkey when 2 then 'https://doi.org/10.1/' || o_orderkey || 'X ' when 3 then '978-2-' || (1000000 + o_orderkey % 1000000) || '-12-X' when 4 then 'ARK:/1/' || o_orderkey when 5 then cast(o_orderkey as string) else '2-12-' || o_orderkey end"
CASES = "case o_orderkey % 7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SCHEMES)) + " end"


@query(
    "identifier_normalize",
    f"""with r as (select o_orderkey, {CASES} as scheme, trim({RAW}) as s from orders),
    c as (select *, upper(regexp_replace(s, '[^a-zA-Z0-9]', '', 'g')) as compact, regexp_replace(s, '[^0-9]', '', 'g') as digits, lower(s) as low from r)
    select o_orderkey, scheme, case when s = '' then null when scheme = 'nnt' then nullif(compact, '') when scheme = 'ppn' then nullif(digits, '')
        when scheme = 'doi' then trim(regexp_replace(low, '^(https://doi[.]org/|http://doi[.]org/|doi:)', ''))
        when scheme in ('isbn10', 'isbn13') then case when length(compact) in (10, 13) then compact end
        when scheme = 'num_sujet' then case when starts_with(low, 's') then low else 's' || low end else low end as normal from c""",
)
def identifier_normalize(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{CASES} as scheme", f"{RAW} as raw")
    return rows.select("o_orderkey", "scheme", ident.normalize_identifier(F.col("scheme"), F.col("raw")).alias("normal"))


@query(
    "source_budgets_whole",
    """select doc_id, source from (select *, sum(b) over (order by doc_id rows unbounded preceding) as run from
        (select doc_id, source, strlen(coalesce(text, '')) as b, row_number() over (partition by source order by doc_id) as n from documents) where n <= 40) where run <= 52428800""",
)
def source_budgets_whole(spark, sf_dir):
    """Default budgets: 40 documents a source, 50 MiB over the whole run, summed by ranges first."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"))
    first = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("n <= 40")
    return corpus.running_total(first, "doc_id", "b", "run").filter("run <= 52428800").select("doc_id", "source")


SUBJECTS = "(values (0, 'Paris', 'Paris'), (1, 'Saint Helena', 'Saint Helena'), (2, 'Saint Helena', 'Helena'), (3, 'Person 7', 'Person 7'), (4, 'Rome', 'Romé'), (5, 'short', 'of'))"
FOLDED = lambda c: f"lower(translate({c}, '{text.FOLD_FROM}', '{text.FOLD_TO}'))"
HIT = lambda c: f"(strlen(alias) >= 3 and contains({FOLDED(c)}, {FOLDED('alias')}))"


@query(
    "match_subject_documents",
    f"""with m as (select event_id as doc_id, page || ' of ' || place_surface as title, sentence as abstract, person as author, verb as keyword from ({M})),
    h as (select doc_id, subject, max(case when {HIT("title")} then 45 end) as t, max(case when {HIT("abstract")} then case when contains(alias, ' ') then 25 else 35 end end) as a,
        max(case when {HIT("author")} then 35 end) as w, max(case when {HIT("keyword")} then 15 end) as k from m, (select * from {SUBJECTS} as s(i, subject, alias)) group by all),
    s as (select *, least(100, coalesce(t, 0) + coalesce(a, 0) + coalesce(w, 0) + coalesce(k, 0)) as score from h)
    select doc_id, subject, case when w is not null then 'by' else 'about' end as relation, score,
        concat_ws(',', case when t is not null then 'title' end, case when a is not null then 'abstract' end, case when k is not null then 'keyword' end, case when w is not null then 'author' end) as evidence from s where score >= 30""",
)
def match_subject_documents(spark, sf_dir):
    docs = mentions(spark, sf_dir).select(F.col("event_id").alias("doc_id"), F.concat("page", F.lit(" of "), "place_surface").alias("title"), F.col("sentence").alias("abstract"), F.col("person").alias("author"), F.col("verb").alias("keyword"))
    return corpus.match_subjects(docs, spark.sql(f"select subject, alias from {SUBJECTS} as s(i, subject, alias)"))


@query(
    "extract_statements",
    f"""with l as (select page, string_agg('STATEMENT\t' || verb || '\tin\t' || time_surface || '\t' || place_surface, chr(10) order by event_id) as body from ({M}) group by page),
    x as (select page, unnest(string_split(body, chr(10))) as line, unnest(range(len(string_split(body, chr(10)))))::int as line_no from l), p as (select *, string_split(line, chr(9)) as f from x)
    select page, line_no, f[2] as event_type, {o.year("f[4]")} as year, f[5] as place from p where f[1] = 'STATEMENT' and len(f) >= 5 and f[2] <> ''""",
)
def extract_statements(spark, sf_dir):
    """Tab-separated statement lines of a page, one candidate each; pages are built from the mentions."""
    from annals.functions.time import parse_year

    line = F.concat_ws("\t", F.lit("STATEMENT"), "verb", F.lit("in"), "time_surface", "place_surface")
    number = F.row_number().over(Window.partitionBy("page").orderBy("event_id")) - 1  # a page's lines in order
    f = mentions(spark, sf_dir).select("page", number.alias("line_no"), F.split(line, "\t").alias("f")).filter("f[0] = 'STATEMENT' and size(f) >= 5 and f[1] <> ''")
    return f.select("page", "line_no", F.col("f")[1].alias("event_type"), parse_year(F.col("f")[3]).alias("year"), F.col("f")[4].alias("place"))


BLANK = "[\\s\\pZ\\x0B\\x85]"
STRIPPED = lambda c: f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"
ENDS_SHORT = " or ".join(f"ends_with(early || mark, {o.q(a)})" for a in rules.ABBREVIATIONS)
SENTENCES = f"""
    with t as (select doc_id, {STRIPPED("coalesce(text, '')")} as s from documents),
    a as (select doc_id, unnest(regexp_extract_all(s, '[.!?][ \t\n\r\f]*|[^.!?]+')) as w, generate_subscripts(regexp_extract_all(s, '[.!?][ \t\n\r\f]*|[^.!?]+'), 1) as i from t),
    b as (select *, sum(length(w)) over (partition by doc_id order by i) as stop, w[1] as mark, lead(w) over (partition by doc_id order by i) as later,
                 right(coalesce(string_agg(w, '') over (partition by doc_id order by i rows between 9 preceding and 1 preceding), ''), 12) as early from a),
    c as (select doc_id, stop::bigint as cut from b where mark in ('.', '!', '?') and regexp_matches(later, '^([A-Z0-9]|["''(][A-Z0-9])')
          and not ({ENDS_SHORT} or regexp_matches(early, '[ \n][A-Z]$') or regexp_matches(early, '(^|[^0-9])[0-9]{{1,3}}$'))),
    h as (select doc_id, unnest(regexp_extract_all(s, '={{2,}}[^=]+={{2,}}|[^=]+|=')) as w, generate_subscripts(regexp_extract_all(s, '={{2,}}[^=]+={{2,}}|[^=]+|='), 1) as i from t where contains(s, '==')),
    k as (select *, sum(length(w)) over (partition by doc_id order by i)::bigint as stop from h),
    cuts as (select doc_id, cut from c union select doc_id, stop from k where starts_with(w, '==') union select doc_id, stop - length(w) from k where starts_with(w, '==') union select doc_id, length(s) from t),
    p as (select doc_id, cut, lag(cut, 1, 0) over (partition by doc_id order by cut) as start from cuts where cut > 0),
    q as (select doc_id, start, s[start + 1:cut] as piece from p join t using (doc_id)),
    r as (select *, sum(strlen(piece)) over (partition by doc_id order by start)::int as char_end, {STRIPPED("piece")} as sentence from q)
    select doc_id, (row_number() over (partition by doc_id order by start) - 1)::int as ordinal, sentence, (char_end - strlen(ltrim(piece)))::int as char_start, char_end
    from r where strlen(sentence) >= 12 and regexp_matches(sentence, '\\pL') and not starts_with(sentence, '==')"""


@query("sentences_split", SENTENCES)
def sentences_split(spark, sf_dir):
    return text.sentences(read(spark, sf_dir, "documents"), "doc_id")


@query("year_histogram", f"select year, count(*) as n from (select {o.year('time_surface')} as year from ({M})) where year is null or year between 1760 and 1860 group by year")
def year_histogram(spark, sf_dir):
    from annals.functions.time import parse_year

    rows = mentions(spark, sf_dir).select(parse_year(F.col("time_surface")).alias("year"))
    return rows.filter(F.col("year").isNull() | F.col("year").between(1760, 1860)).groupBy("year").agg(F.count("*").alias("n"))
