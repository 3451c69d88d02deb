"""Dossiers of events, over events, neighbours and sections derived from the events table in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals import rules
from annals.operators import dossier
from annals.plans import oracle as o
from annals.plans.synth import values

QUERIES, SQL = {}, {}

KINDS = ["birth", "death", "battle", "education", "travel"]
SECTIONS = ["Naissance et jeunesse", "Early life", "Reign", "Mort", "Death", "Bibliography", "Military career"]
SAID = [
    "Death came in Paris[12] in the year 1790, as all his friends had long expected.", "He was a general.", "Early life Born in Rome to a family of &quot;sailors&quot; [citation needed] and went to school at Brienne.",
    "Short.", "The battle was fought at Waterloo in 1801 [a], and the army [of the north] retreated, ", "Il naît à Ajaccio en 1770, et sa mère l'élève dans la maison de famille [réf. nécessaire].",
    "Reign. Reign Nothing about the matter is told here except that bread was dear.", "He died at London in 1795. " + "The mourners came from all the counties and walked behind the coffin for many hours, and the bells rang. " * 2,
    "Naissance : il est mort en exil à Sainte-Hélène, loin de tous les siens, après une longue maladie.", "Mort en 1780 à Rome, il repose dans la chapelle que son père avait fait bâtir.",
]
EVENTS = f"""
    select e.event_id, k.kind as event_type, case when e.event_id % 6 > 0 then 1765 + e.event_id % 40 end as year, case e.event_id % 5 when 0 then 'Paris' when 1 then 'Rome' when 2 then ' London ' when 3 then '' end as place_label,
           'Person ' || cast(e.user_id as string) as person, 'Event ' || cast(e.event_id as string) as title, case when e.event_id % 4 = 0 then 'Summary' end as summary,
           case e.event_id % 9 when 0 then ' He was born here [3] and  stayed. ' when 1 then '  ' when 2 then 'In 1771, he died.' end as fact, 'Page ' || cast(e.user_id as string) as page,
           case when e.user_id % 3 = 0 then 'en' else 'fr' end as language, case when e.user_id % 4 = 0 then e.user_id * 10 end as revision from {{events}} e
    join {values(KINDS, "k", "k", "kind")} on k.k = (e.event_id * 3 + e.user_id) % {len(KINDS)}"""
NARRATIVE = f"""
    select cast(floor(e.event_id / 3) as bigint) as event_id, cast(e.event_id % 3 as int) as ordinal, s.said as text, e.event_id % 7 = 0 as is_evidence from {{events}} e
    join {values(SAID, "s", "k", "said")} on s.k = (e.event_id * 7 + e.user_id) % {len(SAID)} where e.event_id % 4 > 0"""
SENTENCES = f"""
    select 'Page ' || cast(e.user_id as string) as page, cast(e.event_id % 4 as int) as section_no, t.title as section, e.event_id as ordinal, s.said as text from {{events}} e
    join {values(SAID, "s", "k", "said")} on s.k = (e.event_id * 3 + e.user_id) % {len(SAID)}
    join {values(SECTIONS, "t", "k", "title")} on t.k = (e.user_id + 2 * (e.event_id % 4)) % {len(SECTIONS)}"""


def tables(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return [spark.sql(q, events=events) for q in (EVENTS, NARRATIVE, SENTENCES)]


def event_dossiers(spark, sf_dir):
    rows = dossier.dossiers(*tables(spark, sf_dir))
    lines = F.transform("source_refs", lambda r: F.concat_ws("|", r["label"], r["section_title"], r["snippet"], r["url"]))
    return rows.select("event_id", "event_summary", "how_it_happened", F.array_join(lines, "\n").alias("sources"))


def event_claims(spark, sf_dir):
    return dossier.claims(*tables(spark, sf_dir))


def clean(x: str) -> str:
    for name, c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {c})"
    return rf"trim(regexp_replace(regexp_replace({x}, '{dossier.DROPPED}', '', 'g'), '\s+', ' ', 'g'))"


def blurb(x: str) -> str:
    return f"({o.any_of(f'lower({x})', ['was a ', 'is a ', 'was an '])} and strlen(lower({x})) < 140 and not {o.any_of(f'lower({x})', ['born', 'died'])})"


def key(x: str) -> str:
    return rf"lower(array_to_string(list_filter(string_split_regex(regexp_replace({x}, '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+'), lambda w: w <> '')[:12], ' '))"


def by_type(table: list, low: str) -> str:
    return "case " + " ".join(f"when event_type = '{k}' then {o.any_of(low, p)}" for k, p in table if k) + f" else {o.any_of(low, table[-1][1])} end"


def unheaded(x: str, title: str, marks: str) -> str:
    """Nested select steps are spared by macros over one value."""
    for end in ("", " ", "."):
        x = f"list_transform([{x}], lambda v: case when starts_with(v, {title} || '{end}') then regexp_replace(v[length({title} || '{end}') + 1:], '^[{marks}]+', '') else v end)[1]"
    return x


def compact(x: str, title: str) -> str:
    x = unheaded(f"trim({x})", title, " ")
    for h in rules.LEFTOVER_HEADINGS:
        x = f"list_transform([{x}], lambda v: case when starts_with(v, '{h}') then regexp_replace(v[{len(h) + 1}:], '^[ :—-]+', '') else v end)[1]"
    x = f"list_transform([{x}], lambda v: case when length(v) > 200 and contains(v, '. ') and length(string_split(v, '. ')[1]) >= 48 then string_split(v, '. ')[1] || '.' else v end)[1]"
    return f"regexp_replace(trim({x}), ',+$', '')"


RELEVANT = f"(coalesce(trim(place_label) <> '' and contains(lower(t), lower(place_label)), false) or coalesce(contains(lower(t), year::varchar), false) or {by_type(rules.EVENT_WORDS, 'lower(t)')})"
CLAIMS = f"""ev as ({EVENTS.format(events="events")}), na as ({NARRATIVE.format(events="events")}), se as ({SENTENCES.format(events="events")}),
    local as (select event_id, 0 as kind, 0 as a, 0 as b, {clean("trim(fact)")} as text, 'evidence' as section from ev where trim(fact) <> ''
        union all select event_id, 1, ordinal, 0, {clean("text")}, 'adjacent · sentence ' || ordinal from na where not is_evidence and not {blurb("text")} and length({clean("text")}) >= 24),
    ti as (select distinct page, section_no, section from se), pa as (select ti.*, ev.event_id, event_type, place_label, year, {by_type(rules.EVENT_SECTIONS, "lower(section)")} as fits from ti join ev using (page)),
    pb as (select *, section_no is distinct from min(case when fits then section_no end) over (partition by event_id) as other from pa),
    pc as (select *, row_number() over (partition by event_id order by other, section_no) as rk from pb qualify rk <= 2),
    sa as (select pc.*, se.ordinal, {unheaded(clean("se.text"), "pc.section", " :—-")} as t from pc join se using (page, section_no)),
    sb as (select * from sa where length(t) between 40 and 320 and {RELEVANT} and not {blurb("t")} qualify row_number() over (partition by event_id order by rk, ordinal, t) <= 5),
    un as (select *, {key("text")} as k from (select * from local union all select event_id, 2, rk, ordinal, t, section from sb)),
    dd as (select * from un qualify kind < 2 or row_number() over (partition by event_id, k order by kind, a, b, text) = 1),
    cl as (select event_id, (row_number() over (partition by event_id order by kind, a, b, text) - 1)::int as place_in, text, section, k from dd qualify place_in < 6)"""


def framed(lang: str) -> str:
    whens = []
    for of, kind, said in rules.FRAMES:
        if of == lang:
            text = o.q(said).replace("{person}", "' || person || '").replace("{place}", "' || trim(place_label) || '").replace("{year}", "' || year || '")
            whens.append(f"when event_type = '{kind}' then {text}" if kind else f"else {text}")
    return "case " + " ".join(whens) + " end"


URL = "'https://' || language || '.wikipedia.org/w' || case when revision is not null then '/index.php?title=' || replace(page, ' ', '_') || '&oldid=' || revision else 'iki/' || replace(page, ' ', '_') end"
SQL["event_claims"] = f"with {CLAIMS} select event_id, place_in, text, section from cl"
SQL["event_dossiers"] = f"""with {CLAIMS},
    fl as (select cl.*, language = 'fr' and {o.any_of("lower(section)", rules.BIOGRAPHIC_SECTIONS)} as bio from cl join ev using (event_id)),
    fm as (select *, bio or count(*) filter (where bio) over (partition by event_id) < 3 as woven from fl),
    fn as (select *, row_number() over (partition by event_id, woven order by place_in) as n, {compact("text", "section")} as said from fm),
    le as (select *, case when year is not null and trim(place_label) <> '' then case when language = 'fr' then {framed("fr")} else {framed("en")} end end as lead from ev),
    lf as (select *, list_filter(list_transform(string_split_regex(lead, '\\s+'), lambda w: regexp_replace(w, '[^0-9]', '', 'g')), lambda d: length(d) = 4)[1] as num from le),
    fi as (select event_id, lower(said) as first from fn where woven and n = 1),
    lg as (select lf.*, case when coalesce(first <> '' and contains(first, num) and {o.any_of("first", rules.FRAMED_WORDS)}, false) then null else lead end as used from lf left join fi using (event_id)),
    ag as (select event_id, list(said || '[' || n || ']' order by n) filter (where said <> '') as ps, any_value(text order by n) filter (where n = 1) as top from fn where woven group by event_id),
    rf as (select f.event_id, section, text, row_number() over (partition by f.event_id order by not woven, place_in) as n from fn f
        where woven or not exists (select 1 from fn g where g.event_id = f.event_id and g.woven and g.k = f.k)),
    rg as (select event_id, string_agg('[' || n || '] Wikipedia — ' || page || '|' || section || '|' || text || '|' || {URL}, chr(10) order by n) as sources from rf join ev using (event_id) group by event_id)
    select event_id, case when top is null then coalesce(fact, summary, title) else coalesce(nullif(trim(fact), ''), top) end as event_summary,
        case when top is null then coalesce(fact, summary, title) else list_reduce(list_prepend('', list_concat(case when used is null then [] else [used] end, coalesce(ps, []))[:5]),
            lambda a, p: case when length(a) > 850 then a when a = '' then p else a || ' ' || p end) end as how_it_happened, coalesce(sources, '') as sources
    from lg left join ag using (event_id) left join rg using (event_id)"""
QUERIES |= {"event_claims": event_claims, "event_dossiers": event_dossiers}
