"""Queries over lines derived from events: one for each extractor, and discovery by frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.operators import extract
from annals.plans import oracle as o
from annals.plans.synth import values

QUERIES, SQL = {}, {}

PHRASES = [
    "He departed for {p} in {y}.", "She arrived in {p} on 3 May {y}", "They lived in {p}, {y}", "He passed through {p} in March {y}", "It was published in {p}, {y}", "A statue in {p} was unveiled in {y}",
    "The siege of {p}, {y}", "He fought at {p} in {y}", "{y} — {p} — the siege and retreat", "* {y} BC — {p} — treaty signed", "Nothing happened here", "Il vécut à {p} en {y}", "The army surrendered near {p} in {y}",
    "The campaign began near {p} in {y}", "The campaign went on in {p}, {y}", "He returned to {p}.", "Her remains were returned to {p} in {y}", "— {p} —",
]
TOWNS = ["Paris", "Saint Helena", "the hills", "Elba", "London", "X", "old town"]
LINES = f"""
    select e.event_id as line_no, 'Page ' || cast(e.user_id as string) as page, cast(1800 + e.user_id % 60 as int) as death_year,
           replace(replace(v.phrase, '{{{{p}}}}', p.place), '{{{{y}}}}', cast(1750 + e.event_id % 150 as string)) as line
    from {{events}} e
    join {values(PHRASES, "v", "k", "phrase").replace("{", "{{").replace("}", "}}")} on v.k = e.event_id % {len(PHRASES)}
    join {values(TOWNS, "p", "k", "place")} on p.k = (e.event_id * 3 + e.user_id) % {len(TOWNS)}"""
L = LINES.format(events="events")


def line_rows(spark, sf_dir):
    return spark.sql(LINES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


YEAR = "list_filter(list_transform(list_filter(regexp_split_to_array(line, '[^0-9]'), lambda r: length(r) = 4), lambda r: r::int), lambda y: y between 1000 and 2100)[1]"


def after(cue: str, last: bool, stop: str) -> str:
    s = f"trim(regexp_extract(line, {o.q(f'(?is)^.*{chr(63) if not last else str()}{cue}([^{stop}]*)')}, 1))"
    return f"case when strlen({s}) >= 2 then {s} end"


def travel_place() -> str:
    out = []
    for cue in extract.PLACE_CUES:
        s = f"regexp_replace({after(cue, True, '.0-9,')}, '^[^\\p{{L}} -]+|[^\\p{{L}} -]+$', '', 'g')"
        s = f"trim(regexp_replace(regexp_replace({s}, '( en)+$', ''), '( in)+$', ''))"
        out.append(f"case when strlen({s}) >= 2 and lower({s}) <> 'en' then {s} end")
    return f"coalesce({', '.join(out)})"


def motion_place() -> str:
    out = []
    for cues, trimmed in ((extract.MOTION_CUES, True), (extract.MOTION_WORDS, False)):
        for cue in cues:
            s = f"trim(regexp_replace({after(cue, False, '.,;0-9')}, '(?s) in .*$', ''))"
            if trimmed:
                s = f"regexp_replace({s}, '^[^\\p{{L}} ''-]+|[^\\p{{L}} ''-]+$', '', 'g')"
            out.append(f"case when strlen({s}) >= 2 then {s} end")
    return f"coalesce({', '.join(out)})"


def military_place() -> str:
    phrase = [after(c, False, ".,;0-9") for c in ("battle of ", "siege of ")]
    near = [f"case when regexp_matches({after(c, False, '.,0-9')}, '^\\p{{Lu}}') then {after(c, False, '.,0-9')} end" for c in (" near ", " at ", " in ")]
    return f"coalesce({', '.join(phrase + near)})"


PLAUSIBLE = """not (strlen(place) not between 2 and 60 or length(place) - length(replace(place, ' ', '')) > 5 or contains(lower(place), ' the ')
    or regexp_matches(lower(place), '^(the |a |an |his |her |their |have |fight|chapter)') or contains(lower(place), 'coalition') or contains(lower(place), 'claim')
    or not regexp_matches(place, '^\\p{L}') or (contains(place, ' ') and not regexp_matches(place, '\\p{Lu}')) or regexp_matches(lower(place), '( on| in| at| of| the|\\(|-)$'))"""


def ruled(rules: list[tuple], place: str, where: str = "true", more: tuple = ("null", "null")) -> str:
    kind = lambda v: f"coalesce({o.first(rules, lambda p: o.any_of('low', p), v)}, {more[v - 1]})"
    return f"""with l as (select *, lower(line) as low from ({L})), x as (select page, line_no, death_year, {kind(1)} as event_type, {kind(2)} as predicate, {YEAR} as year, {place} as place from l)
    select page, line_no, event_type, predicate, year, place from x where event_type is not null and {where}"""


SQL_BY_NAME = {
    "travel": ruled(extract.TRAVEL, travel_place()),
    "itinerary": ruled(extract.ITINERARY, motion_place(), f"year is not null and place is not null and {PLAUSIBLE}"),
    "publication": ruled([(extract.PUBLICATION, "publication", "published")], travel_place(), "year is not null"),
    "posthumous": ruled([(extract.COMMEMORATION, "commemoration", "commemorated_at")], f"coalesce({', '.join(after(c, True, '.0-9,') for c in (' in ', ' at ', ' to '))})", "year > death_year"),
    "military": ruled(
        extract.MILITARY, military_place(), f"year <= death_year + 2 and place is not null and {PLAUSIBLE}",
        tuple(f"case when contains(low, 'campaign') and {o.any_of('low', extract.CAMPAIGN_BEGINS)} then '{x}' end" for x in ("military_campaign", "campaign_at")),
    ),
    "timeline": f"""with l as (select *, list_transform(string_split(regexp_replace(trim(line), '^[*•\\s-]+', ''), '—'), lambda p: trim(p)) as p from ({L})),
        x as (select *, lower(coalesce(p[3], '')) as low, case when regexp_matches(lower(p[1]), 'bc|b[.]c|av') then -try_cast(regexp_replace(p[1], '[^0-9]', '', 'g') as int)
            when regexp_matches(p[1], '^-?[0-9]+$') then try_cast(p[1] as int) end as year from l where len(p) >= 2)
        select page, line_no, case when year > death_year then 'commemoration' else coalesce({o.first(extract.TIMELINE, lambda p: o.any_of("low", p), 1)}, 'life_event') end as event_type,
            coalesce({o.first(extract.TIMELINE, lambda p: o.any_of("low", p), 2)}, 'occurred_at') as predicate, year, p[2] as place from x where year is not null""",
}


def _query(name):
    def run(spark, sf_dir):
        return extract.EXTRACTORS[name](line_rows(spark, sf_dir)).select("page", "line_no", "event_type", "predicate", "year", "place")

    return run


for _name in extract.EXTRACTORS:
    QUERIES[f"extract_{_name}"] = _query(_name)
    SQL[f"extract_{_name}"] = SQL_BY_NAME[_name]


TITLES = [
    "Battle of Jena (1806)", "Siege of Toulon.", "Italian campaign of 1796", "Treaty of Tilsit", "Treaties of Paris (both)", "Bataille de Valmy (1792)", "Siège de Toulon", "Traité de Lunéville", "Some page",
    "battle of (unknown)",
]
TITLED = f"""
    select e.user_id as page, t.title, cast(case when e.user_id % 3 <> 0 then 1760 + e.user_id % 40 end as int) as birth_year, cast(case when e.user_id % 4 <> 0 then 1815 + e.user_id % 30 end as int) as death_year,
           'Of ' || cast(count(*) as string) || case e.user_id % 5 when 0 then ' in 44 BC and 1806' when 1 then ' nothing' when 2 then ' in 1650, then 1796.' when 3 then ' 18061 and 1799' else ' in 1840 and 1812' end as text
    from {{events}} e join {values(TITLES, "t", "k", "title")} on t.k = (e.user_id * 3) % {len(TITLES)} group by e.user_id, t.title"""


def year_sql(low: str, high: str) -> str:
    bc = "list_filter(list_transform(regexp_extract_all(lower(text), '(?:^|[^0-9])([0-9]{1,4})\\s*(?:b\\.?c|av\\.? j)', 1), lambda x: x::int), lambda y: -y between " + f"{low} and {high})[1]"
    ad = f"list_filter(list_transform(list_filter(regexp_split_to_array(text, '[^0-9]'), lambda r: length(r) = 4), lambda r: r::int), lambda y: y between {low} and {high})[1]"
    return f"case when {bc} between 1 and 4000 then -{bc} else case when {ad} between 1000 and 2100 then {ad} end end"


SQL["extract_titles"] = f"""
    with p as ({TITLED.format(events="events")}), l as (select *, lower(trim(title)) as low, regexp_replace(trim(string_split(regexp_replace(trim(title), '(?i)^(battle|siege) of ', ''), '(')[1]), '[.,]+$', '') as named from p),
    c as (select *, case when starts_with(low, 'battle of ') then 'battle' when starts_with(low, 'siege of ') then 'siege' when contains(low, 'campaign') then 'military_campaign' when regexp_matches(low, '^treat(y|ies) of ') then 'treaty' end as kind,
                 coalesce(birth_year - 2, death_year - 120, -4000) as lo, coalesce(death_year + 5, least(2100, birth_year + 120), 2100) as hi from l),
    f as (select page, title, kind as event_type, case kind when 'battle' then 'fought_at' when 'siege' then 'besieged' when 'treaty' then 'signed' else 'campaign_at' end as predicate,
                 {year_sql("coalesce(death_year - 120, -4000)", "coalesce(death_year + 5, 2100)")} as year,
                 nullif(case when kind in ('battle', 'siege') then named when kind = 'treaty' then title[instr(title, ' of ') + 4:] end, '') as place, 'military_campaign' as extractor from c where kind is not null),
    g as (select page, title, case when regexp_matches(low, '^(siege|siège)') then 'siege' when regexp_matches(low, '^(treaty|traité)') then 'treaty' else 'battle' end as event_type, {year_sql("lo", "hi")} as year,
                 nullif(trim(string_split(regexp_extract(title, '(?i)^(?:battle of |siege of |treaty of |treaties of |bataille de |siège de |traite de |traité de )(.*)$', 1), '(')[1]), '') as place from c where kind is null)
    select * from f union all
    select page, title, event_type, case event_type when 'treaty' then 'signed' when 'siege' then 'besieged' else 'fought_at' end, year, place, 'page_fallback' from g where place is not null and year is not null"""


def extract_titles(spark, sf_dir):
    """One candidate from each page's title: campaigns by their form, others as a fallback."""
    pages = spark.sql(TITLED, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    found = extract.campaign_titles(pages)
    rest = extract.page_fallback(pages, found)
    return found.withColumn("extractor", F.lit("military_campaign")).unionByName(rest.withColumn("extractor", F.lit("page_fallback")))


QUERIES["extract_titles"] = extract_titles
