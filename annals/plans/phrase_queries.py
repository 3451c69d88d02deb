"""Queries of the phrase extractor, over sentences derived from the events table in SQL that both engines run."""

from __future__ import annotations

from annals import rules
from annals.operators import phrases
from annals.plans import oracle as o
from annals.plans.synth import values

QUERIES, SQL = {}, {}

TITLES = ["Napoleon", "Treaty of Amiens (1802)", "Cleopatra", "Elba", "Some town", "Congress of Vienna", "Hut 8", "", "Saint Helena (island)"]
HEADS = ["Napoleon", "Alan '''Turing'''", "The son of Ann Lee", "She", "Mr. X. Bob Stone", "''Cleopatra''", "The army", "In Rome he", '"Al"']
ACTS = [
    " was born in {y} in {p}.", " married Ann in {y} in {p}.", " lived in {p} in {y}", " signed the peace in {p} in {y};", " met Ann in {p}.", " was seen and wept.",
    " resided in {p} in {y} and lived in {p} in {y}.", " has a statue in {p}, {y}.", " died in {p}.", " went to sea.", " fled in {y}.", " was exiled to {p} in {y} and then lived in {p} in {y}.",
    " resided in {p} in {y}, lived in {p} in {y}",
]
WHERE = ["Paris", "Elba", "the valley and hills", "Saint Helena", "12", "Nowhere", "Notre-Dame"]
LINES = f"""
    select e.event_id, cast(floor(e.event_id / 32) as bigint) as batch, t.title, replace(replace(h.head || a.act, '{{{{y}}}}', e.y), '{{{{p}}}}', w.place) as sentence
    from (select event_id, user_id, case when event_id % 11 = 0 then cast(event_id % 60 + 1 as string) || ' BC' when event_id % 4 = 0 then cast(1912 + event_id % 40 as string) else cast(1790 + event_id % 90 as string) end as y from {{events}}) e
    join {values(TITLES, "t", "k", "title")} on t.k = cast(floor(e.event_id / 5) as bigint) % {len(TITLES)}
    join {values(HEADS, "h", "k", "head")} on h.k = (e.event_id * 5 + e.user_id) % {len(HEADS)}
    join {values(ACTS, "a", "k", "act").replace("{", "{{").replace("}", "}}")} on a.k = (e.event_id * 7 + e.user_id * 3) % {len(ACTS)}
    join {values(WHERE, "w", "k", "place")} on w.k = (e.event_id * 11 + e.user_id) % {len(WHERE)}"""


def lines(spark, sf_dir):
    return spark.sql(LINES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def person(low: str, k: int = 0) -> str:
    return "case " + " ".join(f"when {o.stands_alone(low, a)} then {o.q((p, y, z)[k])}" for p, aliases, y, z in rules.PHRASE_PERSONS for a in aliases) + " end"


YEARS = {p: (p, y, z) for p, _, y, z in rules.PHRASE_PERSONS}
PAGE = lambda k: "case " + " ".join(f"when {o.any_of('page', parts)} then {o.q(YEARS[p][k])}" for p, parts in rules.PHRASE_PAGES) + " end"
LISTED = lambda low: "case " + " ".join(f"when {o.stands_alone(low, n)} then {o.q(t)}" for n, t in phrases.ordered_places()) + " end"
FOUR = lambda s: f"list_filter(regexp_split_to_array({s}, '[^0-9]'), lambda r: length(r) = 4 and r between '1000' and '2100')[-1]"
TRIMMED = lambda s: f"trim(regexp_replace(trim({s}), '[.,;)]+$', ''))"
PLACE = lambda s: f"case when length({TRIMMED(s)}) >= 2 and not regexp_matches({TRIMMED(s)}, '^[0-9]*$') then {TRIMMED(s)} end"
CLEAN = lambda p: f"(length(trim({p})) between 2 and 40 and not {o.any_of(f'lower({p})', rules.PHRASE_NO_PLACE)})"
LAYOUTS = ", ".join(f"({i}, {o.q(c)}, {o.q(v)}, {o.q(k)})" for i, (c, v, k) in enumerate(rules.PHRASE_LAYOUTS))
LAST = r"'(?is)^(.*) in (.*)$'"
DIGITS = r"'[0-9]+\s*(?:b\.?c)?'"

SQL["extract_phrases"] = f"""
    with l as ({LINES.format(events="events")}),
    b as (select event_id, batch, title, trim(regexp_replace(sentence, '''{{2,3}}', '', 'g')) as text, lower(trim(regexp_replace(sentence, '''{{2,3}}', '', 'g'))) as low, lower(trim(title)) as page,
                 lower(trim(string_split(title, '(')[1])) as bare from l),
    c as (select b.*, n, verb, kind, trim(text[:instr(low, cue) - 1]) as before, trim(text[instr(low, cue) + length(cue):]) as said, {person("low")} as anyone
          from b cross join (values {LAYOUTS}) as x(n, cue, verb, kind) where contains(low, cue)),
    d as (select *, lower(before) as early, regexp_replace(trim(case when regexp_matches(before, '(?i) of ') then regexp_extract(before, '(?is)^.* of (.*)$', 1)
                 when contains(before, '. ') then regexp_extract(before, '(?s)^.*\\. (.*)$', 1) else before end), '^["'']+|["'']+$', '', 'g') as name,
                 instr(said, ' in ') as p, instr(lower(said), ' in ') as p1, said[instr(lower(said), ' in ') + 4:] as rest from c),
    e as (select *, instr(lower(rest), ' in ') as p2, {FOUR(f"regexp_extract(said, {LAST}, 2)")} as last_year, {PLACE(f"nullif(regexp_extract(said, {LAST}, 1), '')")} as last_place from d),
    f as (select *, case kind when 'year in place' then case when p > 0 then {FOUR("said[:p - 1]")} end when 'place in year' then last_year
                 else case when p1 > 0 then case when p2 > 0 then {FOUR("rest[:p2 - 1]")} else last_year end end end as time,
                 case kind when 'year in place' then case when p > 0 then {PLACE("said[p + 4:]")} end when 'place in year' then last_place
                 else case when p1 > 0 then case when p2 > 0 then {PLACE("rest[p2 + 4:]")} else last_place end end end as place,
                 coalesce({person("early")}, case when length(name) >= 3 then name end, anyone) as person from e),
    laid as (select event_id, n, person, time, place, verb from f where person is not null and time is not null and {CLEAN("place")}),
    s0 as (select *, {person("low")} as named, coalesce({person("low")}, {PAGE(0)}) as who, coalesce({person("low", 1)}, {PAGE(1)}) as y0, coalesce({person("low", 2)}, {PAGE(2)}) as y1,
                  {LISTED("low")} as text_place, {LISTED("bare")} as title_place, trim(string_split(regexp_extract(trim(title), '^(?:{"|".join(rules.PLACE_TITLES)})(.*)$', 1), '(')[1]) as about from b),
    n0 as (select event_id, y0, y1, unnest(regexp_extract_all(low, {DIGITS})) as d, generate_subscripts(regexp_extract_all(low, {DIGITS}), 1) as i from s0),
    n1 as (select *, case when length(regexp_extract(d, '[0-9]+')) <= 4 then regexp_extract(d, '[0-9]+')::int end as x from n0),
    n2 as (select event_id, i, y0, y1, case when contains(d, 'b') then case when x between 1 and 4000 then -x end when length(regexp_extract(d, '[0-9]+')) = 4 and x between 1000 and 2100 then x end as y from n1),
    n3 as (select event_id, max_by(y, i) as own_year from n2 where y between y0 and y1 group by event_id),
    s1 as (select s0.*, own_year, coalesce(text_place, case when strlen(about) >= 2 then about end,
                  case when bare = lower(title_place) or (starts_with(bare, lower(title_place)) and strlen(title_place) >= 8) then title_place end) as own_place from s0 left join n3 using (event_id)),
    s2 as (select *, (title <> coalesce(lag(title) over (partition by batch order by event_id), ''))::int as turn from s1),
    s3 as (select *, sum(turn) over (partition by batch order by event_id) as run, who is not null and not {o.any_of("low", rules.PHRASE_MEMORY)} as gives from s2),
    s4 as (select *, last_value(case when gives then own_year end ignore nulls) over w as old_year, last_value(case when gives then own_place end ignore nulls) over w as old_place
           from s3 window w as (partition by batch, run order by event_id rows between unbounded preceding and 1 preceding)),
    s5 as (select *, coalesce(own_year, case when old_year between y0 and y1 then old_year end) as year, coalesce(own_place, old_place) as place,
                  coalesce({o.first([(c, v) for v, c in rules.PHRASE_VERBS], lambda p: o.any_of("low", p), 1)}, case when starts_with(page, 'battle of ') then 'fought'
                      when starts_with(page, 'treaty of ') or contains(page, 'concordat') then 'signed' when starts_with(page, 'congress of ') then 'met' end) as verb from s4),
    dense as (select event_id, 100 as n, who as person, case when year < 0 then (-year)::varchar || ' BC' else lpad(year::varchar, 4, '0') end as time, place, verb
              from s5 where who is not null and year is not null and {CLEAN("place")} and verb is not null
                and ((own_year is not null and own_place is not null) or named is not null or {" or ".join(o.stands_alone("low", w) for w in rules.PRONOUNS)})),
    u as (select *, row_number() over (partition by event_id, verb, time, translate(place, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') order by n) as k from (select * from laid union all select * from dense))
    select event_id, (row_number() over (partition by event_id order by n) - 1)::int as ordinal, person, time, place, verb from u where k = 1"""


def extract_phrases(spark, sf_dir):
    """All tuples of the sentences; years and places are carried on within batches of 32."""
    rows = phrases.extract_phrases(lines(spark, sf_dir), "sentence", "title", "batch", "event_id")
    return rows.select("event_id", "ordinal", "person", "time", "place", "verb")


QUERIES["extract_phrases"] = extract_phrases
