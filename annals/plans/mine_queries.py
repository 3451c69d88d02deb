"""Queries of the sentence miner, over sentences derived from the events table in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals import rules
from annals.functions.place import gazetteer, title_case
from annals.operators import mine
from annals.plans import oracle as o
from annals.plans.synth import values

QUERIES, SQL = {}, {}

TITLES = ["Napoleon", "Battle of Jena (1806)", "Some village", "Hundred Days", "Marie Curie", "Elba", "Les Misérables", "Congress of Vienna", "Villequier (town)", "Cleopatra"]
HEADS = ["Napoleon", "Curie", "He", "Victor Hugo", "The hugonaut", "They", "According to legend, Bonaparte", "Nobody", "The daughter of Victor Hugo", "Madame Curie", "It is the shed where she"]
ACTS = [
    "was born in", "slept near", "fought against all at", "died in", "died, and the wife of the king wept in", "has a statue in", "studied in", "left for", "met friends from", "was buried in",
    "read of 's death in", "set sail to",
]
WHERE = ["Paris", "Villequier", "Nowhere", "Egypt", "the house", "Saint Helena", "Warsaw", "Rome, Italy", "Kraków"]
WHEN = [" in 1812.", " in 1867 and 1812.", ".", " in 31 BC.", " in 1843 and not in 99999.", " (1801).", " in 1911."]
LINES = f"""
    select e.event_id, e.user_id, cast(e.event_id div 64 as bigint) as section, t.title, h.head || ' ' || a.act || ' ' || w.place || y.said as sentence from {{events}} e
    join {values(TITLES, "t", "k", "title")} on t.k = e.user_id % {len(TITLES)}
    join {values(HEADS, "h", "k", "head")} on h.k = (e.event_id * 5 + e.user_id) % {len(HEADS)}
    join {values(ACTS, "a", "k", "act")} on a.k = (e.event_id * 7 + e.user_id * 3) % {len(ACTS)}
    join {values(WHERE, "w", "k", "place")} on w.k = (e.event_id * 11 + e.user_id) % {len(WHERE)}
    join {values(WHEN, "y", "k", "said")} on y.k = (e.event_id * 13 + e.user_id) % {len(WHEN)}"""


def lines(spark, sf_dir):
    return spark.sql(LINES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
alone_any = lambda low, names: "(" + " or ".join(o.stands_alone(low, n) for n in names) + ")"


def best(low: str) -> str:
    names = sorted(enumerate(gazetteer()), key=lambda x: (-x[1][3], -len(x[1][0].encode()), x[0]))
    return "case " + " ".join(f"when {o.stands_alone(low, n)} then {o.q(title_case(n))}" for _, (n, *_) in names) + " end"


SUBJECT = "case " + " ".join(f"when {alone_any('s', x[1])} then {i}" for i, x in enumerate(rules.SUBJECTS)) + " " + " ".join(
    f"when p = {o.q(x[0].lower())} or {o.any_of('p', x[2])} then {i}" for i, x in enumerate(rules.SUBJECTS)
) + " end"
OF = lambda k: "case subject " + " ".join(f"when {i} then {o.q(x[k])}" for i, x in enumerate(rules.SUBJECTS)) + " end"
SAID = lambda n: o.any_of("s", [f"{n} died", f"{n} drowned", f"death of {n}", f"{n}'s death"])
FOUND = f"""
    l as ({LINES.format(events="events").replace(" div ", " // ")}),
    l0 as (select *, {LOW.format("sentence")} as s, {LOW.format("title")} as p, trim(string_split(title, '(')[1]) as bare from l),
    l1 as (select *, {SUBJECT} as subject, {LOW.format("bare")} as b from l0),
    l2 as (select *, {OF(3)} as y0, {OF(4)} as y1, {best("s")} as said_place, {best("b")} as page_place, nullif(trim(string_split(regexp_extract(title, '^(Battle of |Treaty of |Treaties of |Congress of |Siege of |Coup of )(.*)$', 2), '(')[1]), '') as about from l1),
    n as (select event_id, unnest(regexp_extract_all(s, '[0-9]+\\s*(?:b\\.?c)?')) as d, generate_subscripts(regexp_extract_all(s, '[0-9]+\\s*(?:b\\.?c)?'), 1) as i from l2),
    n1 as (select event_id, i, case when contains(d, 'b') then case when x between 1 and 4000 then -x end when length(regexp_extract(d, '[0-9]+')) = 4 and x between 1000 and 2100 then x end as y
           from (select *, case when length(regexp_extract(d, '[0-9]+')) <= 4 then regexp_extract(d, '[0-9]+')::int end as x from n)),
    y as (select n1.event_id, arg_max(y, i) as own_year from n1 join l2 using (event_id) where y between y0 and y1 group by 1),
    l3 as (select l2.*, own_year, case when subject is not null then coalesce(said_place, case when strlen(about) >= 2 then about end,
                  case when {LOW.format("page_place")} = b or (starts_with(b, {LOW.format("page_place")}) and strlen(page_place) >= 8) then page_place end) end as own_place,
                  {o.any_of("s", rules.MINED_MEMORY)} as memory from l2 left join y using (event_id))"""


def query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("subject_resolution", f"with {FOUND} select event_id, {OF(0)} as subject, own_year, own_place from l3")
def subject_resolution(spark, sf_dir):
    """Who each sentence is about, with its own year and place."""
    rows = mine.resolved(lines(spark, sf_dir), "sentence", "title")
    return rows.select("event_id", mine.of_subject(F.col("subject"), 0).alias("subject"), "own_year", "own_place")


@query(
    "mine_candidates",
    f"""with {FOUND},
    l4 as (select *, last_value(case when strlen(trim(sentence)) >= 20 and not memory and subject is not null then own_year end ignore nulls) over w as cy,
                  last_value(case when strlen(trim(sentence)) >= 20 and not memory and subject is not null then own_place end ignore nulls) over w as cp
           from l3 window w as (partition by user_id, section order by event_id rows between unbounded preceding and 1 preceding)),
    l5 as (select *, coalesce(own_year, case when cy between y0 and y1 then cy end) as year, coalesce(own_place, cp) as place,
                  {o.any_of("s", rules.MINED_ANECDOTES)} as tale, case {" ".join(f"when contains(s, {o.q(c)}) then {o.q(v)}" for c, v in rules.MINED_VERBS)} end as cue,
                  case subject {" ".join(f"when {i} then {alone_any('s', x[1])}" for i, x in enumerate(rules.SUBJECTS))} end or {alone_any("s", rules.PRONOUNS)} as hook,
                  case subject {" ".join(f"when {i} then ({' or '.join(SAID(n) for n in x[1])})" for i, x in enumerate(rules.SUBJECTS))} end as own_death,
                  contains(s, '''s death') or ({alone_any("s", rules.RELATIVES)} and {o.any_of("s", rules.DEATH_CUES)}) as other_death from l4)
    select event_id, {OF(0)} as person, case when year < 0 then (-year)::varchar || ' BC' else lpad(year::varchar, 4, '0') end as time, place,
           case when tale then 'anecdoted' when cue = 'died' and other_death and not own_death then 'grieved' else cue end as verb, case when tale then 'dump:anecdote' else 'dump_keywords' end as extractor
    from l5 where strlen(trim(sentence)) >= 28 and subject is not null and year is not null and place is not null and (tale or (not memory and cue is not null))
      and ((own_year is not null and own_place is not null) or hook)""",
)
def mine_candidates(spark, sf_dir):
    """Candidates of all sentences; the carry ends with each section of a page."""
    rows = mine.mined(lines(spark, sf_dir), "sentence", "title", ["user_id", "section"], "event_id")
    return rows.select("event_id", "person", "time", "place", "verb", "extractor")
