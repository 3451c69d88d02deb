"""Queries over dense prose: pages derived from the events table in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals import rules
from annals.functions import time
from annals.operators import dense
from annals.plans import oracle as o
from annals.plans.synth import values

QUERIES, SQL = {}, {}

TITLES = ["Napoleon (general)", "Marie Curie", "(untitled)", "Élisa", " ", "Battle of Jena"]
FIRST = [
    "Napoleon was born in Ajaccio on 15 August 1769", "She died at home near the old port on Elba in 1821", "He married Joséphine de Beauharnais at Paris in 1796; they divorced on 10 jan 1810",
    "The army fought on the road to Moscow near Borodino, and lost", "Nothing of note happened;; it rained", "Then the Treaty of Amiens was signed; Notre-Dame stood", "Cleopatra passed away; 30 BC was a dark year",
    "In Waterloo, the Duke Of Wellington defeated all", "he was exiled To Saint Helena", "The king abdicated 1814-04-06 ... and left",
]
SECOND = ["The meeting was held in 12345 rooms of Cairo-on-the-Nile", "été à Rome", "", "; ;", "It was a victory at 7 in the morning at 'Ulm'", "Count Louis-Joseph married Élise", "a wedding 0044 av. J.-C. drew crowds", "They met with Tilsit's men"]
KINDS = ["biography", "structured_statement", "chronology_list", "letter", "page"]
PAGES = f"""
    select e.event_id, case when e.user_id % 4 > 0 then t.title end as title, case when e.event_id % 31 > 0 then k.kind end as kind,
           case when e.event_id % 37 > 0 then f.said || '. ' || s.said || case when e.event_id % 3 = 0 then chr(10) when e.event_id % 3 = 1 then '.' else '' end || g.said end as body from {{events}} e
    join {values(TITLES, "t", "k", "title")} on t.k = e.user_id % {len(TITLES)}
    join {values(KINDS, "k", "k", "kind")} on k.k = (e.event_id * 3 + e.user_id) % {len(KINDS)}
    join {values(FIRST, "f", "k", "said")} on f.k = (e.event_id * 7 + e.user_id) % {len(FIRST)}
    join {values(SECOND, "s", "k", "said")} on s.k = (e.event_id * 5 + e.user_id) % {len(SECOND)}
    join {values(FIRST, "g", "k", "said")} on g.k = (e.event_id * 3 + e.user_id * 7) % {len(FIRST)}"""


def pages(spark, sf_dir):
    return spark.sql(PAGES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: byte lengths of the first items of a list, one byte more for each
BEFORE = "coalesce(list_sum(list_transform({0}[:{1} - 1], lambda y: strlen(y) + 1)), 0)"
CLAUSES = rf"""
    p as ({PAGES.format(events="events")}),
    a as (select *, list_filter(list_transform(regexp_extract_all(body, '[^.\n]*[.\n]|[^.\n]+'), lambda x: {STRIP.format("x")}), lambda x: x <> '') as ss from p where body is not null),
    b as (select *, unnest(ss) as s, generate_subscripts(ss, 1) as si from a),
    c as (select *, string_split_regex(s, '[;.]') as cs, {BEFORE.format("ss", "si")} as base from b),
    d as (select *, unnest(cs) as raw, generate_subscripts(cs, 1) as ci from c),
    e as (select event_id, title, kind, (si - 1)::int as sentence_index, len(list_filter(cs[:ci - 1], lambda x: {STRIP.format("x")} <> ''))::int as clause_index, {STRIP.format("raw")} as clause_text,
                 (base + {BEFORE.format("cs", "ci")})::int as start_offset, (base + {BEFORE.format("cs", "ci")} + strlen(raw))::int as end_offset from d where {STRIP.format("raw")} <> '')"""


def bare(x: str) -> str:
    return rf"regexp_replace(trim({x}), '^[^\p{{L}} ''\-]+|[^\p{{L}} ''\-]+$', '', 'g')"


def place(cue: str) -> str:
    """The last name after the cue; the case of cues is made small first, which keeps positions."""
    small = f"regexp_replace(clause_text, '(?i){cue}', '{cue}', 'g')"
    after = f"array_to_string(string_split({small}, '{cue}')[i:], '{cue}')"
    upto = f"regexp_replace(regexp_extract({after}, '^[^.;,0-9]*'), '( in | at | to ).*$', '')"
    return f"list_filter(list_transform(range(2, 1 + len(string_split({small}, '{cue}'))), lambda i: {bare(upto)}), lambda x: strlen(x) >= 2)[-1]"


def best_place() -> str:
    hits = ", ".join(f"case when {o.stands_alone('low', p)} then {o.q(p)} end" for p in rules.CLAUSE_PLACES)
    return f"list_reduce(list_prepend('', list_filter([{hits}], lambda x: x is not null)), lambda x, y: if(strlen(y) > strlen(x), y, x))"


def time_sql() -> str:
    months = ", ".join(f"case when regexp_matches(low, '{time.month_pattern(n)}') then regexp_extract(low, '{time.month_pattern(n)}', 1) || ' {n} ' || regexp_extract(low, '{time.month_pattern(n)}', 2) end" for n, _ in time.MONTHS)
    bc = r"regexp_extract(low, '(?:^|[^0-9])0*([0-9]{1,4})\s*(?:b\.?c|av\.? j)', 1)"
    four = "list_filter(string_split_regex(low, '[^0-9]'), lambda x: length(x) = 4 and try_cast(x as int) between 1 and 2100)[1]::int::varchar"
    return f"coalesce({months}, nullif(regexp_extract(low, '{time.ISO}'), ''), nullif({bc}, '') || ' BC', {four})"


def subject_sql() -> str:
    base = "trim(string_split(title, '(')[1])"
    words = rf"list_transform(list_filter(string_split_regex(clause_text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\p{{L}}\-]+|[^\p{{L}}\-]+$', '', 'g'))"
    marked = rf"array_to_string(list_transform({words}, lambda w: if(regexp_matches(w, '^\p{{Lu}}'), w, '#')), ' ')"
    run = rf"trim(regexp_extract({marked}, '[^# ][^#]*'))"
    return f"case when {base} <> '' or (title is not null and contains(low, 'he ')) then {base} else coalesce(nullif({run}, ''), 'Unknown') end"


OBJECT = rf"nullif({bare(r'''regexp_replace(regexp_replace(trim(regexp_extract(clause_text, '(?i) married (.*)$', 1)), '( in | at ).*$', ''), '[.;,].*$', '')''')}, '')"

QUERIES |= {
    "dense_clause_spans": lambda spark, sf_dir: dense.clauses(pages(spark, sf_dir), "event_id", "body").select("event_id", "sentence_index", "clause_index", "clause_text", "start_offset", "end_offset"),
    "extract_dense": lambda spark, sf_dir: dense.dense_clauses(pages(spark, sf_dir), "event_id", "body", "title", "kind").drop("body", "title", "kind", "end_offset"),
    "dense_predicates": lambda spark, sf_dir: dense.dense_clauses(pages(spark, sf_dir), "event_id", "body", "title").groupBy("event_type", "predicate").agg(F.count("*").alias("n")),
}
PREDICATE = lambda value: o.first(rules.PREDICATES, lambda p: o.any_of("low", p), value)
SQL |= {
    "dense_clause_spans": f"with {CLAUSES} select event_id, sentence_index, clause_index, clause_text, start_offset, end_offset from e",
    "extract_dense": f"""with {CLAUSES}, f as (select *, lower(clause_text) as low from e where kind is null or kind not in ('structured_statement', 'chronology_list')),
        g as (select *, {PREDICATE(1)} as event_type, {PREDICATE(2)} as predicate, coalesce({", ".join(place(c) for c in reversed(dense.PLACE_CUES))}) as pl, {OBJECT} as ob, {best_place()} as known from f)
        select event_id, sentence_index, clause_index, clause_text, start_offset, event_type, predicate, {subject_sql()} as subject_surface, {time_sql()} as time_surface,
               coalesce(pl, nullif(known, '')) as place_surface, case when ob is distinct from pl then ob end as object_surface from g where event_type is not null""",
    "dense_predicates": f"with {CLAUSES}, f as (select lower(clause_text) as low from e), g as (select {PREDICATE(1)} as event_type, {PREDICATE(2)} as predicate from f) select event_type, predicate, count(*) as n from g where event_type is not null group by all",
}
