"""Queries over debates and source plans, over passages derived from the events table in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals import rules
from annals.operators import debates
from annals.operators.persons import CLASSES
from annals.plans import oracle as o
from annals.plans.synth import values

QUERIES, SQL = {}, {}

SECTIONS = ["Historiography", "Early life", "Death and legacy", "Notes on origins", "Campaign in Egypt", "Véritables Origines", "References", "Correspondence", "Identité", "Enfance", "Marriage"]
SAID = [
    "Historians debate whether the Emperor was crowned by his own hand.", "No contemporary source names the village!", "Son origine véritable reste inconnue, plusieurs théories existent.",
    "Theories of poison and arsenic remain.", "Legend has it that he slept at Waterloo.", "Was he Genoese? The question is open.", "A Catalan theory of his origin is disputed.", "His letters show that the language was Castilian.",
    "Some say that it was a cover-up.", "The motive is unclear, and others argue.", "He ate.", "Wait! No. Yes? Then the year is disputed by all sides.", "He was born in a small house by the sea.",
    "The rightful heir was in question after the coup d'état.", "Élu consul, il partit en exil à l'île d'Elbe; c'est controversé.", "The weather was fine and nothing else is known of that day.",
]
WORKS = [
    "La légende dorée", "On the birth-date of Columbus", "Was he Genoese or Catalan", "Hero or villain", "Myth", "A history of bread", "Réception of the works, a controversy", "Identity of the admiral: several theories are in question", " débat ", "Chronologie de la vie",
]
PASSAGES = f"""
    select e.event_id, s.section, w.title, case when e.event_id % 13 > 0 then a.said || case when e.event_id % 2 = 0 then ' ' else chr(10) end || b.said || ' ' || c.said end as body,
           case when e.event_id % 5 = 0 then null when e.event_id % 5 = 1 then '  ' else c.said end as abstract from {{events}} e
    join {values(SECTIONS, "s", "k", "section")} on s.k = e.user_id % {len(SECTIONS)}
    join {values(WORKS, "w", "k", "title")} on w.k = (e.event_id * 3 + e.user_id) % {len(WORKS)}
    join {values(SAID, "a", "k", "said")} on a.k = (e.event_id * 7 + e.user_id) % {len(SAID)}
    join {values(SAID, "b", "k", "said")} on b.k = (e.event_id * 5 + e.user_id * 3) % {len(SAID)}
    join {values(SAID, "c", "k", "said")} on c.k = (e.event_id * 11 + e.user_id) % {len(SAID)}"""


def passages(spark, sf_dir):
    return spark.sql(PASSAGES, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def debate_passages(spark, sf_dir):
    """Hits of the sections that are searched."""
    rows = passages(spark, sf_dir).filter(debates.debate_section(F.col("section"))).select("event_id", "section", "body")
    return debates.passage_hits(rows, "body").drop("body")


def debate_works(spark, sf_dir):
    rows = passages(spark, sf_dir).select("event_id", "title", "abstract")
    return debates.work_hits(rows, "title", "abstract").drop("abstract")


all_of = lambda low: lambda lists: "(" + " and ".join(o.any_of(low, parts) for parts in lists) + ")"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PIECES = "regexp_extract_all({}, '[^.!?\n]*[.!?\n]|[^.!?\n]+')"
OPEN = STRIP.format("regexp_extract(a || p, '[^\x01]*$')")
CUTS = "string_split(list_reduce(list_prepend('', {pieces}), lambda a, p: a || p || if(regexp_matches(p, '[.!?\n]$') and strlen({open}) >= 24, chr(1), '')), chr(1))"
LOOSE = lambda text: f"list_filter(list_transform({CUTS.format(pieces=PIECES.format(text), open=OPEN)}, lambda x: {STRIP.format('x')}), lambda x: strlen(x) >= 24)"
HITS = f"""d as (select *, lower(quote) as q from s), h as (select *, {", ".join(f"{o.first(rules.DEBATES, all_of('q'), i)} as {n}" for i, n in enumerate(debates.HIT, 1))}, {o.first(rules.DEBATED_EVENTS, all_of("q"), 1)} as event_type from d),
    r as (select *, (row_number() over (partition by event_id order by n) - 1)::int as ordinal from h where debate_type is not null)"""
SQL["debate_passages"] = f"""with p as ({PASSAGES.format(events="events")}), s0 as (select event_id, section, lower(section) as t, {LOOSE("body")} as ss from p),
    s as (select event_id, section, unnest(ss) as quote, generate_subscripts(ss, 1) as n from s0 where {o.any_of("t", rules.DEBATE_SECTIONS)} and (not {o.any_of("t", rules.SKIPPED_SECTIONS)} or {o.any_of("t", rules.KEPT_SECTIONS)})), {HITS}
    select event_id, section, ordinal, {", ".join(debates.HIT)}, quote, event_type from r"""
TITLE_EVENT = o.first([(r[0], r[5]) for r in rules.DEBATED_TITLES if r[5]], all_of("t"), 1)
SQL["debate_works"] = f"""with p as ({PASSAGES.format(events="events")}), s0 as (select event_id, title, {LOOSE("title || case when trim(coalesce(abstract, '')) <> '' then '. ' || abstract else '' end")} as ss from p),
    s as (select event_id, title, unnest(ss) as quote, generate_subscripts(ss, 1) as n from s0), {HITS},
    t as (select *, lower(title) as t from p where strlen(trim(title)) >= 8 and event_id not in (select event_id from r))
    select event_id, title, ordinal, {", ".join(debates.HIT)}, quote, event_type from r
    union all select event_id, title, 0, {", ".join(o.first(rules.DEBATED_TITLES, all_of("t"), i) for i in range(1, 5))}, trim(title), {TITLE_EVENT} from t where {" or ".join(all_of("t")(r[0]) for r in rules.DEBATED_TITLES)}"""

KNOWN = list(dict.fromkeys(c[1] for c in CLASSES))
CLASS = "case c_custkey % 15 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(KNOWN)) + " end"
SECOND_CLASS = "case when c_custkey % 4 = 0 then 'military_leader' end"
LANGUAGE = "case c_nationkey % 5 when 0 then 'fr' when 1 then 'fr-CA' when 2 then 'en' when 3 then 'la' end"
COUNTRY = "case c_nationkey % 7 when 0 then 'FRANCE' when 1 then 'French Guiana' when 2 then 'Prussia' end"


def source_plans(spark, sf_dir):
    """The sources to read for each subject, by class, language and country."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey as subject", f"array_compact(array({CLASS}, {SECOND_CLASS})) as classes", f"{CLASS} as primary", f"coalesce({CLASS} = 'military_leader' or c_custkey % 4 = 0, false) as military",
        f"array_compact(array({LANGUAGE})) as languages", f"array_compact(array({COUNTRY})) as countries",
    )
    return debates.source_plan(rows)


def plan_sql() -> str:
    parts = []
    for source, priority, most, who, reason in rules.PLANNED_SOURCES:
        when = {"all": "true", "scholars": "scholar", "french": "(scholar or french)", "military": "cls = 'military_leader'"}[who]
        said = o.q(reason).replace("{class}", "' || cls || '").replace("{facets}", "' || case when military then 'military signal, ' else '' end || greatest(n, 1) || ' facets' || '")
        parts.append(f"select subject, {o.q(source)} as source, {priority} as priority, {most} as max_documents, {said} as reason from c where {when}")
    return " union all ".join(parts)


SQL["source_plans"] = f"""with b as (select c_custkey as subject, coalesce({CLASS}, 'unknown') as cls, ({CLASS} is not null)::int + (c_custkey % 4 = 0)::int as n, coalesce({CLASS} = 'military_leader', false) or c_custkey % 4 = 0 as military,
        coalesce({LANGUAGE} like 'fr%', false) or coalesce(regexp_matches({COUNTRY}, '(?i)france|french'), false) as french from customer),
    c as (select *, cls in ({", ".join(map(o.q, rules.SCHOLARS))}) as scholar from b), u as ({plan_sql()})
    select * from u qualify row_number() over (partition by subject, source order by priority) = 1"""

QUERIES |= {"debate_passages": debate_passages, "debate_works": debate_works, "source_plans": source_plans}
