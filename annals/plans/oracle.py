"""Rule tables as DuckDB SQL, for the oracle side only."""

from __future__ import annotations

from annals import rules
from annals.functions.place import gazetteer


def q(s: object) -> str:
    return "'" + s.replace("'", "''") + "'" if isinstance(s, str) else str(s)


def any_of(col: str, parts) -> str:
    return "(" + " or ".join(f"contains({col}, {q(p)})" for p in parts) + ")"


def word_of(col: str, words) -> str:
    return f"list_has_any(regexp_split_to_array({col}, '[^a-zA-Z]'), [{', '.join(map(q, words))}])"


def first(table, test, value: int) -> str:
    return "case " + " ".join(f"when {test(r[0])} then {q(r[value])}" for r in table) + " end"


def stands_alone(low: str, word: str) -> str:
    """Whether the first occurrence of word stands between other characters than a-z and 0-9."""
    at = f"instr({low}, {q(word)})"
    return f"({at} > 0 and ({at} = 1 or not regexp_matches({low}[{at} - 1], '^[a-z0-9]$')) and not regexp_matches({low}[{at} + {len(word)}], '^[a-z0-9]$'))"


def others_death(verb: str = "v", low: str = "s", person: str = "lower(trim(person))") -> str:
    last = f"regexp_extract({person}, '(\\S+)$', 1)"
    said = lambda a: " or ".join(f"contains({low}, {x})" for x in (f"{a} || ' died'", f"{a} || ' drowned'", f"'death of ' || {a}", f"{a} || '''s death'"))
    own = f"({said(person)} or (strlen({last}) >= 3 and ({said(last)})))"
    relative = " or ".join(stands_alone(low, r) for r in rules.RELATIVES)
    spoken = f"({word_of(verb, ['died', 'death'])} or {any_of(low, ['drowned', ' died', chr(39) + 's death'])})"
    return f"({spoken} and not {own} and (contains({low}, '''s death') or (({relative}) and {any_of(low, rules.DEATH_CUES)})))"


def category(value: int, verb: str = "v", low: str = "s") -> str:
    memory = [(*r, "legacy") for r in rules.COMMEMORATIVE]
    other = ("'life_event'", f"case when {verb} = '' then 'associated' else {verb} end", "'other'")[value - 1]
    return f"""case when {verb} in ('anecdoted', 'anecdote') or {any_of(low, rules.ANECDOTE_CUES)} then 'anecdote' else coalesce(
        {first(memory, lambda p: any_of(low, p), value)}, case when {others_death(verb, low)} then {q(("life_event", "grieved", "bio")[value - 1])} end, {first(rules.VERBS, lambda p: word_of(verb, p), value)},
        {first(rules.SENTENCE_CUES, lambda p: any_of(low, p), value)}, {other}) end"""


def year(col: str) -> str:
    s = f"regexp_replace(trim({col}), '\\.+$', '')"
    d = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    bc = f"(contains(lower({s}), 'bc') or contains(lower({s}), 'b.c'))"
    n = f"try_cast({d} as int)"
    return f"""case when length({d}) not between 1 and 4 then null when {bc} then case when {n} between 1 and 4000 then -{n} end
        when length({d}) = 4 and {n} between 1000 and 2100 then {n} end"""


def coordinate(col: str, value: int) -> str:
    return "case lower(" + col + ") " + " ".join(f"when {q(g[0])} then {g[value]}" for g in gazetteer()) + " end"


def normal(col: str) -> str:
    return f"lower(regexp_replace(trim(coalesce({col}, '')), '\\s+', ' ', 'g'))"


def barred(*parts: str) -> str:
    return "sha256(" + " || ".join(f"coalesce({p}, '') || '|'" for p in parts) + ")"


def joined(*parts: str) -> str:
    return "sha256(" + " || '|' || ".join(f"coalesce({p}, '')" for p in parts) + ")"


def judged(mentions: str) -> str:
    """A chain of CTEs that ends in judged."""
    return f"""
        m as ({mentions}),
        j0 as (select *, lower(trim(coalesce(verb, ''))) as v, lower(sentence) as s, regexp_replace(trim(place_surface), '\\.+$', '') as label, {year("time_surface")} as y from m),
        j1 as (select *, {category(1)} as et, {category(2)} as vl, {category(3)} as fam, {coordinate("label", 1)} as glat, {coordinate("label", 2)} as glon from j0),
        j2 as (select *, case when {any_of("s", rules.RUMOR)} then 'rumor' when {any_of("s", rules.THEORY)} then 'theory' when fam = 'anecdote' then 'attested'
                    when {any_of("s", rules.UNCERTAIN)} then 'uncertain' when fam in ('bio', 'work') then 'established' else 'attested' end as st,
                75 + case when glat is not null then 10 else 0 end + case when fam <> 'other' then 15 when v <> '' then 8 else 0 end
                + case when strlen(trim(person)) >= 3 then 5 else 0 end as pts from j1),
        j3 as (select *, case when trim(time_surface) = '' or trim(place_surface) = '' then 10 when y is null then 20
                else least(100, case when st in ('rumor', 'theory') then greatest(pts - 5, 55) when st = 'uncertain' then greatest(pts - 8, 55) when st = 'established' then least(pts + 5, 100) else pts end) end as score from j2),
        judged as (select event_id, user_id, channel, person, page, verb, sentence, y as year, score, fam as family, label as place_label, glat as lat, glon as lon, vl as verb_label,
                case when score >= 55 then 'accept' else 'reject' end as verdict, case when score >= 55 then et else 'life_event' end as event_type,
                case when score >= 55 then st else 'uncertain' end as status, score >= 55 and glat is not null as map_eligible,
                case when score >= 55 then trim(person) || ' ' || vl || ' in ' || label || ' (' || regexp_replace(trim(time_surface), '\\.+$', '') || ')' else person end as title from j3)"""
