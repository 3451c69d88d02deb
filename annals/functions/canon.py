"""Canonical JSON of nested columns, and what is addressed by its digest: atoms, triples, bundles, bibliographic records."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, StringType, StructType

from annals.functions.text import let

# Fixed values.
ATOM_KINDS = ["question", "proposition", "source", "person", "date", "debate", "theme", "event", "place", "predicate"]
PREDICATE_NAMES = {"has_proposition": "has-proposition", "supported_by": "supported-by", "authored_by": "authored-by"}
#: Letters that are two, or have no accent to take off.
LETTERS = {"œ": "oe", "æ": "ae", "ß": "ss", "þ": "th", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "ŋ": "ng", "ħ": "h"}


def escaped(text: Column) -> Column:
    """A JSON string without its quotes: short escapes where JSON has them, \\u00xx for other control characters, the rest as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    for c in map(chr, range(32)):
        out = F.replace(out, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04x}")))
    return F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text)


def canonical(value: Column, kind: DataType) -> Column:
    """Compact JSON with the keys of structs and maps in byte order, whatever the order of the columns; nulls stay. Arrays keep theirs.

    Strings, integers, booleans, and arrays, structs and maps (with string keys) of them.
    """
    some = value.isNotNull()
    if isinstance(kind, StringType):
        out = F.concat(F.lit('"'), escaped(value), F.lit('"'))
    elif isinstance(kind, (IntegralType, BooleanType)):
        out = value.cast("string")
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        parts = [F.concat(F.lit(f'"{f.name}":'), canonical(value[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, MapType):
        pair = lambda e: F.concat(F.lit('"'), escaped(e["key"]), F.lit('":'), canonical(e["value"], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), pair), ","), F.lit("}"))
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.when(some, out).otherwise(F.lit("null"))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def fingerprint_of_json(text: Column) -> Column:
    """The digest of a JSON text whatever the order of its keys: a variant keeps the keys of objects sorted, at any depth. Null where it is no JSON."""
    return digest(F.to_json(F.try_parse_json(text)))


def fold_table() -> tuple[str, str]:
    """Latin letters with marks, and what they are without: by their decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(c, p) for c, p in pairs if p.isascii() and p != c]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def slug_fragment(raw: Column) -> Column:
    """Latin letters without marks, in lower case, other characters as single hyphens, none at the ends; x if nothing is left."""
    out = F.lower(F.translate(raw, *fold_table()))
    for letter, plain in LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "x").otherwise(out)


def atom(kind: str, fragment: Column) -> Column:
    """struct(id, kind, fingerprint): the id is kind:fragment."""
    if kind not in ATOM_KINDS:
        raise ValueError(f"unknown kind of atom: {kind}")
    text = lambda slug: F.concat(F.lit('{"fragment":"'), slug, F.lit(f'","kind":"{kind}","v":1}}'))
    made = lambda slug: F.struct(F.concat(F.lit(f"{kind}:"), slug).alias("id"), F.lit(kind).alias("kind"), digest(text(slug)).alias("fingerprint"))
    return let(slug_fragment(fragment), made)


def predicate(key: str) -> Column:
    return atom("predicate", F.lit(PREDICATE_NAMES.get(key, key)))


def triple(subject: Column, verb: Column, thing: Column, role: str) -> Column:
    """struct(subject, predicate, object, role, fingerprint, key) of three atoms: its digest is over their ids."""
    s, p, o = subject["id"], verb["id"], thing["id"]
    text = F.concat(F.lit('{"object":"'), o, F.lit('","predicate":"'), p, F.lit(f'","role":"{role}","subject":"'), s, F.lit('","v":1}'))
    return F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(role).alias("role"), digest(text).alias("fingerprint"), F.concat_ws("|", s, p, o).alias("key"))


def bundle(question: Column, proposition: Column, event_id: Column, place: Column, person: Column) -> Column:
    """struct(atoms, triples, target, fingerprint) of a debate.

    question, proposition, person: fragments and a name; event_id and place may be null. Atoms come
    once each. target is the triple that is voted on. The fingerprint is over the triples' digests,
    sorted, and so doesn't depend on the order in which atoms and triples were put together.
    """
    event = atom("event", F.concat(F.lit("canonical-event-"), event_id.cast("string")))
    has, about, at = predicate("has_proposition"), predicate("about"), predicate("at")
    known = event_id.isNotNull()
    placed = known & F.coalesce(F.trim(place) != "", F.lit(False))

    def put_together(x: Column) -> Column:
        q, p, e, w, who = (x[k] for k in "qpewn")
        main = triple(q, has, p, "question_has_proposition")
        atoms = F.array(q, p, has, F.when(known, e), F.when(known, about), F.when(placed, w), F.when(placed, at), who)
        triples = F.array_compact(F.array(main, F.when(known, triple(p, about, e, "proposition_about_event")), F.when(placed, triple(e, at, w, "event_at_place"))))
        seal = lambda t: digest(F.array_join(F.array_sort(F.transform(t, lambda y: y["fingerprint"])), "|"))
        return let(triples, lambda t: F.struct(F.array_distinct(F.array_compact(atoms)).alias("atoms"), t.alias("triples"), t[0].alias("target"), seal(t).alias("fingerprint")))

    ends = {"q": atom("question", question), "p": atom("proposition", proposition), "e": event, "w": atom("place", place), "n": atom("person", person)}
    return let(F.struct(*[v.alias(k) for k, v in ends.items()]), put_together)


#: The fields of a bibliographic record that its fingerprint covers.
RECORD = (
    "source_kind string, external_id string, document_type string, title string, language string, abstract_text string, academic_status string, access_level string, full_text_available boolean,"
    " rights_normalized string, publisher_or_institution string, publication_time string, identifiers array<struct<scheme string, value string>>,"
    " contributions array<struct<role string, name string, identifier_scheme string, identifier_value string, ordinal int>>,"
    " subjects array<struct<scheme string, label string, identifier string>>, snapshot_text string"
)


def tupled(values: Column, kind: ArrayType) -> Column:
    """Structs as JSON arrays of their fields, in order."""
    one = lambda x: F.concat(F.lit("["), F.concat_ws(",", *[canonical(x[f.name], f.dataType) for f in kind.elementType.fields]), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(values, F.array().cast(kind)), one), ","), F.lit("]"))


def record_fingerprint(record: StructType) -> Column:
    """The digest of a record's identity and metadata, from columns of the names and types in RECORD: a change of any field gives another one."""
    parts = []
    for f in sorted(record.fields, key=lambda f: f.name):
        nested = isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)
        value = tupled(F.col(f.name), f.dataType) if nested else canonical(F.col(f.name), f.dataType)
        parts.append(F.concat(F.lit(f'"{f.name}":'), value))
    return digest(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
