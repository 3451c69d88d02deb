"""Queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .language_id import predictions
from .lm_score import lm_scores
from .manifest import every_fifth, manifest_proofs
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import quality_scores
from .runs import periodic_runs
from .suffix_dedup import repeated_strings
from .token_counts import token_counts
from .tokens import read_ids, write_ids
from .url_filter import url_verdicts


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/annals/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_ids(spark, path, digest=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), end_id=1, capacity=2048)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"), order=3)
    return found.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), whole=True)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=85)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of each tenth document (by the crc32 of its id) repeat with a period from some word on."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), edit=planted_period).drop("runs")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_proofs(table(spark, sf_dir, "documents"), tamper=every_fifth)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_token_ids": op2_token_ids,
    "op3_packing": op3_packing,
    "op4_lm_scores": op4_lm_scores,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_near_dedup": op9_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_dedup": op13_suffix_dedup,
}

NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = f"regexp_extract_all({NORMAL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SPACED = f"regexp_extract_all({NORMAL}, '[^\\x20\\x09-\\x0D]+')"

#: crc32 of a decimal number: bytes and, after each, eight shifts.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''),
        lambda c: [unicode(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end))"""

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def leaf_sql(text: str) -> str:
    values = ["doc_id::varchar", "source::varchar", "lang::varchar", "n_chars::varchar", text]
    return "sha256(concat(" + ", ".join(f"case when {v} is null then '-' else concat(strlen({v}), ':', {v}) end" for v in values) + "))"


SQL: dict[str, str] = {
    "op13_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
        s as (select doc_id, j, substr(x, 2 * j + 1, 200) as k from (select *, unnest(range(0, greatest(n - 99, 0))) as j from d)),
        r as (select doc_id, j from (select doc_id, j, row_number() over (partition by k order by doc_id, j) as o from s) where o > 1),
        e as (select doc_id, j, coalesce(j > lag(j) over (partition by doc_id order by j) + 100, true)::int as new from r),
        g as (select doc_id, j, sum(new) over (partition by doc_id order by j) as g from e),
        p as (select doc_id, min(j) as a, max(j) + 100 as b from g group by doc_id, g),
        q as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as z from p),
        k as (
            select doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' order by a) as pre, max(b) as last, sum(b - a) as removed, count(*) as n_spans
            from q join d using (doc_id) group by doc_id)
        select doc_id, n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(pre, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join k using (doc_id)""",
    "op12_merkle_manifest": f"""
        with recursive d as (
            select doc_id, source, {leaf_sql("text")} as leaf, if({CRC32} % 5 = 0, {leaf_sql(LOWERED)}, {leaf_sql("text")}) as shown from documents),
        l as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from d),
        t as (
            select 0 as h, source, i, leaf as x, n from l
            union all
            select h + 1, source, i // 16, sha256(string_agg(x, '' order by i)), (n + 15) // 16 from t where n > 1 group by h, source, i // 16, n),
        s as (select source, x as subroot, h as height, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from t where n = 1),
        u as (
            select 0 as h, i, subroot as x, n from s
            union all
            select h + 1, i // 16, sha256(string_agg(x, '' order by i)), (n + 15) // 16 from u where n > 1 group by h, i // 16, n),
        tp as (
            select h, source, i, coalesce(string_agg(x, '') over (partition by h, source, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as lo,
                   coalesce(string_agg(x, '') over (partition by h, source, i // 16 order by i rows between 1 following and unbounded following), '') as hi
            from t where n > 1),
        up as (
            select h, i, coalesce(string_agg(x, '') over (partition by h, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as lo,
                   coalesce(string_agg(x, '') over (partition by h, i // 16 order by i rows between 1 following and unbounded following), '') as hi
            from u where n > 1),
        path as (
            select doc_id, leaf, tp.h as k, lo, hi from l join tp on l.source is not distinct from tp.source and tp.i = l.i // (16 ** tp.h)::bigint
            union all
            select doc_id, leaf, s.height + up.h, lo, hi from l join s on l.source is not distinct from s.source join up on up.i = s.i // (16 ** up.h)::bigint),
        p as (select doc_id, leaf, list(struct_pack(lo := lo, hi := hi) order by k) as segs from path group by doc_id, leaf),
        w as (select l.doc_id, l.leaf, l.source, l.shown, coalesce(segs, []) as segs from l left join p on l.doc_id is not distinct from p.doc_id and l.leaf = p.leaf),
        f as (
            select doc_id, leaf, source, segs, shown as x, 1 as k from w
            union all
            select doc_id, leaf, source, segs, sha256(segs[k].lo || x || segs[k].hi), k + 1 from f where k <= len(segs))
        select doc_id, leaf, subroot, (select x from u where n = 1) as root, sha256(array_to_string(list_transform(segs, lambda g: g.lo || g.hi), '')) as proof_sha256,
               x as folded_root, x = (select x from u where n = 1) as verified
        from f join s on f.source is not distinct from s.source where k = len(segs) + 1""",
    "op4_lm_scores": f"""
        with d as (select doc_id, {WORDS} as ws from documents),
        w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
        g as (select *, lag(w) over a as p, lag(w, 2) over a as q from w window a as (partition by doc_id order by i)),
        c as (select doc_id, i, w,
                     count(*) over (partition by w) - count(*) over (partition by doc_id, w) as c1,
                     if(i > 1, count(*) over (partition by p, w) - count(*) over (partition by doc_id, p, w), 0) as c2,
                     if(i > 2, count(*) over (partition by q, p, w) - count(*) over (partition by doc_id, q, p, w), 0) as c3 from g),
        b as (select *, lag(c1) over a as b1, lag(c2) over a as b2 from c window a as (partition by doc_id order by i)),
        v as (select doc_id, c2 = 0 and c3 = 0 as single,
                     case when c3 > 0 then ln(c3 / b2) when c2 > 0 then ln(c2 / b1) + (least(i, 3) - 2) * ln(0.4)
                          else ln(if(c1 > 0, c1, 0.4)) + (least(i, 3) - 1) * ln(0.4) end as v from b),
        s as (select doc_id, sum(v) as v, count_if(single) as n_single from v group by doc_id),
        n as (select doc_id, len(ws) as n_words, greatest(1, sum(len(ws)) over () - len(ws)) as others from d),
        l as (select doc_id, n_words, coalesce(n_single, 0)::bigint as n_single, coalesce(v - n_single * ln(others), 0) as l from n left join s using (doc_id))
        select doc_id, n_words, n_single, round(l, 4) as log_score, if(n_words > 0, round(l / n_words, 6), null) as mean_log_score from l""",
    "op9_near_dedup": f"""
        with recursive w as (select doc_id, {SPACED} as ws from documents),
        s as (select distinct doc_id, array_to_string(ws[k:k + 4], ' ') as g
              from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as k from w where len(ws) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
        both_ways as (select x, y from l union all select y, x from l),
        r as (select doc_id, doc_id as root from documents union select y, root from r join both_ways on x = doc_id),
        c as (select doc_id, min(root) as component_id from r group by doc_id)
        select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)""",
    "op5_decontaminate": f"""
        with d as (select doc_id, {WORDS} as ws from documents),
        i as (select item_id::varchar as item, {WORDS} as ws from benchmark),
        starts as (select *, least(10, len(ws)) as m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as k from i where len(ws) > 0),
        patterns as (select distinct item, m, array_to_string(ws[k:k + m - 1], ' ') as w from starts),
        places as (
            select doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') as w
            from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as k from d cross join (select distinct m from patterns))),
        found as (select doc_id, k, m, item from places join patterns using (m, w)),
        hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + m)) as p from found) group by doc_id),
        named as (
            select doc_id, count(*) as n, string_agg(item, ',' order by item) as names
            from (select distinct doc_id, item from found) group by doc_id)
        select d.doc_id, len(ws) as n_words, coalesce(hits.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
        from d left join hits using (doc_id) left join named using (doc_id)""",
    "op6_exact_dedup": f"""
        with d as (select doc_id, sha256({NORMAL}) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, text_sha256
        from d window w as (partition by text_sha256)""",
}
