"""MinHash near-dedup: a signature-coordinate inverted join.

A document's set is its distinct shingles, as 64-bit hashes. Documents with equal sets (a 128-bit
digest of the set and its size agree) form a class; from here on classes take part, one row each. A
class has a signature of ``k`` minhash coordinates of 64 bits, and is posted under every
(coordinate, value) pair that it shares with another class.

Two classes collide in at least ``t`` of ``k`` coordinates only if, with every class's pairs in one
common order, rarest first, their prefixes of k - t + 1 pairs share one. Pairs that nobody shares come
first in that order, so a class with k - t + 1 of those needs no look at others, and pairs that very
many share (a passage on many pages) stay out of the prefixes of all that have enough rarer ones.
Signatures of two classes at the similarity threshold s collide in k * s coordinates on average;
``t`` lies so far below that fewer than one link in a million at the threshold is missed.

Posting lists are never expanded into all pairs. In a first round each list pairs its members with
its hub, in a second one the members outside the component that most of a list belongs to meet one
other member of that component: pairs that collide often enough are confirmed on the full sets, and
connected components are taken. Lists whose members then lie in one component are skipped. The lists
left that have the same hub are merged together: the members outside their largest component are
the queries against all members, in blocks of bounded rows and bytes, so that a long list spreads
over many tasks. In a block, collisions are counted on the queries' shortest lists; the longer ones
are only probed for members that can still reach ``t``; pairs that do are confirmed on the full
sets. Only classes that share a hub's pairs meet, so lists never chain into larger groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, space_words

K = 64
MISS = 1e-6  # the share of links at the threshold that collide in fewer coordinates than are asked for
SEED = 20


def least_collisions(k: int, percent: int) -> int:
    """The most collisions that all but MISS of the pairs at the threshold have."""
    s, below = percent / 100, 0.0
    for t in range(k):
        below += math.comb(k, t) * s**t * (1 - s) ** (k - t)
        if below > MISS:
            return max(1, t)
    return k


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; the whole sequence if it has fewer than size words."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int = 64) -> np.ndarray:
    """Each coordinate's least value; its ``bits`` high bits."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * a + b).min(axis=0), out=least)
    return least >> np.uint64(64 - bits)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63


SIGNED = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig array<long>"


def signer(size: int, k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(k)
        for batch in slices(batches):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            digests = [digest(s) if len(s) else (None, None) for s in sets]
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_hash": batch.column("text_hash"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "d1": pa.array([d for d, _ in digests], pa.int64()),
                    "d2": pa.array([d for _, d in digests], pa.int64()),
                    "sig": pa.array([signature(s, a, b, bits).view(np.int64) if len(s) else none for s in sets], pa.list_(pa.int64())),
                }
            )

    return run


def collisions(a, b):
    """Number of coordinates in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def prefixes(classes: DataFrame, k: int, t: int) -> DataFrame:
    """(item, cls, own): the shared (coordinate, value) pairs in each class's prefix; own is the number that nobody shares."""
    posts = classes.select("cls", F.posexplode("sig").alias("c", "v")).select("cls", F.xxhash64("c", "v").alias("item"))
    counts = posts.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1")
    shared = posts.join(counts, "item")
    ranked = shared.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items"))  # at most k
    own = F.lit(k) - F.size("items")
    first = ranked.select("cls", own.alias("own"), F.explode(F.slice("items", F.lit(1), F.greatest(F.lit(0), F.lit(k - t + 1) - own))).alias("x"))
    rows = first.select("x.item", "cls", "own")
    met = rows.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1").select("item")
    return rows.join(met, "item")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of links (a, b). Alternates large-star and
    small-star steps, each written to the shared folder, until labels stay."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    was = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(large.join(low, "u").select(F.inline(ends)).filter("u <> v").distinct(), "edges")
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, t: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures collide in t coordinates and whose full sets are similar enough."""
    sig = sets.select("cls", "sig", "n_shingles")
    sized = pairs.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a").join(
        sig.select(F.col("cls").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b"
    )
    # sets of too different sizes can't be similar enough
    fit = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (collisions(F.col("sa"), F.col("sb")) >= t)
    asked = cut(sized.filter(fit).select("a", "b"), "candidates")
    both = asked.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return cut(both.filter(100 * common >= percent * (F.size("ha") + F.size("hb") - common)).select("a", "b"), "links")


def pairs_of(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def hub_pairs(posts: DataFrame) -> DataFrame:
    """Pairs of each list's hub, the class that shares the most with others, and its members."""
    hub = posts.groupBy("item").agg(F.min_by("cls", F.struct("own", "cls")).alias("hub"))
    return posts.join(hub, "item").filter("cls <> hub").select(*pairs_of("cls", "hub")).distinct()


def second_pairs(rows: DataFrame) -> DataFrame:
    """Each member outside its list's largest component, with one member of that component, another one in each list."""
    sizes = rows.groupBy("item", "label").agg(F.count("*").alias("n"), F.min_by("cls", F.xxhash64("item", "cls")).alias("one"))
    top = sizes.groupBy("item").agg(F.max_by(F.struct("label", "one"), F.struct("n", "label")).alias("top"))
    return rows.join(top, "item").filter("label <> top.label").select("cls", F.col("top.one").alias("one")).select(*pairs_of("cls", "one")).distinct()


def unsettled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """(item, cls, own, label) of the lists whose members have several labels."""
    rows = posts.join(labels, posts["cls"] == labels["node"], "left").select("item", "cls", "own", F.coalesce("label", "cls").alias("label"))
    several = rows.groupBy("item").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("item")
    return cut(rows.join(several, "item"), "postings")


def scan_block(t: int, percent: int, k: int, bits: int):
    """Links between the queries (role 0) and the members (role 1) of a block that have different labels, one for each query and label.

    Collisions are counted by merging posting lists of the members' signatures: for a query, every
    member that reaches t has its first collision on one of the k - t + 1 shortest lists; the others
    are probed, longest last, as long as t can be reached.
    """

    def run(block: pa.Table) -> pa.Table:
        a, b = coefficients(k)
        role, cls, label = block.column("role").to_numpy(), block.column("cls").to_numpy(), block.column("label").to_numpy()
        lists = block.column("hashes").combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
        flat = lists.flatten().to_numpy().view(np.uint64)
        sets = [flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        ys, xs = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        links_a, links_b = [], []
        if len(ys) and len(xs):
            sig_y = np.array([signature(sets[y], a, b, bits) for y in ys])
            order = np.argsort(sig_y, axis=0, kind="stable")  # one sorted column of postings for each coordinate
            values = np.take_along_axis(sig_y, order, axis=0)
            n_y = np.array([len(sets[y]) for y in ys])
        for x in xs.tolist() if len(ys) else []:
            own, sig = sets[x], signature(sets[x], a, b, bits)
            low = np.array([np.searchsorted(values[:, c], sig[c], "left") for c in range(k)])
            size = np.array([np.searchsorted(values[:, c], sig[c], "right") for c in range(k)]) - low
            shortest = np.argsort(size, kind="stable")
            count = np.zeros(len(ys), np.int64)
            for c in shortest[: k - t + 1].tolist():  # merged
                count[order[low[c] : low[c] + size[c], c]] += 1
            live = np.flatnonzero((count > 0) & (label[ys] != label[x]) & (100 * np.minimum(n_y, len(own)) >= percent * np.maximum(n_y, len(own))))
            for i, c in enumerate(shortest[k - t + 1 :].tolist()):  # probed
                count[live] += sig_y[live, c] == sig[c]
                live = live[count[live] + (t - 2 - i) >= t]
            linked: set[int] = set()
            for y in live[np.argsort(-count[live], kind="stable")].tolist():
                at = int(label[ys[y]])
                if at not in linked:
                    other = sets[ys[y]]
                    common = np.intersect1d(own, other, assume_unique=True).size
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        linked.add(at)
                        links_a.append(int(cls[x]))
                        links_b.append(int(cls[ys[y]]))
        return pa.table({"a": pa.array(links_a, pa.int64()), "b": pa.array(links_b, pa.int64())})

    return run


def hub_blocks(sets: DataFrame, rows: DataFrame, block_rows: int, block_hashes: int) -> DataFrame:
    """(hub, xb, yb, role, cls, label, hashes): the members of the lists of each hub, dealt into blocks that meet in pairs."""
    hub = rows.groupBy("item").agg(F.min_by("cls", F.struct("own", "cls")).alias("hub"))
    members = rows.join(hub, "item").select("hub", "cls", "label").distinct().join(sets.select("cls", F.col("n_shingles").alias("n")), "cls")
    parts = members.groupBy("hub", "label").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    sizes = parts.groupBy("hub").agg(F.sum("n").alias("all"), F.sum("rows").alias("all_rows"), F.max_by(F.struct("label", "n", "rows"), F.struct("n", "label")).alias("top"))
    members = cut(members.join(sizes, "hub"), "members")
    blocks = lambda n, rows: F.greatest(F.lit(1), F.ceil(n / F.lit(block_hashes)), F.ceil(rows / F.lit(block_rows)))
    x_blocks, y_blocks = blocks(F.col("all") - F.col("top.n"), F.col("all_rows") - F.col("top.rows")), blocks(F.col("all"), F.col("all_rows"))
    of = lambda n: F.pmod(F.xxhash64("cls"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    xs = members.filter("label <> top.label").select("hub", of(x_blocks).alias("xb"), every(y_blocks).alias("yb"), F.lit(0).alias("role"), "cls", "label")
    ys = members.select("hub", every(x_blocks).alias("xb"), of(y_blocks).alias("yb"), F.lit(1).alias("role"), "cls", "label")
    return xs.union(ys).join(sets.select("cls", "hashes"), "cls")


def link_classes(sets: DataFrame, posts: DataFrame, t: int, percent: int, k: int, bits: int, block_rows: int, block_hashes: int) -> DataFrame:
    """(node, label) of every class that is linked with another."""
    links = confirmed(hub_pairs(posts), sets, t, percent)
    labels = cut(components(links), "labels")
    rows = unsettled(posts, labels)
    if rows.isEmpty():
        return labels
    more = confirmed(second_pairs(rows), sets, t, percent)
    if not more.isEmpty():
        links = links.union(more)
        labels = cut(components(links), "labels")
        rows = unsettled(posts, labels)
    last = cut(hub_blocks(sets, rows, block_rows, block_hashes).groupBy("hub", "xb", "yb").applyInArrow(scan_block(t, percent, k, bits), "a long, b long"), "links")
    return labels if last.isEmpty() else cut(components(links.union(last)), "labels")


def components_of_classes(docs: DataFrame, size: int, percent: int, k: int = K, bits: int = 64, block_rows: int = 512, block_hashes: int = 1 << 19) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and the classes with their components' first rows: d1, d2, n_shingles, first (no_id, doc_id, text_hash, d1, d2)."""
    t = least_collisions(k, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    signed = cut(rows.mapInArrow(signer(size, k, bits), SIGNED), "signatures")
    best = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")
    found = signed.filter("d1 is not null").groupBy("d1", "d2", "n_shingles").agg(F.min(best).alias("best"), F.first("sig").alias("sig"))
    classes = cut(found.withColumn("cls", F.monotonically_increasing_id()), "classes")  # written down, so that the numbers stay
    posts = cut(prefixes(classes, k, t), "postings")
    # full sets are made again for the classes that anyone may link with, each from one of its documents
    wanted = cut(posts.select("cls").distinct().join(classes.select("cls", "best.doc_id", "best.text_hash", "d1", "d2", "n_shingles", "sig"), "cls"), "wanted")
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])
    made = rows.join(wanted, same, "left_semi").select("text").mapInArrow(with_digest(size), "d1 long, d2 long, n_shingles long, hashes array<long>")
    sets = made.join(wanted.select("cls", "d1", "d2", "n_shingles", "sig"), ["d1", "d2", "n_shingles"])
    sets = cut(sets.select("cls", "hashes", "sig", "n_shingles").dropDuplicates(["cls"]), "sets")
    labels = link_classes(sets, posts, t, percent, k, bits, block_rows, block_hashes)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select("d1", "d2", "n_shingles", "best", F.coalesce("label", "cls").alias("label"))
    firsts = named.groupBy("label").agg(F.min(F.struct("best.no_id", "best.doc_id", "best.text_hash", "d1", "d2")).alias("first"))
    return signed, cut(named.join(firsts, "label").select("d1", "d2", "n_shingles", "first"), "components")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 85, k: int = K, bits: int = 64, block_rows: int = 512, block_hashes: int = 1 << 19
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Links join documents with 100 * intersection >= percent * union of their distinct ``size``-word
    shingles. Documents with null or empty texts or without words have no shingles, link with
    nothing and stay. Rows that repeat a doc_id keep rows of their own; those with equal sets share
    a component. Very long texts are taken whole. A null doc_id never names a component that has
    others. An empty table gives no rows. Other columns are not looked at. ``bits`` narrows the
    coordinates, for tests.
    """
    signed, named = components_of_classes(docs, size, percent, k, bits, block_rows, block_hashes)
    named = named.select("d1", "d2", "n_shingles", F.col("first.doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def with_digest(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s for s in (shingles(t, size) for t in batch.column("text").to_pylist()) if len(s)]
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "d1": pa.array([d for d, _ in digests], pa.int64()),
                    "d2": pa.array([d for _, d in digests], pa.int64()),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "hashes": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )

    return run


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, **options) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id; of rows that repeat that id the one whose hashes are least.

    Documents without words (null and empty texts) all stay. A null doc_id only stays if its
    component has no other. Of rows that repeat doc_id and text one stays. Extra columns may have any name.
    """
    signed, named = components_of_classes(docs, size, percent, **options)
    firsts = cut(named.select("first.doc_id", "first.text_hash").distinct(), "kept")
    names = {c: f"_d_{c}" for c in docs.columns}
    left = docs.withColumnsRenamed(names).withColumn("_text", F.col("_d_text").cast("string")).withColumn("_hash", F.xxhash64("_text"))
    match = lambda rows, i, h: rows[i].cast("long").eqNullSafe(firsts["doc_id"]) & (rows[h] == firsts["text_hash"])
    worded = left.filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    kept = worded.join(firsts, match(worded, "_d_doc_id", "_hash"), "left_semi")
    with_words = signed.filter("n_shingles > 0")
    if with_words.join(firsts, match(with_words, "doc_id", "text_hash"), "left_semi").count() > firsts.count():  # some rows repeat both doc_id and text
        once = Window.partitionBy("_d_doc_id", "_hash").orderBy(F.xxhash64(*names.values()))
        kept = kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    out = kept.unionByName(left.filter(F.coalesce(~F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))))
    return out.select(*[F.col(v).alias(k) for k, v in names.items()])
