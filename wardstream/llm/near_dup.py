"""MinHash near-duplicates: a signature-coordinate inverted join, confirmed on full shingle sets.

Texts with the same shingle set are one class from the start. Each class is posted under the first
coordinates of its signature (prefix), and a pair is counted at the first of them only at which it
meets (skip), over all coordinates.

Pairs inside one posting list are never all emitted. First every class is compared with a small
class that it meets most often, some hundreds with one; what is confirmed is joined into components. Then lists
that hold more than one component are read again, and each class names the few likeliest partners
in other components that it meets; what is confirmed joins more. Last, all pairs across the
components left are candidates. Pairs within one component are reachable from each other already, so
nothing is lost but links that the smallest class id reachable doesn't depend on.

Agreement is counted twice: in the signature's coordinates, and for pairs that pass in a finer sketch
of 512 bins (the smallest shingle of each, one byte), whose bound follows from its own variance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import all_of, components, cut, few_rows, map_rows


@dataclass(frozen=True)
class Settings:
    """Link where 100 * intersection >= percent * union.

    A pair at 85 meets under none of 8 posted coordinates once in 4 million times, agrees in fewer
    than 17 of 32 coordinates once in 280,000 times, and falls below the bins' bound (4.5 standard
    deviations) about as often; only then a link may be missed. A pair at 80 meets under none once in
    400,000 times, and agrees in fewer than 15 once in 150,000. partners: how many likely
    partners a class names in a list before all pairs are looked at. block: about so many rows of a posting list make a block; a longer
    list is dealt over several, each pair of which meets once. around: about how many classes are compared with one
    at first. A list of ids of up to broadcast_rows rows is broadcast, a longer one joined by a shuffle.
    """

    percent: int = 85
    words: int = 5
    coords: int = 32
    least: int = 17
    posted: int = 8
    partners: int = 2
    block: int = 2048
    around: int = 500
    broadcast_rows: int = 1_000_000
    seed: int = 3


class WordHashes(dict):
    """64-bit hashes of words; forgets beyond a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        v = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return v


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words than width, the whole sequence is one shingle."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out))


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(s), 4096):
        np.minimum(least, ((s[None, k : k + 4096] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1), out=least)
    return least.astype(np.uint32).view(np.int32)


def binned(s: np.ndarray) -> bytes:
    """For each of 512 ranges of hashes a byte of the smallest one in it, not 0; 0 where there is none."""
    out = np.zeros(512, np.uint8)
    at = (s >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[first]] = np.maximum(1, s[first] & np.uint64(0xFF))
    return out.tobytes()


def sketches(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, sig, bins): size and 128-bit fingerprint of the full shingle set, and its sketches; null ones for empty sets."""
    rng = np.random.default_rng(s.seed)
    a, b = (rng.integers(0, 1 << 63, s.coords, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    hashes = []

    def rows(batch):
        if not hashes:
            hashes.append(WordHashes())
        n, f1, f2, sig, bins = [], [], [], [], []
        for t in batch.column(1).to_pylist():
            x = shingles(t, hashes[0], s.words)
            n.append(len(x))
            full = fingerprint(x) if len(x) else (None, None)
            f1.append(full[0])
            f2.append(full[1])
            sig.append(signature(x, a, b) if len(x) else None)
            bins.append(binned(x) if len(x) else None)
        return {"id": batch.column(0), "n": n, "f1": f1, "f2": f2, "sig": sig, "bins": bins}

    schema = StructType([StructField("id", docs.schema[id_col].dataType), *[StructField(c, LongType()) for c in ("n", "f1", "f2")], StructField("sig", ArrayType(IntegerType())), StructField("bins", BinaryType())])
    return map_rows(docs.select(id_col, text_col), rows, schema)


def fingerprint(x: np.ndarray) -> list[int]:
    """128 bits of a full shingle set, as two whole numbers."""
    return np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64).tolist()


def sets_of(docs: DataFrame, ids: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the documents named by (id, f1, f2); the ids go to the texts where they are few, else both are shuffled.

    Of an id with several texts the one with that fingerprint counts.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    named = texts.join(F.broadcast(ids) if few_rows(ids, s.broadcast_rows) else ids, "id").select("id", "t", "f1", "f2")
    hashes = []

    def rows(batch):
        if not hashes:
            hashes.append(WordHashes())
        out = []
        for t, *want in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            x = shingles(t, hashes[0], s.words)
            out.append(x.view(np.int64) if fingerprint(x) == want else None)
        return {"id": batch.column(0), "set": out}

    schema = StructType([StructField("id", texts.schema["id"].dataType), StructField("set", ArrayType(LongType()))])
    # repeated rows have equal sets
    return map_rows(named, rows, schema).where("set IS NOT NULL").groupBy("id").agg(F.max("set").alias("set"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are near enough."""
    pairs = cut(pairs)
    named = classes.select(F.col("rep").alias("id"), "f1", "f2").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    sets = sets_of(docs, named, s, id_col, text_col)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return cut(common.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * s.percent).select("a", "b"))


def hubs(posts: DataFrame, s: Settings) -> DataFrame:
    """(a, b): each class b with the class a that it is compared with first, of those that it meets the one it meets most often.

    That is the smallest of its list; of a list longer than s.around, the smallest of the class's part
    of the list, and for these the smallest of all: no class is compared with much more than s.around.
    Parts are powers of two by the class's hash, so that they are alike in lists of about the same classes.
    """
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / s.around)))).cast("long")
    lists = cut(posts.groupBy("list").agg(F.min("rep").alias("hub"), F.count("*").alias("n"), parts.alias("parts")).where("n > 1").drop("n"))
    met = posts.join(lists, "list").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(s.seed)), F.col("parts")))
    long = met.where("parts > 1")
    least = long.groupBy("list", "part").agg(F.min("rep").alias("least"))
    long = long.join(least, ["list", "part"]).withColumn("hub", F.when(F.col("rep") == F.col("least"), F.col("hub")).otherwise(F.col("least")))
    met = all_of([x.select("rep", "hub") for x in (met.where("parts = 1"), long)]).where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("rep").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("best"))
    return best.select(F.least(-F.col("best.hub"), "rep").alias("a"), F.greatest(-F.col("best.hub"), "rep").alias("b"))


def likely(i, j, n, bins, percent: int):
    """Which pairs reach the bound in bins, and how far: matches / bins in use, less 4.5 standard deviations of a pair at percent."""
    x, y = bins[i], bins[j]
    used = ((x | y) != 0).sum(1)
    share = ((x == y) & (x != 0)).sum(1) / used
    p = percent / 100
    union = np.maximum(used, (n[i] + n[j]) / (1 + p))
    return share, share >= p - 4.5 * np.sqrt(p * (1 - p) / used * (1 - used / union)) - 1e-9


def agreeing(rows: DataFrame, s: Settings, partners: int | None) -> DataFrame:
    """Likely pairs (a, b) of different components, from rows sorted by list and pair of blocks: all, or for each row its likeliest few."""

    def run(batches):
        import pyarrow as pa

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            cols = [t[c].to_numpy() for c in ("list", "low", "high", "coord", "rep", "comp", "own", "n")]
            cols.append(t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, s.coords))
            cols.append(np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(-1, 512))
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            # the last list may go on in the next batch
            new = (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1])
            end = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            rest = [x[end:] for x in cols]
            yield from told([x[:end] for x in cols])
        if rest is not None:
            yield from told(rest)

    def told(cols):
        import pyarrow as pa

        rep, found = cols[4], [np.empty((0, 3))]
        for i, j, share in pairs(cols):
            if partners is not None:
                # of each row only the best so far: both ends of a pair name each other
                both = np.concatenate([np.stack([i, j, share], 1), np.stack([j, i, share], 1)])
                found = [best(np.concatenate([*found, both]), partners)]
            elif len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])
        if len(f := found[0]):
            i, j = f[:, 0].astype(int), f[:, 1].astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j]), pa.array(f[:, 2])], names=["a", "b", "share"])

    def best(f, k):
        f = f[np.lexsort((f[:, 1], -f[:, 2], f[:, 0]))]
        start = np.flatnonzero(np.diff(f[:, 0], prepend=-1))
        rank = np.arange(len(f)) - np.repeat(start, np.diff(np.append(start, len(f))))
        return f[rank < k]

    def pairs(cols):
        lists, low, high, coord, rep, comp, own, n, sig, bins = cols
        at = np.arange(len(rep))
        for d in range(1, len(rep)):
            at = at[at + d < len(rep)]
            at = at[(lists[at] == lists[at + d]) & (low[at] == low[at + d]) & (high[at] == high[at + d])]
            if not len(at):
                break
            for k in range(0, len(at), 1 << 15):
                i = at[k : k + (1 << 15)]
                j = i + d
                ok = (comp[i] != comp[j]) & ((own[i] != own[j]) | (low[i] == high[i])) & (100 * np.minimum(n[i], n[j]) >= s.percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                same = sig[i] == sig[j]
                ok = (same.sum(1) >= s.least) & (same.argmax(1) == coord[i])
                i, j = i[ok], j[ok]
                if len(i):
                    share, ok = likely(i, j, n, bins, s.percent)
                    yield i[ok], j[ok], share[ok]

    if partners is None:
        return rows.mapInArrow(run, "a long, b long").distinct()
    # of what a class has named in all its lists, the likeliest
    best_of = Window.partitionBy("a").orderBy(F.desc("share"), "b")
    named = rows.mapInArrow(run, "a long, b long, share double").withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= partners + 1)
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(comp: DataFrame, sketch: DataFrame, s: Settings, partners: int | None = None) -> DataFrame:
    """Likely pairs across components (rep, comp) that meet in a posting list.

    Of a list longer than a block, the largest component and the rest are dealt into blocks of their own, a row into one.
    Each pair of blocks meets once, but for those of the largest component: no group holds more than two blocks.
    """
    posts = comp.join(sketch.select("rep", "p"), "rep").select("rep", "comp", F.explode("p").alias("p")).select("rep", "comp", "p.coord", "p.list")
    shares = posts.groupBy("list", "comp").agg(F.count("*").alias("n"))
    several = shares.groupBy("list").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / s.block).cast("int")
    several = cut(several.select("list", (F.col("n") <= s.block).alias("whole"), F.col("most.comp").alias("most"), blocks(F.col("most.n")).alias("first"), blocks(F.col("n") - F.col("most.n")).alias("others")))
    large, among = F.col("comp") == F.col("most"), lambda n: F.pmod(F.xxhash64("rep", F.lit(s.seed)), F.col(n)).cast("int")
    own = F.when(F.col("whole"), 0).when(large, among("first")).otherwise(F.col("first") + among("others"))
    last = F.col("first") + F.col("others") - 1
    meets = F.when(F.col("whole"), F.array(F.lit(0))).when(large, F.sequence("first", last)).otherwise(F.sequence(F.lit(0), last))
    dealt = posts.join(several, "list").withColumn("own", own).withColumn("other", F.explode(meets))
    dealt = dealt.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "coord", "rep", "comp", "own").join(sketch.select("rep", "n", "sig", "bins"), "rep")
    return agreeing(dealt.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high"), s, partners)


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, comp) after the components at the ends of links have been joined."""
    at = lambda side: comp.select(F.col("rep").alias(side), F.col("comp").alias(f"{side}_comp"))
    c = components(links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    return cut(comp.join(c.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of s.words words, A-Z lower-cased; null or empty
    texts have an empty set and are linked with nothing. component_id is the smallest id reachable
    over links; kept marks the rows that have it as their id. Ids are whole numbers; rows of a null
    id belong to no group (component_id null) and are kept, and so are all rows of an id that is
    kept: repeated rows count as one document. If their texts differ, that of the least fingerprint
    stands for the document, and n_shingles is each row's own. Texts count whole, however long; ties
    have no say, as only the smallest id counts. Other columns, whatever their names, are not read;
    the empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    rows = cut(sketches(docs, s, id_col, text_col))
    chosen = cut(rows.where("f1 IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("f")).select("id", "f.f1", "f.f2"))
    named = chosen.groupBy("f1", "f2").agg(F.min("id").alias("rep"))
    classes = rows.where("f1 IS NOT NULL AND id IS NOT NULL").groupBy("f1", "f2").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bins").alias("bins"))
    classes = cut(classes.join(named, ["f1", "f2"]).select("f1", "f2", "rep", "n", "sig", "bins"))
    sketch = classes.withColumn("p", F.transform(F.slice("sig", 1, s.posted), lambda v, c: F.struct(c.alias("coord"), F.xxhash64(c, v).alias("list"))))
    posts = sketch.select("rep", F.explode("p").alias("p")).select("rep", "p.coord", "p.list")
    alone = classes.select("rep", F.col("rep").alias("comp"))
    comp = joined(alone, confirmed(hubs(posts, s), classes, docs, s, id_col, text_col))
    comp = joined(comp, confirmed(across(comp, sketch, s, s.partners), classes, docs, s, id_col, text_col))
    comp = joined(comp, confirmed(across(comp, sketch, s), classes, docs, s, id_col, text_col))
    final = comp.select("rep", F.col("comp").alias("component_id"))
    of_class = cut(classes.select("f1", "f2", "rep").join(final, "rep").select("f1", "f2", "component_id"))
    # texts that were copied very often make a hot key: Spark's adaptive join splits it, as both sides are plain shuffles
    of_id = chosen.join(of_class, ["f1", "f2"]).select("id", "component_id")
    # ids without words have no class and are their own component
    return rows.select("id", "n").join(of_id, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id")).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns: one document of each group, the one with the smallest id.

    Rows of a null id, and of null or empty texts, belong to no group and stay; all rows of an id
    that stays do. The empty table stays empty.
    """
    gone = cut(near_duplicates(docs, s, id_col, text_col).where("NOT kept").select(id_col).distinct())
    return docs.join(F.broadcast(gone) if few_rows(gone, s.broadcast_rows) else gone, id_col, "left_anti")
