"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Each text becomes its set of hashed word shingles; the k smallest are its sketch.  Texts with equal sets form one
   class at once, so exact copies never meet in pairs.
2. Inverted lists of retained values: values held by one class only are useless; a class whose sketch has fewer
   shared values than any linked pair must overlap in is out; of the others only the rarest values are listed, as many
   as a linked pair cannot avoid sharing.  That keeps passages common to many texts out of the lists.
3. Linking, first by neighbours: in a few lists every class meets the one that follows it in random order (linear in
   the classes), and confirmed links make components, which merges large groups of near copies without their pairs.
   Then, across components only: short lists give their remaining pairs.  A long list of several components (texts that
   are mostly one passage) is entered only by classes of which a wider sketch shares enough values with other components
   of long lists: partners met in such a list are all among those.  They meet block by block as sets, and only what the
   wider sketch (the whole set, if it is small) passes becomes a row.
4. Pairs pass the union-sketch estimate and are confirmed by exact Jaccard on the full sets.

Overlap bound.  The k smallest of the union of two linked sets (Jaccard >= s) lie in the intersection with
probability s each; fewer than MIN_OVERLAP of 48 (mean 36, six deviations), or WIDE_OVERLAP of 256, has a probability
below 1e-8 a pair; where the union fits the sketch the bound is exact.  Nothing is capped: every list, class and pair within
the bounds is used.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import fresh, pick, quoted, remove, shared_dir, sliced
from .common import written as write_table

#: Tables written to a folder, until they are removed.
_names: dict[str, list[str]] = {}


def written(df: DataFrame, name: str, folder: str) -> DataFrame:
    _names.setdefault(folder, []).append(name)
    return write_table(df, name, folder)


WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
SKETCH = 48
MIN_OVERLAP = 18
#: The same bound for wider sketches: 256 values, mean 192, six deviations.
WIDE = 256
WIDE_OVERLAP = 150
#: A list longer than this admits only classes that pass the bound for wider sketches.
CROWDED = 64
#: Lists in which a class meets a neighbour, and rows of a list that are handled together.
NEIGHBOUR_LISTS = 6
CELL = 1024
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for and remembered up to a bound."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_hashes = WordHashes()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (ASCII case folded, ASCII white space between words);
    fewer words than a shingle make one shingle of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _hashes(words)
    if len(words) < size:
        return np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little")], np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j : n + j] * _MIX[j % 5]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


SKETCHED = "doc_id bigint, n bigint, digest binary, sketch array<bigint>"
_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """(doc_id, n, digest of the set, sketch) of (doc_id, text) rows; no digest for empty sets."""

    def run(batches):
        for part in sliced(batches):
            n, digest, sketch = [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                # Shifted into the signed range, in order: the smallest values stay the smallest.
                sketch.append((s[:k] ^ np.uint64(1 << 63)).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], schema=_SKETCHED)

    return docs.mapInArrow(run, SKETCHED)


def wider(batches):
    """(vid, text) to (vid, n, WIDE smallest shingles)."""
    for part in sliced(batches):
        sets = [shingles(t) for t in part.column(1).to_pylist()]
        h = pa.array([(s[:WIDE] ^ np.uint64(1 << 63)).view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), h], names=["vid", "n", "h"])


def digested(batches):
    """(text) to (digest of its set, text)."""
    for part in sliced(batches):
        sets = [_set_of(t or "") for t in part.column(0).to_pylist()]
        digests = pa.array([d if len(s) else None for s, d in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([digests, part.column(0)], names=["digest", "text"])


def least_overlap(n):
    return F.least(F.lit(MIN_OVERLAP), F.ceil(n * NUMERATOR / DENOMINATOR).cast("int"))


def several(rows: DataFrame) -> DataFrame:
    """(h, df) of the values of (h, root) rows that are found in more than one component."""
    counts = rows.groupBy("h").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return counts.where("lo <> hi").select("h", "df")


def similar_sizes(a, b):
    """Sizes that allow the similarity at all."""
    return (F.least(a, b) * DENOMINATOR) >= (F.greatest(a, b) * NUMERATOR)


def estimate_passes(a, b):
    """Of the k smallest of the union, enough lie in both sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return common >= F.least(F.lit(MIN_OVERLAP), F.ceil(F.size(union) * NUMERATOR / DENOMINATOR).cast("int"))


@lru_cache(maxsize=32)
def _set_of(text: str) -> tuple[np.ndarray, bytes]:
    s = shingles(text)
    return s, hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both) and both > 0


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose full sets are similar enough.  texts: (vid, text)."""
    a = texts.select(F.col("vid").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("vid").alias("b"), F.col("text").alias("b_text"))

    def run(batches):
        for part in sliced(batches):
            x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
            keep = pa.array([linked(_set_of(s)[0], _set_of(t)[0]) for s, t in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def neighbours(listed: DataFrame) -> DataFrame:
    """(a, b): in NEIGHBOUR_LISTS lists of each class (those of smallest seeded hash, so that like classes choose alike)
    the class that follows it in random order.  Linear in the classes, and a large group of like classes becomes one
    component of it; lists are dealt in cells of about CELL rows."""
    few = F.slice(F.array_sort(F.transform("vs", lambda x: F.struct(F.xxhash64(F.lit(3), x["h"]).alias("o"), x["h"].alias("h"), x["df"].alias("df")))), 1, NEIGHBOUR_LISTS)
    rows = listed.select("vid", "n", F.explode(few).alias("v")).select("vid", "n", "v.h", "v.df").withColumn("o", F.xxhash64("h", "vid"))
    rows = rows.withColumn("cell", F.pmod(F.shiftright("o", 7), F.ceil(F.col("df") / F.lit(float(CELL)))))
    w = Window.partitionBy("h", "cell").orderBy("o", "vid")
    rows = rows.withColumn("b", F.lead("vid").over(w)).withColumn("nb", F.lead("n").over(w))
    met = rows.where(F.col("b").isNotNull() & (F.col("b") != F.col("vid")) & similar_sizes(F.col("n"), F.col("nb")))
    return met.select(F.least("vid", "b").alias("a"), F.greatest("vid", "b").alias("b")).distinct()


def blocked(fit: DataFrame, wide: DataFrame) -> DataFrame:
    """(a, b): pairs of long lists across components that the wider sketch allows; one for each class and component.

    fit: (vid, n, vs, root); wide: (vid, n, h).  A list of several components is cut into blocks of about CELL classes;
    two blocks meet in one task, as sets, not as pairs, and what does not pass there is never a row.
    """
    rows = fit.select("vid", "n", "root", F.explode("vs").alias("v")).select("vid", "n", "root", F.col("v.h").alias("l"), "v.df")
    divided = rows.groupBy("l").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("l")
    rows = rows.join(divided, "l", "left_semi").withColumn("blocks", F.ceil(F.col("df") / F.lit(float(CELL))).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.join(wide.select("vid", "h"), "vid").select("l", "i", "j", "own", "vid", "n", "root", "h")

    def meet(table: pa.Table) -> pa.Table:
        vid, n, root = (table.column(c).to_numpy() for c in ("vid", "n", "root"))
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = table.column("h").combine_chunks()
        at = np.concatenate([[0], np.cumsum(np.diff(sets.offsets.to_numpy()))])
        flat = sets.flatten().to_numpy()
        owner = np.repeat(np.arange(len(vid)), np.diff(at))
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        ends, members = np.append(first[1:], len(flat)), owner[order]
        place = np.searchsorted(values, flat)
        a_out, b_out = [], []
        for x in range(len(vid)):
            if own[x] != i:
                continue
            lists = [members[first[k] : ends[k]] for k in place[at[x] : at[x + 1]]]
            common = np.bincount(np.concatenate(lists), minlength=len(vid))
            small, large = np.minimum(n, n[x]), np.maximum(n, n[x])
            exact = (large <= WIDE) & (DENOMINATOR * common >= NUMERATOR * (n + n[x] - common))
            likely = (large > WIDE) & (common >= WIDE_OVERLAP)
            ok = (root != root[x]) & (own == j) & (small * DENOMINATOR >= large * NUMERATOR) & (exact | likely)
            # One confirmed partner joins two components; unconfirmed ones all go on to the exact check.
            hit = np.flatnonzero(ok & exact)
            _, pick_one = np.unique(root[hit], return_index=True)
            for y in (*hit[pick_one], *np.flatnonzero(ok & likely)):
                a_out.append(min(vid[x], vid[y]))
                b_out.append(max(vid[x], vid[y]))
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return rows.groupBy("l", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(vid, root) for every vertex of the edges that is not its own root; the root is the smallest of its component.

    Each turn every vertex hooks to its smallest neighbour, chains are shortened by pointer jumping, and the edges are
    contracted; local minima alone survive a turn, so few turns are needed.  Every step is a written table.
    """
    roots, turn = None, 0
    edges = written(edges.where("a <> b"), f"{name}-edges-0", folder)
    while not edges.isEmpty():
        turn += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("p")).where("p < a")
        up = written(up.select(F.col("a").alias("v"), "p"), f"{name}-up-{turn}-0", folder)
        jump = 0
        while True:
            jump += 1
            over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = written(up.join(over, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), f"{name}-up-{turn}-{jump}", folder)
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.select("v", "p")
        if roots is None:
            roots = up
        else:
            on = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            roots = roots.join(on, "p", "left").select("v", F.coalesce("q", "p").alias("p")).union(up)
        for end in ("a", "b"):
            move = up.select(F.col("v").alias(end), F.col("p").alias("to"))
            edges = edges.join(move, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-{turn}", folder)
    if roots is None:
        return edges.select(F.col("a").alias("vid"), F.col("b").alias("root"))
    return written(roots.select(F.col("v").alias("vid"), F.col("p").alias("root")), f"{name}-roots", folder)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest) of every row and (digest, component_id, root) of every class; root names the component even
    where no row of it has an id.  What is made on the way is removed from the folder at the end."""
    folder = folder or shared_dir(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, text=text_col)
    sketched = written(sketches(texts), "sketched", folder)
    # Equal sets have equal sketches, so any row of the class brings it.
    classes = sketched.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = classes.withColumn("vid", F.monotonically_increasing_id())
    classes = written(classes.select("vid", "digest", "doc_id", "n", "sketch"), "classes", folder)

    values = classes.select("vid", "n", F.explode("sketch").alias("h"))
    shared = values.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    useful = values.join(shared, "h").groupBy("vid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("vs"))
    useful = useful.where(F.size("vs") >= least_overlap(F.col("n")))
    listed = useful.select("vid", "n", F.slice("vs", F.lit(1), F.size("vs") - least_overlap(F.col("n")) + 1).alias("vs"))
    listed = written(listed.withColumn("crowded", F.exists("vs", lambda x: x["df"] > CROWDED)), "listed", folder)
    kept = classes.join(listed.select("vid"), "vid", "left_semi")
    wanted = kept.select("vid", "doc_id", "digest")

    def same_set(batches):  # an id may come with several texts: only that of the class's set goes on
        for part in sliced(batches):
            keep = [_set_of(t or "")[1] == d for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield part.select(["vid", "text"]).filter(pa.array(keep, pa.bool_()))

    # Where an id has one row, that is the class's; only the texts of repeated ids are looked at and told apart.
    repeated = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    repeated = written(repeated, "repeated", folder)
    bodies = texts.join(wanted, "doc_id")
    if repeated.isEmpty():
        bodies = bodies.select("vid", "text")
    else:
        several_rows = bodies.join(repeated, "doc_id", "left_semi").select("vid", "text", "digest").mapInArrow(same_set, "vid bigint, text string")
        bodies = bodies.join(repeated, "doc_id", "left_anti").select("vid", "text").unionByName(several_rows.dropDuplicates(["vid"]))
    # Classes without any id find a text by its digest.
    bare = texts.where("doc_id is null").select("text").mapInArrow(digested, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))
    bodies = bodies.unionByName(bare.join(wanted.where("doc_id is null").select("vid", "digest"), "digest").select("vid", "text"))
    bodies = written(bodies, "texts", folder)
    marks = written(kept.select("vid", "sketch"), "marks", folder)

    def judged(pairs: DataFrame, name: str) -> DataFrame:
        a, b = marks.select(F.col("vid").alias("a"), F.col("sketch").alias("sa")), marks.select(F.col("vid").alias("b"), F.col("sketch").alias("sb"))
        likely = pairs.join(a, "a").join(b, "b").where(estimate_passes(F.col("sa"), F.col("sb"))).select("a", "b")
        return confirmed(written(likely, f"{name}-likely", folder), bodies)

    links = written(judged(neighbours(listed), "near"), "links-near", folder)
    roots = components(links, folder, "cc-near")
    rooted = lambda df: df.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    # Long lists (a passage in many texts) that still hold several components are entered only by classes that a wider
    # sketch allows a partner there: values found in several components count.  Lists of one component have no more to link.
    long = rooted(listed.where("crowded")).select("vid", "root", F.explode(F.filter("vs", lambda x: x["df"] > CROWDED)["h"]).alias("h"))
    long = written(long, "long", folder)
    wide = long.join(several(long), "h", "left_semi").select("vid").distinct().join(bodies, "vid").mapInArrow(wider, "vid bigint, n bigint, h array<bigint>")
    wide = written(wide, "wide", folder)
    bound = F.least(F.lit(WIDE_OVERLAP), F.ceil(F.col("n") * NUMERATOR / DENOMINATOR).cast("int"))
    # Dealt anew by class: files of the table may be packed unevenly, and each class makes up to WIDE rows.
    each = rooted(wide).repartition("vid").select("vid", "n", "root", F.explode("h").alias("h"))
    again = each.join(several(each), "h").groupBy("vid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("vs"))
    fit = again.where(F.size("vs") >= bound).select("vid", "n", F.slice("vs", F.lit(1), F.size("vs") - bound + 1).alias("vs"))
    fit = written(fit, "fit", folder)
    rest = rooted(listed).select("vid", "n", "root", F.explode(F.filter("vs", lambda x: x["df"] <= CROWDED)["h"]).alias("h"))
    rest = written(rest.join(several(rest), "h", "left_semi"), "rest", folder)
    x = rest.select("h", F.col("vid").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    y = rest.select("h", F.col("vid").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"))
    pairs = x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & similar_sizes(F.col("na"), F.col("nb"))).select("a", "b").distinct()
    found = judged(pairs, "calm").unionByName(judged(blocked(rooted(fit), wide), "long"))
    for end in ("a", "b"):
        found = found.join(roots.select(F.col("vid").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    links = found.select("a", "b").unionByName(roots.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    roots = components(links, folder, "cc-all")
    named = classes.select("digest", "doc_id", "vid").join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = written(named.join(least, "root").select("digest", "component_id", "root"), "components", folder)
    for name in _names.pop(folder, []):
        if name not in ("sketched", "components"):
            remove(docs.sparkSession, f"{folder}/{name}")
    return sketched.select("doc_id", "n", "digest"), out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one per input row.

    component_id is the smallest id reachable over links; texts without words are linked with nothing and keep
    themselves.  Repeated rows repeat the answer; a row with a null id takes its text's component and is not kept, unless
    the component has no id.  An empty table gives no rows; other columns are ignored.
    """
    rows, named = near_components(docs, id_col, text_col)
    out = rows.join(named, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: those without words, and of each component the one of smallest id.

    Where the smallest id occurs with several texts of the component, or repeats, each of its rows stays.  Rows without
    an id give way to any row with one; of a component without ids the texts of one set stay.
    """
    key, nulled = fresh(docs, "wf_kept_id"), F.col(quoted(id_col)).isNull()
    rows, named = near_components(docs, id_col, text_col)
    all_rows = rows.join(named, "digest", "left")
    kept = all_rows.where(F.col("doc_id").isNotNull() & (F.col("digest").isNull() | (F.col("doc_id") == F.col("component_id"))))
    kept = kept.select(F.col("doc_id").cast("string").alias(key)).distinct()
    with_id = docs.where(~nulled).withColumn(key, F.col(quoted(id_col)).cast("string")).join(kept, [key], "left_semi").drop(key)
    # Rows without an id are known by their set alone.
    at, names = docs.columns.index(text_col), [*docs.columns, key]

    def sets(batches):
        for part in sliced(batches):
            found = [_set_of(t or "") for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([d if len(s) else None for s, d in found], pa.binary())], names=names)

    bare = docs.where(nulled).mapInArrow(sets, StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    alone = named.where("component_id is null").groupBy("root").agg(F.min("digest").alias(key)).select(key)
    return with_id.unionByName(bare.where(F.col(key).isNull()).drop(key)).unionByName(bare.join(alone, [key], "left_semi").drop(key))
