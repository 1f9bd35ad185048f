"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its distinct shingles of five words (ASCII letters lower-cased, words split at ASCII white
space), held as 64-bit hashes; with fewer words the whole sequence is its one shingle. Documents are linked when the
Jaccard similarity of their sets is at least `percent` / 100, and the result is the connected components of the links.

1. One pass over the texts gives, for each, the size and digest of its set and a signature of 128 minwise tokens. Equal
   sets become one class with the smallest doc_id as its representative; only representatives go on.
2. Chosen paths: `TREES` independent trees branch every representative by the tokens at coordinates that the node
   selects (`BRANCH` at the root, `BRANCH` / similarity on average below). At the roots a token counts with 48 bits, so
   that documents without a shingle in common don't meet by chance, however many there are. Nodes of one document end. Nodes of at most
   `LEAF` documents are leaves; larger ones branch again, level by level. A pair at the threshold shares two children a
   node on average, so that its branching does not die out: all trees miss it with a probability of 6e-8 where leaves
   hang at the root, 4e-6 one level below and less than 2e-5 at any depth, and still less above the threshold.
3. In a leaf all signatures are compared, exhaustively. Documents whose estimate comes within the slack of the threshold
   are joined to candidate clusters: a spanning tree of each leaf, then components over all leaves.
4. Links are confirmed on full sets, which are made again from the texts of candidates only. A cluster of at most
   `CLUSTER_DOCS` documents and `CLUSTER_SHINGLES` shingles meets in one task; a larger one is dealt into parts of half that
   size, and each two of its parts meet in a task, so that all its pairs are compared there as well. A task searches breadth-first: a document is compared with those
   that no link has reached yet, so a large group of near copies needs few comparisons and never all of its pairs.
5. Components of the confirmed links give component_id, the smallest doc_id reachable.

A node whose children would have as many pairs as itself (documents of a template, or near copies), or that stays large
after `DEPTH` levels, is compared exhaustively instead: it is dealt into parts, and each two of its parts make a leaf.

Edge cases: texts without words, and null texts, have an empty set, no link and keep themselves. Copies (equal sets) are
linked. Rows without doc_id take part as copies only: they get the component of their set if a row with an id has it, else null. Rows that
repeat a doc_id are one document: their sets are linked through it. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, marked, parted, small, utf8_rows
from .graph import components

SHINGLE = 5
PERCENT = 75
TOKENS = 128
TREES = 6
BRANCH = 2
LEAF = 2048
DEPTH = 16
#: Standard deviations of a signature's estimate below the threshold that still make a candidate.
SLACK = 4.0
#: What one task confirms at once.
CLUSTER_DOCS = 2048
CLUSTER_SHINGLES = 8_000_000

_rng = np.random.default_rng(20_240_601)
FACTORS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MINWISE = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Each tree and the coordinates that its root selects, side by side.
ROOT_TREE = np.repeat(np.arange(TREES, dtype=np.uint64), BRANCH)
ROOT_AT = np.concatenate([np.random.default_rng(t + 1).choice(TOKENS, BRANCH, replace=False) for t in range(TREES)])
SKETCHES = "doc_id long, n_shingles long, digest binary, signature binary, roots binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(utf8: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of n words; without words, none."""
    words = utf8.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = max(1, len(words) - n + 1)
    out = np.full(size, min(len(words), n), np.uint64)
    for k in range(min(n, len(words))):
        out += hashes[k : k + size] * FACTORS[k]
    return np.unique(mixed(out))


def lowest(shingle_set: np.ndarray) -> np.ndarray:
    """The smallest hash at each of the minwise coordinates."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingle_set), 2048):
        np.minimum(low, np.multiply.outer(MINWISE, shingle_set[k : k + 2048]).min(1), out=low)
    return low


def signature(low: np.ndarray) -> np.ndarray:
    """16 bits of each of the smallest hashes."""
    return (low >> np.uint64(8)).astype(np.uint16)


def roots(low: np.ndarray) -> np.ndarray:
    """32 more bits of the smallest hashes at the coordinates that the roots select."""
    return (low[ROOT_AT] >> np.uint64(24)).astype(np.uint32)


def _sketches(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, columns = [], ([], [], [])
            for utf8 in utf8_rows(batch, text_col):
                found = shingles(utf8)
                sizes.append(len(found))
                low = lowest(found)
                values = hashlib.blake2b(found.tobytes(), digest_size=16).digest(), signature(low).tobytes(), roots(low).tobytes()
                for column, value in zip(columns, values, strict=True):
                    column.append(value if len(found) else None)
            names = [c.split()[0] for c in SKETCHES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    return run


def _children(level: int):
    """(node, parent, doc) rows from rows of (node, doc, signature): a node's children, each named by node, coordinate and token.

    At the roots, where all documents are, the 16 bits of a token would meet by chance: rows with `roots` are named by 32 bits more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates = np.arange(TOKENS, dtype=np.uint64)
        for batch in small(batches, 4096):
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            tokens = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, TOKENS)
            if level:
                nodes = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
                drawn = mixed(mixed(nodes)[:, None] + coordinates[None, :] * np.uint64(0x9E3779B97F4A7C15))
                rows, at = np.nonzero(drawn < np.uint64(int(2**64 * BRANCH / (TOKENS * PERCENT / 100))))
                parents = nodes[rows]
            else:  # the roots: every document is in each tree
                rows = np.repeat(np.arange(len(docs)), len(ROOT_AT))
                at, parents = np.tile(ROOT_AT, len(docs)), np.tile(ROOT_TREE, len(docs))
            token = at.astype(np.uint64) * np.uint64(65_537) + tokens[rows, at] + np.uint64(1)
            if not level and "roots" in batch.schema.names:
                token += np.frombuffer(b"".join(batch.column("roots").to_pylist()), np.uint32).astype(np.uint64) << np.uint64(32)
            name = mixed(mixed(parents + np.uint64(level * 7 + 1)) ^ mixed(token))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(parents.view(np.int64)), pa.array(docs[rows])], names=["node", "parent", "doc"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted rows; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            if held and held[-1].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cat = lambda k: np.concatenate([p[k] for p in pairs] or [np.empty(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(cat(0), pa.int64()), pa.array(cat(1), pa.int64())], names=["a", "b"])


def reached(n: int, linked) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of n nodes, breadth-first: (node, those that it reaches first). linked(node, others) -> mask."""
    rest = np.arange(n)
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = linked(at, rest)
            if hit.any():
                yield at, rest[hit]
                front += rest[hit].tolist()
                rest = rest[~hit]


def _similar_in_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = PERCENT / 100
    least = (p - SLACK * (p * (1 - p) / TOKENS) ** 0.5) * TOKENS
    out: list = []
    for group in _groups(batches, "node"):
        docs, at = np.unique(group.column("doc").to_numpy(), return_index=True)
        if len(docs) > 1:
            tokens = np.frombuffer(b"".join(group.column("signature").take(pa.array(at)).to_pylist()), np.uint16).reshape(-1, TOKENS)
            alike = lambda k, others, tokens=tokens: (tokens[others] == tokens[k]).sum(1) >= least
            out += [(np.full(len(x), docs[k]), docs[x]) for k, x in reached(len(docs), alike)]
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def confirmed(sets: list[np.ndarray], percent: int = PERCENT, may_link=None) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links between full sets. may_link(set's number, others) can rule out pairs."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)

    def linked(k: int, others: np.ndarray) -> np.ndarray:
        near = 100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k])
        if may_link:
            near &= may_link(k, others)
        out = np.zeros(len(others), bool)
        tried = others[near]
        if len(tried):
            own = at[starts[k] : starts[k + 1]]
            mark[own] = True
            lengths = sizes[tried]
            ends = np.cumsum(lengths)
            flat = np.repeat(starts[tried] - (ends - lengths), lengths) + np.arange(ends[-1])
            both = np.add.reduceat(mark[at[flat]].astype(np.int64), ends - lengths)
            mark[own] = False
            out[near] = 100 * both >= percent * (sizes[k] + lengths - both)
        return out

    return reached(len(sets), linked)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list = []
    for group in _groups(batches, "gid"):
        docs = group.column("doc").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        if len(docs) > 1:
            out += [(np.full(len(x), docs[k]), docs[x]) for k, x in confirmed(sets)]
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 64):
        sets = [shingles(utf8).tobytes() for utf8 in utf8_rows(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("doc"), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["gid", "doc", "shingles"])


def _by(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key side by side in one task; keys here have bounded groups."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)


def _parts(kept: DataFrame, leaf: int) -> DataFrame:
    """(node, doc) rows of leaves in which all documents of a node meet. kept: (node, n, doc), n more than leaf."""
    parts = F.ceil(2 * F.col("n") / leaf)
    dealt = kept.select("node", "doc", parts.alias("parts"), F.pmod(F.xxhash64("doc"), parts).alias("own"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: k != F.col("own"))
    names = F.transform(others, lambda k: F.xxhash64("node", F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    return dealt.select(F.explode(names).alias("node"), "doc")


def leaves(reps: DataFrame, scratch: Scratch, leaf: int = LEAF) -> DataFrame:
    """(node, doc) rows of all leaves with two documents or more. reps: (doc, signature), with roots or without."""
    found, open_rows, spent, kept, large = [], reps, [], None, None
    for level in range(DEPTH + 1):
        rows = scratch.cut(open_rows.mapInArrow(_children(level), "node long, parent long, doc long"), f"level{level}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent")).filter("n > 1")
        sizes = scratch.cut(sizes, f"sizes{level}")
        spent += [rows, sizes]
        if level:
            # A token of the path may be selected again: such a child is its parent once more, and counts only if there is no other.
            both = sizes.select("parent", F.col("n").alias("m")).join(large.select(F.col("node").alias("parent"), "n"), "parent")
            work = both.groupBy("parent", "n").agg(F.sum(F.when(F.col("m") < F.col("n"), F.col("m").cast("double") * F.col("m"))).alias("work"))
            stuck = work.filter(F.coalesce("work", F.pow("n", F.lit(2))) >= F.pow("n", F.lit(2))).select(F.col("parent").alias("node"))
            stuck = scratch.cut(stuck, f"stuck{level}")
            spent.append(stuck)
            found.append(_parts(kept.join(stuck, "node", "left_semi"), leaf))
            sizes = sizes.join(stuck.select(F.col("node").alias("parent")), "parent", "left_anti")
        found.append(rows.join(sizes.filter(F.col("n") <= leaf), "node", "left_semi").select("node", "doc"))
        large = sizes.filter(F.col("n") > leaf).select("node", "n")
        if not large.limit(1).count():
            break
        kept = rows.join(large, "node").select("node", "n", "doc")
        if level == DEPTH:
            found.append(_parts(kept, leaf))
            break
        open_rows = kept.select("node", "doc").join(reps, "doc").select("node", "doc", "signature")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = scratch.cut(out, "leaves")
    for table in spent:
        scratch.drop(table)
    return out


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.cut(texts.mapInArrow(_sketches("text"), SKETCHES), "sketches")
    with_set = sketches.filter("digest is not null")
    classes = scratch.cut(with_set.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")).filter("rep is not null"), "classes")
    reps = with_set.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    reps = scratch.cut(reps.select(F.col("doc_id").alias("doc"), "signature", "roots"), "representatives")

    leaf_rows = leaves(reps, scratch)
    candidates = scratch.cut(_by(leaf_rows.join(reps, "doc").select("node", "doc", "signature"), "node").mapInArrow(_similar_in_leaf, "a long, b long"), "candidates")
    clusters = scratch.cut(components(candidates, scratch), "clusters")

    sized = clusters.join(classes.groupBy(F.col("rep").alias("node")).agg(F.sum("size").alias("size")), "node")
    load = F.greatest(F.count(F.lit(1)) / CLUSTER_DOCS, F.sum("size") / CLUSTER_SHINGLES)
    bounds = sized.groupBy("component").agg(F.when(load <= 1, 1).otherwise(F.ceil(2 * load)).cast("long").alias("parts"))
    dealt = clusters.join(scratch.cut(bounds, "bounds"), "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: (k != F.col("own")) | (F.col("parts") == 1))
    keys = F.transform(others, lambda k: F.xxhash64("component", F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    groups = dealt.select(F.explode(keys).alias("gid"), F.col("node").alias("doc"))

    # Of the texts, only those of candidates are shuffled, but for few more.
    near = marked(texts.select(F.col("doc_id").alias("doc"), "text"), clusters.select(F.col("node").alias("doc")), "doc")
    wanted = groups.join(near, "doc").select("gid", "doc", "text")
    links = _by(wanted.mapInArrow(_full_sets, "gid long, doc long, shingles binary"), "gid").mapInArrow(_confirm, "a long, b long")
    # Sets of one doc_id are linked through it.
    same = with_set.select("doc_id", "digest").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    repeated = with_set.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).filter("n > 1").select(F.col("doc_id").alias("a"))
    links = scratch.cut(links.unionByName(same.join(repeated, "a", "left_semi")), "links")
    found = scratch.cut(components(links, scratch), "components")

    rooted = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("root"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(rooted, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: one document of each component. Rows without doc_id all stay.

    Only rows that have the mark of one that goes are shuffled with their texts.
    """
    gone = near_duplicates(docs, scratch, id_col, text_col).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct()
    gone = scratch.cut(gone, "gone")
    hidden = docs.toDF(*(f"input{k}" for k in range(len(docs.columns))))
    near, far = parted(hidden.withColumn("gone", F.col(f"input{docs.columns.index(id_col)}").cast("long")), gone, "gone")
    left = near.join(gone, "gone", "left_anti").unionByName(far)
    return left.select(*(F.col(f"input{k}").alias(c) for k, c in enumerate(docs.columns)))
