"""Substring dedup by MinHash banding of paragraphs.

Repeated passages stand anywhere in a text, so paragraphs are cut by content: a word position is a cut if the hash of the
three words from it is the smallest in a window of `REACH` positions. The paragraphs between cuts cover the text without
overlap. Any `REACH` neighbouring positions have a cut, and it depends on the words there alone, so copies of a passage are
cut alike inside it, even where their lines break elsewhere. Paragraphs of at least `LEAST` words are compared.

1. One pass over the texts writes, for each paragraph, the digest of its set of five-word shingles and `BANDS` bands of
   `ROWS` minwise values of that set. Four bands of two values collide with 96 % at a similarity of 0.75, 99.9 % at 0.9 and
   always for equal sets.
2. Paragraphs of equal sets are one class, by a map-side combined count of digests; whole copies end here.
3. Bands are joined by one shuffle; the digests of a band stream by in order, each linked to the first.
4. Colliding classes form candidate clusters by connected components. Their shingle sets are made again from the text of
   one paragraph each, and those that share a band are compared breadth-first on exact Jaccard similarity (`PERCENT`). A
   cluster of at most `CLUSTER` classes meets in one task. Of a larger one all classes of a band value meet, and a band
   value of very many classes is dealt into parts of which each two meet in a task of their own. The pairs that are compared
   are the same: all that collide.
5. Components of the confirmed links are the clusters: the paragraph of the smallest (doc_id, position) stays, the others
   are removals.
6. A removal grows over the words before and after it as far as they equal those around the paragraph that stays, up to
   the next repeated paragraph of its document. `AROUND` words on each side are compared first; where all are equal, rounds
   read twice as many again, of the few texts that are left. So a repeated passage is covered to both its ends.

Edge cases: null and short texts have no paragraphs; a text of fewer than `REACH` words is one. Rows without doc_id are
ignored, since a removal has to name its document; rows that repeat a doc_id count as one if they are equal, and otherwise
share its positions. Repeats inside one document count like those across documents. Other columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small, utf8_rows
from .graph import components
from .near_dedup import FACTORS, PERCENT, SHINGLE, _edges, confirmed, mixed

REACH, LEAST, AROUND = 24, 8, 32
#: A repeated run of fewer words is reported only where it is a whole text of at least WHOLE words.
RUN, WHOLE = 24, 12
BANDS, ROWS = 4, 2
#: Words of texts that are cut at once.
HELD = 1 << 18
#: Distinct sets of one candidate cluster or band value that are compared in one task.
CLUSTER = 2048
_rng = np.random.default_rng(31)
MINWISE = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(utf8: bytes) -> np.ndarray:
    words = utf8.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n if size else 0):
        out += words[k : k + size] * FACTORS[k]
    return mixed(out)


def cuts(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where paragraphs begin, and the ends of the texts. words: those of texts of these lengths, one after another."""
    ends = np.cumsum(lengths)
    order, end = _rolled(words, 3), np.repeat(ends, lengths)
    at = _lowest(order, np.arange(len(words) - REACH - 1) + REACH + 2 <= end[: -REACH - 1]) if len(words) >= REACH + 2 else ends[:0]
    # Of a text's cuts with the same words, as in a line said over and over, only the first counts.
    new = (order[at[1:]] != order[at[:-1]]) | (end[at[1:]] != end[at[:-1]])
    return np.unique(np.concatenate([[0], at[:1], at[1:][new], ends]))


def _lowest(order: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where the first smallest value of some window of REACH positions stands. inside: which windows lie in one text."""
    low, size = order, 1
    while 2 * size <= REACH:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - (REACH - size)], low[REACH - size :])
    windows = sliding_window_view(order, REACH)
    # Windows side by side with one smallest value share its place, so only the first of them is looked through.
    first = inside.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    at = starts + windows[starts].argmin(1)
    runs = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else starts
    if (starts + runs > at + 1).any():  # that value stands there again: windows past its first place have another
        starts = np.flatnonzero(inside)
        at = starts + windows[starts].argmin(1)
    return np.unique(at)


def _digest(shingle_set: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingle_set.tobytes())


def paragraphs(words: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, lengths and shingle sets of the paragraphs that are compared. words: those of one text, or of texts of these lengths."""
    at = cuts(words, np.array([len(words)]) if lengths is None else lengths)
    lengths = np.diff(at)
    keep = lengths >= LEAST
    starts, lengths = at[:-1][keep], lengths[keep]
    return starts, lengths, _sets(_rolled(words, SHINGLE), starts, lengths - SHINGLE + 1)


def _sets(rolled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each run of rolled. Runs of up to REACH values are sorted side by side, as rows of a table."""
    if not len(starts):
        return []
    columns = np.arange(REACH)
    table = rolled[np.minimum(starts[:, None] + columns, len(rolled) - 1)]
    table[columns >= counts[:, None]] = np.iinfo(np.uint64).max
    table.sort(axis=1)
    again = ((table[:, 1:] == table[:, :-1]) & (columns[1:] < counts[:, None])).any(1) | (counts > REACH)
    found = [row[:n] for row, n in zip(table, counts.tolist(), strict=True)]
    for k in np.flatnonzero(again).tolist():
        found[k] = np.unique(rolled[starts[k] : starts[k] + counts[k]])
    return found


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """Bands of sets, a row for each."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        joined = np.full(len(sets), b + 1, np.uint64)
        for k in range(ROWS):
            joined = mixed(joined ^ np.minimum.reduceat(flat * MINWISE[b * ROWS + k], starts)) * FACTORS[k]
        out[:, b] = joined
    return out


UNITS = "digest long, doc long, start int, n int, size int, b0 long, b1 long, b2 long, b3 long"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """UNITS of texts; of small ones many at once."""
    for batch in small(batches, 64):
        docs, texts, held = [], [], 0
        for doc, utf8 in zip(batch.column("doc").to_pylist(), utf8_rows(batch, "text"), strict=True):
            docs.append(doc)
            texts.append(hashed(utf8))
            held += len(texts[-1])
            if held >= HELD:
                yield _units_of(docs, texts)
                docs, texts, held = [], [], 0
        if held:
            yield _units_of(docs, texts)


def _units_of(docs: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
    counts = np.array([len(x) for x in texts])
    ends = np.cumsum(counts)
    starts, lengths, sets = paragraphs(np.concatenate(texts), counts)
    own = np.searchsorted(ends, starts, side="right")
    digest = np.array([_digest(x) for x in sets], np.uint64).view(np.int64)
    ints = (x.astype(np.int32) for x in (starts - (ends - counts)[own], lengths, counts[own]))
    bands = _bands(sets) if sets else np.empty((0, BANDS), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (digest, np.array(docs)[own], *ints, *bands.view(np.int64).T)], names=[c.split()[0] for c in UNITS.split(", ")])


def _link_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (band, digest) rows sorted by both: each digest of a band linked to the band's first."""
    last: tuple | None = None
    for batch in batches:
        band, digest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "digest"))
        if not len(band):
            continue
        new = np.concatenate([[last is None or last[0] != band[0]], band[1:] != band[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
        first = np.where(head >= 0, digest[head], last[1] if last else 0)
        last = band[-1], first[-1]
        linked = first != digest
        yield pa.RecordBatch.from_arrays([pa.array(digest[linked]), pa.array(first[linked])], names=["a", "b"])


MADE = "keys array<long>, digest long, doc long, start int, shingles binary, bands binary, before array<int>, after array<int>"


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document's wanted paragraphs: the shingle sets of those with keys, and the words around those at the edge of a repeat."""
    kinds = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    for batch in small(batches, 64):
        out: list[list] = []
        compared, rows = [], []
        for doc, wanted, utf8 in zip(batch.column("doc").to_pylist(), batch.column("wanted").to_pylist(), utf8_rows(batch, "text"), strict=True):
            words = hashed(utf8)
            rolled, short_words = _rolled(words, SHINGLE), words.astype(np.uint32).view(np.int32)
            for w in wanted:
                start, end = w["start"], w["start"] + w["n"]
                made = np.unique(rolled[start : max(start, end - SHINGLE + 1)])
                # Rows that share a doc_id may differ in text: only the paragraph of the digest counts.
                if len(made) and np.uint64(_digest(made)).view(np.int64) == w["digest"]:
                    none = short_words[:0]
                    short = (short_words[max(0, start - AROUND) : start][::-1] if w["left"] else none, short_words[end : end + AROUND] if w["right"] else none)
                    if w["keys"]:
                        compared.append(made)
                        rows.append(len(out))
                    out.append([w["keys"], w["digest"], doc, start, made.tobytes() if w["keys"] else None, None, *short])
        for row, bands in zip(rows, _bands(compared) if compared else (), strict=True):
            out[row][5] = bands.tobytes()
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MADE.split(", ")])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """digest, shingles and bands of each key with two rows or more, from rows sorted by key; a key may cross batches."""
    last, held = None, ([], [], [])
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        columns = [batch.column(c).to_pylist() for c in ("digest", "shingles", "bands")]
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        start = 0
        for end, key in zip(ends if batch.num_rows else (), keys[[0, *ends[:-1]]].tolist() if batch.num_rows else (), strict=True):
            if key != last:
                if len(held[0]) > 1:
                    yield held
                last, held = key, ([], [], [])
            for into, column in zip(held, columns, strict=True):
                into += column[start:end]
            start = end
    if len(held[0]) > 1:
        yield held


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for digests, shingles, bands in _met(batches):
        digest, sets = np.array(digests), [np.frombuffer(b, np.uint64) for b in shingles]
        bands = np.frombuffer(b"".join(bands), np.uint64).reshape(-1, BANDS)
        if len(sets) == 2:
            joined = np.concatenate(sets)
            joined.sort()
            both = np.count_nonzero(joined[1:] == joined[:-1])
            if 100 * both >= PERCENT * (len(joined) - both) and (bands[0] == bands[1]).any():
                out.append((digest[:1], digest[1:]))
        else:
            collide = lambda k, others, bands=bands: (bands[k] == bands[others]).any(axis=1)
            out += [(np.full(len(hit), digest[k]), digest[hit]) for k, hit in confirmed(sets, may_link=collide)]
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _keys_by_band(bands: DataFrame) -> DataFrame:
    """digest, keys of the groups in which it meets every other class that shares a band with it. bands: distinct (band, digest)."""
    parts = F.ceil(2 * F.col("m") / CLUSTER)
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", F.when(F.col("m") > CLUSTER, parts).otherwise(1).alias("parts"))
    own = F.pmod(F.xxhash64("digest"), F.col("parts"))
    # Each two parts make a group, which compares the pairs inside both as well.
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: (k != F.col("own")) | (F.col("parts") == 1))
    keys = F.transform(others, lambda k: F.xxhash64("band", F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    dealt = bands.join(sizes, "band").withColumn("own", own).select("digest", F.explode(keys).alias("key"))
    return dealt.groupBy("digest").agg(F.collect_set("key").alias("keys"))


def _agreed(own: str, other: str):
    """In how many words two runs agree from their beginning."""
    differ = F.array_position(F.zip_with(own, other, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(differ > 0, differ - 1).otherwise(F.size(own)).cast("int")


def _with_gaps(placed: DataFrame, counts) -> DataFrame:
    """left and right: the words between a paragraph and those around it in its document that count, or the text's ends."""
    order = Window.partitionBy("doc").orderBy("start", "digest")
    before = F.last(F.when(counts, F.col("start") + F.col("n")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(counts, F.col("start")), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    gap = lambda x: F.greatest(x, F.lit(0))
    return placed.withColumns({"left": gap(F.col("start") - F.coalesce(before, F.lit(0))), "right": gap(F.coalesce(after, F.col("size")) - F.col("start") - F.col("n"))})


def _stretches(first: int, size: int):
    """Of a document's wanted edges, the words `first` to `first` + `size` outwards from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            out: list[tuple] = []
            for doc, wanted, utf8 in zip(batch.column("doc").to_pylist(), batch.column("wanted").to_pylist(), utf8_rows(batch, "text"), strict=True):
                words = hashed(utf8).astype(np.uint32).view(np.int32)
                for w in wanted:
                    outwards = words[w["edge"] :] if w["after"] else words[: w["edge"]][::-1]
                    out.append((doc, w["edge"], w["after"], outwards[first : first + size]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int32())), strict=True)], names=["doc", "edge", "after", "words"])

    return run


def _grown_on(edges: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, start, after, more: how far a removal grows where the first `AROUND` words were all equal.

    edges: doc, start, n, keep, left, right, more_before, more_after. Each round reads the texts of those that are equal so far.
    """
    side = lambda after, gap, more: edges.filter((F.col(more) == AROUND) & (F.col(gap) > AROUND)).select(
        "doc", "start", F.lit(after).alias("after"), (F.col("start") + (F.col("n") if after else 0)).alias("edge"), F.col("keep.doc").alias("keep_doc"),
        (F.col("keep.start") + (F.col("keep.n") if after else 0)).alias("keep_edge"), F.col(gap).alias("gap"), F.col(more).alias("more"),
    )
    pending = scratch.cut(side(False, "left", "more_before").unionByName(side(True, "right", "more_after")), "pending")
    done, first, size = pending, AROUND, 2 * AROUND
    while pending.limit(1).count():
        asked = pending.select("doc", "edge", "after").unionByName(pending.select(F.col("keep_doc").alias("doc"), F.col("keep_edge").alias("edge"), "after")).distinct()
        wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("edge", "after")).alias("wanted"))
        read = texts.join(wanted, "doc").mapInArrow(_stretches(first, size), "doc long, edge int, after boolean, words array<int>").dropDuplicates(["doc", "edge", "after"])
        read = scratch.cut(read, "stretches")
        kept = read.select(F.col("doc").alias("keep_doc"), F.col("edge").alias("keep_edge"), "after", F.col("words").alias("kept_words"))
        met = pending.join(read, ["doc", "edge", "after"]).join(kept, ["keep_doc", "keep_edge", "after"]).withColumn("agreed", _agreed("words", "kept_words"))
        met = met.withColumn("more", F.least("gap", F.col("more") + F.col("agreed"))).select(*pending.columns, "agreed")
        met = scratch.cut(met, "grown")
        done = done.unionByName(met.drop("agreed"))
        pending = met.filter((F.col("agreed") == size) & (F.col("more") < F.col("gap"))).drop("agreed")
        first, size = first + size, 2 * size
    return done.groupBy("doc", "start", "after").agg(F.max("more").alias("more"))


def repeated_paragraphs(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_words, keep_doc_id, keep_start, removed and text_words of every repeated paragraph, grown to the ends of its repeat; positions in words."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    units = scratch.cut(texts.mapInArrow(_units, UNITS), "units")
    band_rows = units.select("digest", F.explode(F.array("b0", "b1", "b2", "b3")).alias("band")).distinct()
    wide = band_rows.select("band", "digest").repartition(tasks, "band").sortWithinPartitions("band", "digest")
    candidates = scratch.cut(wide.mapInArrow(_link_bands, "a long, b long").distinct(), "candidates")
    clusters = scratch.cut(components(candidates, scratch).select(F.col("node").alias("digest"), F.col("component").alias("gid")), "clusters")
    place = F.struct("doc", "start", "n")
    counted = units.groupBy("digest").agg(F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("copied"))
    classes = scratch.cut(counted.join(clusters, "digest", "left").filter("copied or gid is not null").select("digest", "copied", "first", "gid"), "classes")

    sizes = classes.filter("gid is not null").groupBy("gid").agg(F.count(F.lit(1)).alias("m")).select("gid", (F.col("m") > CLUSTER).alias("large"))
    sized = scratch.cut(classes.join(sizes, "gid").select("digest", "gid", "large"), "sized")
    keyed = sized.filter("not large").select("digest", F.array("gid").alias("keys"))
    if sized.filter("large").limit(1).count():
        large = units.join(sized.filter("large").select("digest"), "digest", "left_semi")
        keyed = keyed.unionByName(_keys_by_band(large.select("digest", F.explode(F.array("b0", "b1", "b2", "b3")).alias("band")).distinct()))

    # Where each document's paragraphs of such classes stand, and the gaps between those that have copies.
    inside = units.select("digest", "doc", "start", "n", "size").join(classes.select("digest", "first", "copied"), "digest").distinct()
    placed = scratch.cut(_with_gaps(inside.withColumn("is_first", F.struct("doc", "start", "n") == F.col("first")).drop("first"), F.col("copied")), "placed")
    asked = placed.filter("is_first or left > 0 or right > 0").join(keyed, "digest", "left").select(
        "doc", "start", "n", "digest", F.when(F.col("is_first"), F.col("keys")).alias("keys"), (F.col("is_first") | (F.col("left") > 0)).alias("left"), (F.col("is_first") | (F.col("right") > 0)).alias("right"),
    )
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "digest", "keys", "left", "right")).alias("wanted"))
    made = scratch.cut(texts.join(wanted, "doc").mapInArrow(_made, MADE), "made")
    sets = made.filter("shingles is not null").select(F.explode("keys").alias("key"), "digest", "shingles", "bands").distinct()
    links = scratch.cut(sets.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_confirm, "a long, b long"), "links")
    near = scratch.cut(components(links, scratch).select(F.col("node").alias("digest"), F.col("component").alias("root")), "near")

    rooted = classes.select("digest", "copied", "first").join(near, "digest", "left").filter("copied or root is not null").select("digest", F.coalesce("root", "digest").alias("root"), "first")
    rooted = scratch.cut(rooted, "rooted")
    kept = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    found = placed.drop("left", "right").join(rooted.join(kept, "root").select("digest", "keep"), "digest")
    found = scratch.cut(_with_gaps(found.withColumn("removed", F.struct("doc", "start", "n") != F.col("keep")), F.lit(True)), "found")
    around = made.select("doc", "start", "before", "after").dropDuplicates(["doc", "start"])
    kept_words = around.join(kept.select(F.col("keep.doc").alias("doc"), F.col("keep.start").alias("start")).distinct(), ["doc", "start"])
    kept_words = kept_words.select(F.struct("doc", "start").alias("at"), F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    edges = found.filter("removed and (left > 0 or right > 0)").join(around, ["doc", "start"]).withColumn("at", F.struct("keep.doc", "keep.start")).join(kept_words, "at")
    near_words = lambda gap, own, kept: F.least(gap, _agreed(own, kept))
    edges = edges.select("doc", "start", "n", "keep", "at", "left", "right", near_words("left", "before", "kept_before").alias("more_before"), near_words("right", "after", "kept_after").alias("more_after"))
    edges = scratch.cut(edges, "edges")
    further = scratch.cut(_grown_on(edges, texts, scratch), "further")
    for after, more in ((False, "more_before"), (True, "more_after")):
        longer = further.filter(F.col("after") == after).select("doc", "start", F.col("more").alias("longer"))
        edges = edges.join(longer, ["doc", "start"], "left").withColumn(more, F.coalesce("longer", more)).drop("longer")
    edges = edges.select("doc", "start", "at", "more_before", "more_after")
    # The paragraph that stays is repeated as far as the longest of its copies.
    sides = edges.unionByName(edges.withColumns({"doc": F.col("at.doc"), "start": F.col("at.start")}))
    grown = sides.groupBy("doc", "start").agg(F.max("more_before").alias("more_before"), F.max("more_after").alias("more_after"))
    out = found.join(grown, ["doc", "start"], "left")
    first, more = F.col("start") - F.coalesce("more_before", F.lit(0)), F.coalesce("more_before", F.lit(0)) + F.coalesce("more_after", F.lit(0))
    return out.select(
        F.col("doc").alias("doc_id"), first.cast("long").alias("start"), (F.col("n") + more).cast("long").alias("n_words"),
        F.col("keep.doc").alias("keep_doc_id"), F.col("keep.start").cast("long").alias("keep_start"), "removed", F.col("size").cast("long").alias("text_words"),
    )


def spans(paragraphs: DataFrame) -> DataFrame:
    """One row per document with repeats: spans to remove and all repeated spans as arrays of (start, end), and the documents that keep the removed ones."""
    both = F.struct(F.col("start"), (F.col("start") + F.col("n_words")).alias("end"))
    rows = paragraphs.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(both)).alias("repeated"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), both))).alias("gone"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("keep_doc_id")))).alias("keep_doc_ids"),
        F.max("text_words").alias("text_words"),
    )
    long = lambda s: (s["end"] - s["start"] >= RUN) | ((s["end"] - s["start"] >= WHOLE) & (s["end"] - s["start"] == F.col("text_words")))
    rows = rows.withColumn("repeated", F.filter(_merged(F.col("repeated")), long)).filter(F.size("repeated") > 0)
    rows = rows.withColumn("gone", F.filter(_merged(F.col("gone")), lambda g: F.exists("repeated", lambda r: (r["start"] <= g["start"]) & (g["end"] <= r["end"]))))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", words("repeated").alias("n_repeated"), words("gone").alias("n_removed"), F.col("gone").alias("removed_spans"), F.when(F.size("gone") > 0, F.col("keep_doc_ids")).otherwise(F.array().cast("array<long>")).alias("keep_doc_ids"))


def _merged(sorted_spans):
    """Sorted spans with overlapping and touching ones joined."""
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(sorted_spans, zero, step)
