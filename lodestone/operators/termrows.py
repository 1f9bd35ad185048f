"""Documents as rows of the terms that a batch of queries asks for, and the batch's scores of them, document by document.

One pass over the texts gives each document the numbers of its asked terms and of their five-character beginnings, with the
fields that have them. These rows are written once, are a small part of the texts, and are all that later steps read: document
frequencies are counts over them, and a document's scores for all queries are sums over its row, so (query, document, term) is
never a row and nothing about a pair is shuffled. With k, a task hands on the k best of each query.

What the batch asks for (at most `MOST` pairs of query and term) is broadcast. Scores are whole numbers of the last decimal, so
they are those of the decimals. Texts are folded on their bytes; the tokens are those of text.tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..sources.staging import written
from . import index as ix

#: Pairs of query and term that are broadcast.
MOST = 500_000
#: Bytes of text that are folded together, cells of documents and queries that are scored together, best rows a task holds.
BYTES, CELLS, HELD = 4 << 20, 1 << 18, 2_000_000
IN_BODY, IN_HEADING, IN_ALIAS = 1, 2, 4
#: Numbers of a list are kept as number * FLAGS + flags.
FLAGS = 8
SPACE = 32
NANO = 10**9


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte and a character above it become: itself, a space, or 0 where it goes."""
    ascii_ = np.full(256, SPACE, np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        ascii_[c] = c
    ascii_[128:] = 0
    plane = np.zeros(1 << 16, np.uint8)
    for c, left in zip(*t._folds(), strict=True):
        plane[ord(c)] = ascii_[ord(left)]
    return ascii_, plane


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, one after another, and where each begins (and the last one ends)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(column: pa.Array, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes of lower-case texts that each end with a space, and their tokens (of `least` characters): where they begin, lengths, and the text's number."""
    ascii_, plane = _tables()
    data, at = _bytes(column)
    out = ascii_[data]
    high = np.flatnonzero(data >= 0xC2)
    lead = data[high].astype(np.int64)
    second = data[np.minimum(high + 1, len(data) - 1)].astype(np.int64) & 63
    third = data[np.minimum(high + 2, len(data) - 1)].astype(np.int64) & 63
    code = np.where(lead < 0xE0, (lead & 31) << 6 | second, (lead & 15) << 12 | second << 6 | third)
    out[high] = np.where(lead < 0xF0, plane[code & 0xFFFF], 0)
    keep = out != 0
    text = out[keep]
    bounds = np.cumsum(np.add.reduceat(keep, at[:-1], dtype=np.int64)) if len(column) else at[:-1]
    edges = np.diff((text != SPACE).view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    number = np.repeat(np.arange(len(column)), np.diff(np.searchsorted(begin, bounds), prepend=0))
    long = end - begin >= least
    return text, begin[long], (end - begin)[long], number[long]


def _gathered(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at begin, one after another."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def _strings(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    data = text[_gathered(begin, length)]
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _keys(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first t.STEM bytes as one number."""
    out = np.zeros(len(begin), np.int64)
    for i in range(t.STEM):
        out |= np.where(length > i, text[np.minimum(begin + i, len(text) - 1)].astype(np.int64), 0) << 8 * (t.STEM - 1 - i)
    return out


def _found(values: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each value among the known ones, -1 where it is none."""
    return pc.index_in(values, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class Vocabulary:
    """Asked terms and their beginnings, by number."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        starts = sorted({x[: t.STEM] for x in self.terms})
        number = {s: k for k, s in enumerate(starts)}
        self.starts = starts
        self.start_of = np.array([number[x[: t.STEM]] for x in self.terms], np.int64)
        self.long = np.array([len(x) >= t.STEM for x in self.terms], bool)
        #: Tokens are plain letters and digits, so a beginning that is not has a number that no token has.
        self.keys = [int.from_bytes(s.encode().ljust(t.STEM, b"\0"), "big") if s.isascii() else -1 - k for k, s in enumerate(starts)]
        own = {x: k for k, x in enumerate(self.terms)}
        self.term_of = np.array([own.get(s, -1) for s in starts], np.int64)


def _csr(of: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each number below size: where its values begin, how many they are; and the values."""
    order = np.argsort(of, kind="stable")
    n = np.bincount(of, minlength=size)
    return np.cumsum(n) - n, n, values[order]


def _united(row: np.ndarray, number: np.ndarray, flags: np.ndarray, rows: int, size: int) -> pa.Array:
    """A list for each row of its numbers, ascending, each once with all its flags."""
    u = np.unique((row * size + number) * FLAGS + flags)
    key = u // FLAGS
    first = np.flatnonzero(np.diff(key, prepend=-1))
    flags = np.bitwise_or.reduceat(u % FLAGS, first) if len(first) else u
    row, number = np.divmod(key[first], max(size, 1))
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((number * FLAGS + flags).astype(np.int32)))


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows of about BYTES of text together."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _rows(shared, content: bool):
    """(doc_id, length, terms, starts) of (doc_id, body, heading), and alias if there is such a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Vocabulary = shared.value
        keys, terms = pa.array(words.keys, pa.int64()), pa.array([x.encode() for x in words.terms], pa.large_binary())
        stop = pa.array([w.encode() for w in t.STOPWORDS], pa.large_binary())
        for batch in _slices(batches, "body"):
            n = batch.num_rows
            found = []
            for column, flag in (("body", IN_BODY), ("heading", IN_HEADING), *([("alias", IN_ALIAS)] if "alias" in batch.schema.names else [])):
                text, begin, length, number = words_of(batch.column(column))
                if content and len(begin):
                    digits = np.add.reduceat((text[g := _gathered(begin, length)] <= 57) & (text[g] >= 48), np.cumsum(length) - length, dtype=np.int64)
                    kept = (_found(_strings(text, begin, length), stop) < 0) & (digits < length)
                    begin, length, number = begin[kept], length[kept], number[kept]
                if flag == IN_BODY:
                    sizes = np.bincount(number, minlength=n)
                start = _found(pa.array(_keys(text, begin, length)), keys)
                hit = start >= 0
                begin, length, number, start = begin[hit], length[hit], number[hit], start[hit]
                term = np.where(length <= t.STEM, words.term_of[start] if len(words.terms) else start, -1)
                more = length > t.STEM
                term[more] = _found(_strings(text, begin[more], length[more]), terms)
                found.append((number, start, term, np.full(len(number), flag)))
            number, start, term, flag = (np.concatenate(x) for x in zip(*found, strict=True))
            exact = term >= 0
            lists = _united(number[exact], term[exact], flag[exact], n, len(words.terms)), _united(number, start, flag, n, len(words.starts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *lists], names=["doc_id", "length", "terms", "starts"])

    return run


def _lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and flags of the items of a column of lists."""
    lists = batch.column(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), values // FLAGS, values % FLAGS


def _reunited(shared):
    """Rows whose lists have numbers several times, with each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Vocabulary = shared.value
        for batch in batches:
            lists = [_united(*_lists(batch, c), batch.num_rows, len(own)) for c, own in (("terms", words.terms), ("starts", words.starts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("length"), *lists], names=["doc_id", "length", "terms", "starts"])

    return run


def _counted(shared):
    """How many bodies of a task's rows have each term (kind 0) and beginning (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Vocabulary = shared.value
        sums = [np.zeros(len(own), np.int64) for own in (words.terms, words.starts)]
        for batch in batches:
            for into, column in zip(sums, ("terms", "starts"), strict=True):
                _, number, flags = _lists(batch, column)
                into += np.bincount(number[flags & IN_BODY > 0], minlength=len(into))
        for kind, own in enumerate(sums):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["kind", "number", "df"])

    return run


class Asked:
    """Which queries ask for which terms, by number; at most MOST pairs, distinct."""

    def __init__(self, words: Vocabulary, pairs: pa.Table, ids: pa.Array | None = None):
        """ids: all queries, where others than those of the pairs have a number too."""
        coded = pairs.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids = coded.dictionary if ids is None else ids
        query = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if ids is None else _found(pairs.column("query_id").combine_chunks(), ids)
        of = {x: k for k, x in enumerate(words.terms)}
        term = np.fromiter((of[x] for x in pairs.column("term").to_pylist()), np.int64, len(query))
        pair = np.unique(term * max(len(self.ids), 1) + query)
        term, query = np.divmod(pair, max(len(self.ids), 1))
        self.by_term = _csr(term, query, len(words.terms))
        #: Beginnings of three characters or more count as matched.
        start = words.start_of[term] if len(term) else term
        wide = np.array([len(s) >= 3 for s in words.starts], bool)
        pair = np.unique((start * max(len(self.ids), 1) + query)[wide[start]]) if len(term) else pair
        start, query = np.divmod(pair, max(len(self.ids), 1))
        self.by_start = _csr(start, query, len(words.starts))
        asked = np.flatnonzero(self.by_term[1])
        self.of_start = _csr(words.start_of[asked] if len(asked) else asked, asked, len(words.starts))

    def part(self, low: int, high: int) -> Asked:
        """The queries from low up to high."""
        out = object.__new__(Asked)
        out.ids, out.of_start = self.ids.slice(low, high - low), self.of_start
        for name in ("by_term", "by_start"):
            _, n, values = getattr(self, name)
            of, own = np.repeat(np.arange(len(n)), n), (values >= low) & (values < high)
            setattr(out, name, _csr(of[own], values[own] - low, len(n)))
        return out


def _spread(at: np.ndarray, csr: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The values of each number, one after another, and how many each has."""
    begin, n, values = csr
    return values[_gathered(begin[at], n[at])], n[at]


def _met(words: Vocabulary, asked: Asked, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, term and flags (by beginning, exactly) of the asked terms that begin as a word of a row; and row and number of its beginnings."""
    row, start, near = _lists(batch, "starts")
    term, n = _spread(start, asked.of_start)
    of, near = np.repeat(row, n), np.where(words.long[term] if len(term) else term > 0, np.repeat(near, n), 0)
    own, number, flags = _lists(batch, "terms")
    known = own * len(words.terms) + number
    exact = np.zeros(len(term), np.int64)
    if len(known):
        key = of * len(words.terms) + term
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        exact = np.where(known[at] == key, flags[at], 0)
    return of, term, near, exact, row, start


@cache
def factor_of(length: int, average: float) -> int:
    """The length factor with nine decimals, as a whole number."""
    x = max(0.65, min(1.25, 1.1 / (0.6 + 0.4 * length / average)))
    return int(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP).scaleb(9))


def scaled(whole: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """whole (nine decimals) times factor (nine decimals), rounded to six."""
    high, low = np.divmod(whole, 10**6)
    return (high * factor + low * factor // 10**6 + 500_000) // 10**6


def weights(words: Vocabulary, idf: np.ndarray, pidf: np.ndarray, w: tuple[float, float, float, float], cap: int) -> np.ndarray:
    """By term and 4 * exact + near: what its match gives, with nine decimals, as a whole number. w: exact and near in a body, in a heading."""
    tenths = [round(10 * x) for x in w]
    own, begun = np.minimum(idf, cap * NANO), np.minimum(pidf[words.start_of] if len(idf) else idf, cap * NANO)
    out = np.zeros((len(words.terms), 16), np.int64)
    for state in range(16):
        exact, near = state // 4, state % 4
        for flag, (whole, part) in ((IN_BODY, tenths[:2]), (IN_HEADING, tenths[2:])):
            out[:, state] += own * whole if exact & flag else begun * part if near & flag else 0
    return (out + 5) // 10


class _Best:
    """The k best of each query in a task: by score, then by id. Ids are whole numbers."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.size = k, [], 0
        self.bar, self.last = np.full(queries, -1), np.zeros(queries, np.int64)

    def add(self, row: np.ndarray, query: np.ndarray, ids: np.ndarray, values: list[np.ndarray]) -> None:
        """values: the score first."""
        doc, score = ids[row], values[0]
        bar = self.bar[query]
        good = (score > bar) | (score == bar) & (doc < self.last[query])
        if good.any():
            self.held.append([x[good] for x in (query, doc, *values)])
            self.size += int(good.sum())
        if self.size > max(4 * self.k * len(self.bar), 1 << 16):
            self.cut()

    def cut(self) -> list[np.ndarray]:
        rows = [np.concatenate(x) for x in zip(*self.held, strict=True)] if self.held else []
        if rows:
            order = np.lexsort((rows[1], -rows[2], rows[0]))
            query = rows[0][order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            rows = [x[order[place < self.k]] for x in rows]
            full = order[place == self.k - 1]
            whole = [np.concatenate(x)[full] for x in list(zip(*self.held, strict=True))[:3]]
            self.bar[whole[0]], self.last[whole[0]] = whole[2], whole[1]
            self.held, self.size = [rows], len(rows[0])
        return rows


def _decimals(x: np.ndarray) -> pa.Array:
    """Whole numbers of the sixth decimal as decimal(18,6)."""
    wide = np.empty((len(x), 2), np.int64)
    wide[:, 0], wide[:, 1] = x, x >> 63
    return pa.Array.from_buffers(pa.decimal128(18, 6), len(x), [None, pa.py_buffer(wide)])


def scoring(shared, score, least: int, k: int | None, extra: list[str]):
    """query_id, doc_id, score and extra columns of rows. score: (model, batch) to (row, query, score in the sixth decimal, *extra values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asked, model = shared.value
        width = max(1, CELLS // max(1, len(asked.ids)))
        best, kind = _Best(len(asked.ids), k) if k else None, pa.int64()

        def table(query, doc, value, *more):
            return pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), doc, _decimals(value), *(pa.array(x) for x in more)], names=["query_id", "doc_id", "score", *extra])

        for batch in batches:
            kind = batch.column("doc_id").type
            for a in range(0, batch.num_rows, width):
                part = batch.slice(a, width)
                row, query, *values = score(words, asked, model, part)
                good = values[0] >= least
                row, query, *values = (x[good] for x in (row, query, *values))
                if best:
                    best.add(row, query, part.column("doc_id").to_numpy(zero_copy_only=False), values)
                elif len(row):
                    yield table(query, part.column("doc_id").take(pa.array(row)), *values)
        if best and (rows := best.cut()):
            yield table(rows[0], pa.array(rows[1], kind), *rows[2:])

    return run


def field_sums(words: Vocabulary, asked: Asked, weight: np.ndarray, batch: pa.RecordBatch, fields: int = IN_BODY | IN_HEADING) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights (nine decimals) and numbers of beginnings that match in one of the fields, by cell (row * queries + query)."""
    n = len(asked.ids)
    of, term, near, exact, row, start = _met(words, asked, batch)
    query, times = _spread(term, asked.by_term)
    value = weight[term, exact % 4 * 4 + near % 4] if len(term) else term
    raw = np.bincount(np.repeat(of * n, times) + query, np.repeat(value, times), batch.num_rows * n)
    own = _lists(batch, "starts")[2] & fields > 0
    row, start = row[own], start[own]
    query, times = _spread(start, asked.by_start)
    return raw.astype(np.int64), np.bincount(np.repeat(row * n, times) + query, minlength=batch.num_rows * n)


def term_counts(words: Vocabulary, asked: Asked, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """By cell: terms that the body has, and terms that it has by their beginning alone."""
    n = len(asked.ids)
    of, term, near, exact, _, _ = _met(words, asked, batch)
    out = []
    for own in (exact & IN_BODY > 0, (exact & IN_BODY == 0) & (near & IN_BODY > 0)):
        query, times = _spread(term[own], asked.by_term)
        out.append(np.bincount(np.repeat(of[own] * n, times) + query, minlength=batch.num_rows * n))
    return out[0], out[1]


def taking_part(words: Vocabulary, asked: Asked, batch: pa.RecordBatch) -> np.ndarray:
    """Cells of documents that have one of the query's terms in body or aliases, or a beginning of one in the body."""
    n = len(asked.ids)
    of, term, near, exact, _, _ = _met(words, asked, batch)
    own = (exact & (IN_BODY | IN_ALIAS) > 0) | (near & IN_BODY > 0)
    query, times = _spread(term[own], asked.by_term)
    out = np.zeros(batch.num_rows * n, bool)
    out[np.repeat(of[own] * n, times) + query] = True
    return out


def phrases_in(shared):
    """doc_id, phrase, in_heading of (doc_id, body, heading), texts as in words_of: which phrases stand in the folded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "body"):
            rows: list[tuple[int, str, bool]] = []
            for column in ("body", "heading"):
                text, begin, length, number = words_of(batch.column(column), 1)
                if not len(begin):
                    continue
                ends = np.cumsum(length + 1)
                data = np.full(ends[-1], SPACE, np.uint8)
                data[_gathered(ends - length - 1, length)] = text[_gathered(begin, length)]
                last = np.flatnonzero(np.diff(number, append=-1))
                data[ends[last] - 1] = 10  # no phrase goes on in the next text
                whole, closes, owner = data.tobytes(), ends[last], number[last]
                for phrase in shared.value:
                    at = whole.find(wanted := phrase.encode())
                    while at >= 0:
                        k = int(np.searchsorted(closes, at, "right"))
                        rows.append((int(owner[k]), phrase, column == "heading"))
                        at = whole.find(wanted, int(closes[k]))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["doc_id", "phrase", "in_heading"])

    return run


def _lexical(words: Vocabulary, asked: Asked, model: tuple, batch: pa.RecordBatch):
    weight, average, per_stem, both = model
    raw, matched = field_sums(words, asked, weight, batch)
    factor = np.array([factor_of(x, average) for x in batch.column("length").to_pylist()], np.int64)
    cell = np.flatnonzero(raw)
    row, query = np.divmod(cell, max(len(asked.ids), 1))
    matched = matched[cell]
    return row, query, scaled(raw[cell] + (per_stem * matched + both * (matched >= 2)) * NANO, factor[row]), matched


def _legacy(words: Vocabulary, asked: Asked, model: None, batch: pa.RecordBatch):
    exact, near = term_counts(words, asked, batch)
    points = np.minimum(3 * exact, 18) + np.minimum(2 * near, 12)
    cell = np.flatnonzero(points)
    return *np.divmod(cell, max(len(asked.ids), 1)), points[cell] * 10**6


class TermRows:
    """Written rows (doc_id, length, terms, starts) of a corpus for a vocabulary, with n_docs, average (tokens of a body), idf and pidf."""

    def __init__(self, docs: DataFrame, terms: list[str], body: Column, heading: Column, content: bool = False, alias: Column | None = None):
        """docs: doc_id and what body, heading and alias read. Rows of one doc_id are one document."""
        self.spark = docs.sparkSession
        self.words = Vocabulary(terms)
        self.shared = self.spark.sparkContext.broadcast(self.words)
        closed = lambda c: F.concat(F.lower(t.text(c)), F.lit(" "))
        kind = docs.schema["doc_id"].dataType
        schema = T.StructType([T.StructField("doc_id", kind), T.StructField("length", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])
        rows = written(docs.select("doc_id", closed(body).alias("body"), closed(heading).alias("heading"), *([] if alias is None else [closed(alias).alias("alias")])).mapInArrow(_rows(self.shared, content), schema), "term-rows")
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average")).first()
        self.n_docs, self.average = max(1, stats["n"]), max(1.0, stats["average"])
        several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"))
        if several.limit(1).count():
            again = F.col("doc_id").eqNullSafe(F.col("id"))
            joined = lambda c: F.flatten(F.collect_list(c)).alias(c)
            united = rows.join(several, again, "left_semi").groupBy("doc_id").agg(F.max("length").alias("length"), joined("terms"), joined("starts"))
            rows = written(rows.join(several, again, "left_anti").unionByName(united.mapInArrow(_reunited(self.shared), schema)), "term-rows")
        self.rows = rows
        df = rows.select("terms", "starts").mapInArrow(_counted(self.shared), "kind int, number int, df long").groupBy("kind", "number").agg(F.sum("df").alias("df"))
        rare = df.select("kind", "number", (ix.idf(F.lit(self.n_docs), F.col("df")) * NANO).cast("long").alias("idf")).toArrow()
        self.idf, self.pidf = (np.full(len(own), NANO, np.int64) for own in (self.words.terms, self.words.starts))
        which, number, idf = (rare.column(c).to_numpy() for c in ("kind", "number", "idf"))
        self.idf[number[which == 0]], self.pidf[number[which == 1]] = idf[which == 0], idf[which == 1]

    def asked(self, pairs: pa.Table) -> Asked:
        return Asked(self.words, pairs)

    def scores(self, asked: Asked, query_type: T.DataType, score, model, least: int = 1, k: int | None = None, extra: list[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id, score and extra columns (long); with k at least the k best of each query, where ids are whole numbers."""
        rows = self.rows if rows is None else rows
        kind = rows.schema["doc_id"].dataType
        if not isinstance(kind, (T.LongType, T.IntegerType)) or rows.filter("doc_id is null").limit(1).count():
            k = None
        schema = T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", kind), T.StructField("score", T.DecimalType(18, 6)), *(T.StructField(c, T.LongType()) for c in extra or [])])
        many = max(1, HELD // k) if k else max(1, len(asked.ids))
        out = None
        for low in range(0, max(1, len(asked.ids)), many):
            own = asked if len(asked.ids) <= many else asked.part(low, low + many)
            part = rows.mapInArrow(scoring(self.spark.sparkContext.broadcast((self.words, own, model)), score, least, k, extra or []), schema)
            out = part if out is None else out.unionByName(part)
        return out


class Batch:
    """A batch of queries over a corpus: its term rows and its pairs of query and term."""

    def __init__(self, rows: TermRows, pairs: pa.Table, query_type: T.DataType):
        self.rows, self.query_type = rows, query_type
        self.asked = rows.asked(pairs)

    def lexical(self, w: tuple[float, float, float, float], cap: int, per_stem: int, both: int, least: int = 0, k: int | None = None) -> DataFrame:
        """query_id, doc_id, score, matched."""
        r = self.rows
        model = weights(r.words, r.idf, r.pidf, w, cap), r.average, per_stem, both
        return r.scores(self.asked, self.query_type, _lexical, model, least * 10**6, k, ["matched"])

    def legacy(self, k: int | None = None) -> DataFrame:
        """query_id, doc_id, score."""
        return self.rows.scores(self.asked, self.query_type, _legacy, None, 1, k)


def asked_pairs(asked: DataFrame) -> pa.Table | None:
    """The pairs of asked (query_id, term), or None where they are too many to broadcast."""
    pairs = asked.select("query_id", "term").distinct().limit(MOST + 1).toArrow()
    return None if pairs.num_rows > MOST else pairs
