"""Near-duplicates, paragraphs, URL classes, archives, language models: brute force on fixtures, and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import attention_lm, graph, near_dedup, ngram_quality, substring_dedup, url_filters, warc
from lodestone.llm.common import Scratch, marked

WORDS = [a + b for a in "ba co di fe gu ha jo ki lu me".split() for b in "nar pel quo rit sum tav wex yol zid".split()]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, digest string, component string, kept int")


def prose(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 5000 + k) for k in range(200)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        if w and i is not None:
            sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in root}, {i: len(s) for i, s in sets.items()}


def near_rows(seed=3, groups=6, size=12):
    rnd = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = prose(rnd, 80)
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(WORDS)
            rows.append((i := i + 1, " ".join(text)))
    return rows + [(i + k, " ".join(prose(rnd, 60))) for k in range(1, 30)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows() + [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  WORDS"), (905, "x " * 20_000)]
    wanted, sizes = brute_components(rows)
    got = near_dedup.near_duplicates(docs_of(spark, rows), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == wanted
    assert all(r.n_shingles == sizes.get(r.doc_id, 0) and r.kept == (r.doc_id == wanted[r.doc_id]) for r in got)


def test_near_duplicates_in_small_leaves_and_wide_clusters(spark, monkeypatch):
    rows = near_rows(5, 2, 60)
    wanted, _ = brute_components(rows)
    monkeypatch.setattr(near_dedup, "CLUSTER_DOCS", 20)
    leaf = near_dedup.leaves
    monkeypatch.setattr(near_dedup, "leaves", lambda reps, scratch: leaf(reps, scratch, 16))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows), Scratch(spark, "t")).collect()}
    assert sum(got[i] == wanted[i] for i in wanted) >= 0.97 * len(wanted)


def test_pairs_at_the_threshold_survive_eight_levels():
    rng = np.random.default_rng(6)
    signatures = {}
    for k in range(40):
        one = rng.integers(0, 2**16, near_dedup.TOKENS, dtype=np.uint16)
        other = one.copy()
        other[rng.choice(near_dedup.TOKENS, near_dedup.TOKENS // 4, replace=False)] += np.uint16(1)
        signatures[2 * k], signatures[2 * k + 1] = one.tobytes(), other.tobytes()
    open_rows = [(0, doc) for doc in signatures]
    for level in range(9):
        node, doc = (pa.array([r[k] for r in open_rows], pa.int64()) for k in (0, 1))
        batch = pa.RecordBatch.from_arrays([node, doc, pa.array([signatures[d] for _, d in open_rows], pa.binary())], names=["node", "doc", "signature"])
        rows = {(r["node"], r["doc"]) for part in near_dedup._children(level)(iter([batch])) for r in part.to_pylist()}
        open_rows = sorted((n, d) for n, d in rows if (n, d ^ 1) in rows)
    assert {d for _, d in open_rows} == set(signatures)


def test_all_documents_of_a_template_meet(spark):
    """Documents that share about nine tokens in ten: branching does not part them, so each two have to meet in some leaf."""
    rng = np.random.default_rng(7)
    template, docs = rng.integers(0, 2**16, near_dedup.TOKENS, dtype=np.uint16), []
    for k in range(120):
        own = template.copy()
        own[rng.random(near_dedup.TOKENS) < 0.1] = rng.integers(0, 2**16)
        docs.append((k, bytearray(own.tobytes())))
    rows = near_dedup.leaves(spark.createDataFrame(docs, "doc long, signature binary"), Scratch(spark, "t"), 16).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault(r.node, set()).add(r.doc)
    assert max(map(len, leaves.values())) <= 64
    assert len({(a, b) for docs in leaves.values() for a in docs for b in docs if a < b}) == 120 * 119 // 2


def test_documents_do_not_meet_by_chance_at_the_roots(spark):
    """Tokens of 16 bits are equal by chance among many documents; whole minwise values are not, and equal ones still meet."""
    rng = np.random.default_rng(9)
    docs = [(k, bytearray(rng.integers(0, 8, near_dedup.TOKENS, dtype=np.uint16).tobytes()), bytearray(rng.integers(0, 2**32, len(near_dedup.ROOT_AT), dtype=np.uint32).tobytes())) for k in range(200)]
    docs += [(1000 + k, docs[k][1], docs[k][2]) for k in range(3)]
    rows = near_dedup.leaves(spark.createDataFrame(docs, "doc long, signature binary, roots binary"), Scratch(spark, "t")).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault(r.node, set()).add(r.doc)
    assert {frozenset(x) for x in leaves.values()} == {frozenset((k, 1000 + k)) for k in range(3)}
    low = near_dedup.lowest(near_dedup.shingles(b"one two three four five six seven"))
    assert near_dedup.signature(low).tolist() == [int(x) >> 8 & 0xFFFF for x in low]
    assert near_dedup.roots(low).tolist() == [int(low[c]) >> 24 & 0xFFFFFFFF for c in near_dedup.ROOT_AT]


def test_marked_rows_hold_all_keys(spark):
    rows = spark.range(-20_000, 20_000).withColumn("t", F.lit("text"))
    keys = spark.range(-20_000, 20_000, 40)
    got = {r.id for r in marked(rows, keys.union(keys), "id").collect()}
    assert got >= {r.id for r in keys.collect()} and len(got) < 1200
    assert marked(rows, keys, "id").columns == rows.columns and not marked(rows, keys.limit(0), "id").count()


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c"), (None, "lone one"), (4, "a b c"), (3, "a B c"), (3, "other words here"), (9, "other words here")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, rows), Scratch(spark, "t")).collect()}
    assert got == {(None, 3, False), (None, None, True), (4, 3, False), (3, 3, True), (9, 3, False)}
    assert near_dedup.near_duplicates(docs_of(spark, []), Scratch(spark, "t")).count() == 0
    left = near_dedup.drop_near_duplicates(docs_of(spark, rows), Scratch(spark, "t"))
    assert left.columns == docs_of(spark, rows).columns and left.count() == 4


def test_texts_cut_together_are_cut_as_alone():
    """Cuts of many texts at once are those of each text by the definition, also where its words repeat without end."""
    rnd = random.Random(12)
    texts = [prose(rnd, n) for n in (0, 1, 4, 5, 25, 26, 27, 60, 300)] + [["a"] * 90, ["a", "b"] * 70, prose(rnd, 24) * 5, prose(rnd, 7) * 30 + prose(rnd, 40), []]
    texts += [[rnd.choice("abc"[:n]) for _ in range(200)] for n in (2, 3) for _ in range(5)]
    words = [substring_dedup.hashed(" ".join(t).encode()) for t in texts]
    wanted, before = [], 0
    for w in words:
        order, at = substring_dedup._rolled(w, 3).tolist(), set()
        for k in range(len(order) - substring_dedup.REACH + 1):
            window = order[k : k + substring_dedup.REACH]
            at.add(k + window.index(min(window)))
        at = sorted(at)
        at = [p for k, p in enumerate(at) if not k or order[p] != order[at[k - 1]]]
        ends = sorted({0, *at, len(w)})
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= substring_dedup.LEAST:
                rolled = substring_dedup._rolled(w, substring_dedup.SHINGLE)[a : b - substring_dedup.SHINGLE + 1]
                wanted.append((before + a, b - a, sorted(set(rolled.tolist()))))
        before += len(w)
    starts, lengths, sets = substring_dedup.paragraphs(np.concatenate(words), np.array([len(w) for w in words]))
    assert list(zip(starts.tolist(), lengths.tolist(), [x.tolist() for x in sets], strict=True)) == wanted


def test_every_long_repeat_is_found(spark):
    rnd = random.Random(8)
    passages = [prose(rnd, 52) for _ in range(6)]
    rows, has = [], {}
    for i in range(60):
        text = prose(rnd, rnd.randint(30, 200))
        if i % 3 == 0:
            p = rnd.randrange(6)
            at = rnd.randrange(len(text))
            text[at:at] = passages[p]
            has.setdefault(p, []).append(i)
        rows.append((i, " ".join(text)))
    rows += [(70, None), (71, "short"), (None, " ".join(passages[0]))]
    found = substring_dedup.spans(substring_dedup.repeated_paragraphs(docs_of(spark, rows), Scratch(spark, "t"))).collect()
    wanted = {i for ids in has.values() if len(ids) > 1 for i in ids}
    assert {r.doc_id for r in found} == wanted
    firsts = {min(ids) for ids in has.values() if len(ids) > 1}
    assert {r.doc_id for r in found if r.n_removed == 0} == firsts
    # The passage goes to both its ends, but for a few words where a paragraph that crosses its end is only similar.
    texts, covered = dict(rows), []
    for r in found:
        if r.n_removed:
            (p,) = [p for p, ids in has.items() if r.doc_id in ids]
            begin = " ".join(texts[r.doc_id].split()).find(" ".join(passages[p]))
            at = len(texts[r.doc_id][:begin].split())
            gone = {k for s in r.removed_spans for k in range(s.start, s.end)}
            covered.append(len(gone & set(range(at, at + 52))))
            assert len(gone) <= 58 and min(r.keep_doc_ids) == min(has[p])
    assert min(covered) >= 24 and sum(covered) >= 0.92 * 52 * len(covered)
    assert substring_dedup.repeated_paragraphs(docs_of(spark, []), Scratch(spark, "t")).count() == 0


def test_paragraphs_against_brute_force(spark):
    """All colliding pairs of paragraphs on exact Jaccard similarity: the clusters are their components, and nearly those of all pairs."""
    rnd = random.Random(21)
    base = [prose(rnd, 60) for _ in range(12)]
    rows = []
    for i in range(90):
        text = [w for k in rnd.sample(range(12), 2) for w in base[k]]
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [rows[3], rows[3], (200, "word " * 400), (201, "word " * 300), (202, ""), (203, None)]
    docs = docs_of(spark, rows).withColumns({"n": F.lit("clash"), "digest": F.lit(1), "doc": F.lit(2)})
    got = substring_dedup.repeated_paragraphs(docs, Scratch(spark, "t")).collect()
    units = []
    for i, text in sorted(set(rows), key=lambda r: r[0]):
        starts, _, sets = substring_dedup.paragraphs(substring_dedup.hashed((text or "").encode()))
        units += [(i, int(a), set(x.tolist())) for a, x in zip(starts, sets, strict=True)]
    bands = substring_dedup._bands([np.array(sorted(u[2]), np.uint64) for u in units])

    def removals(every: bool):
        root = list(range(len(units)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a in range(len(units)):
            for b in range(a):
                x, y = units[a][2], units[b][2]
                if 100 * len(x & y) >= 75 * len(x | y) and (every or (bands[a] == bands[b]).any()):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
        sizes = {}
        for k in range(len(units)):
            sizes.setdefault(find(k), []).append(k)
        return {(units[k][0], units[own[0]][:2]) for own in sizes.values() for k in own[1:]}

    found = {(r.doc_id, (r.keep_doc_id, r.keep_start)) for r in got if r.removed}
    gone = removals(True)
    assert found == removals(False) and len(found & gone) >= 0.97 * len(gone)


def test_removals_grow_to_the_end_of_very_long_repeats(spark):
    """One word said hundreds of times has one paragraph with a cut; the removal goes as far as the words agree, beyond any first look."""
    rnd = random.Random(30)
    head = prose(rnd, 40)
    same = ["tick"] * 700
    rows = [(1, [*prose(rnd, 30), *head, *same, "stop"]), (2, [*prose(rnd, 25), *head, *same, "end"]), (3, [*prose(rnd, 20), *head, *same[:300]])]
    found = {r.doc_id: r for r in substring_dedup.spans(substring_dedup.repeated_paragraphs(docs_of(spark, [(k, " ".join(w)) for k, w in rows]), Scratch(spark, "t"))).collect()}
    for doc, end in ((2, 25 + 40 + 700), (3, 20 + 40 + 300)):
        gone = {k for s in found[doc].removed_spans for k in range(s.start, s.end)}
        assert max(gone) == end - 1 and len(gone) >= end - {2: 25, 3: 20}[doc] - 8


def test_similar_paragraphs_of_a_large_cluster_meet(spark, monkeypatch):
    """Short texts of one template (similarity 0.5 and less) chain into one candidate cluster; two of each differ in their last word only."""
    rnd = random.Random(12)
    template, rows = prose(rnd, 15), []
    for k in range(200):
        own = prose(rnd, 4)
        rows += [(2 * k, " ".join([*template, *own, f"a{k}"])), (2 * k + 1, " ".join([*template, *own, f"b{k}"]))]
    monkeypatch.setattr(substring_dedup, "CLUSTER", 32)
    got = {r.doc_id: r.keep_doc_id for r in substring_dedup.repeated_paragraphs(docs_of(spark, rows), Scratch(spark, "t")).collect()}
    assert sum(got.get(2 * k + 1) == 2 * k for k in range(200)) >= 196


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]


def test_url_classes(spark):
    link = '<link rel="canonical" href="{}">'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://a.com/x", link.format("http://bad.net/p")), (2, "http://B.com/y?q", refresh.format("http://a.com/x/")), (3, "https://c.com/", None), (4, None, link.format("http://bad.net/z")),
        (5, "no scheme", ""), (6, "http://w.example.net/en/1", link.format("//d.com/1")), (7, "http://d.com/1", link.format("http://bad.net/q")), (8, "http://x.net", ""), (9, "http://X.NET/#f", ""), (None, "http://y.net/a", ""), (3, "http://z.net/", ""),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, verdict string")
    got = {(r.page_id, r.host): r for r in url_filters.judge(pages, RULES, Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    assert got[1, "a.com"].verdict == got[2, "b.com"].verdict == "block" and got[1, "a.com"].rule is None
    assert got[4, ""].verdict == "block" and got[5, ""].verdict == "allow" and got[5, ""].path == ""
    assert got[6, "w.example.net"].rule == "example.net/en/" and got[7, "d.com"].verdict == "allow"
    assert got[8, "x.net"].rule is None and got[9, "x.net"].rule == "net/" and got[None, "y.net"].verdict == "block"
    assert got[3, "c.com"].verdict == "allow" and got[3, "z.net"].verdict == "block"  # in no class, so each by its own URL
    assert url_filters.judge(pages.filter("false"), RULES, Scratch(spark, "t")).count() == 0


def test_relative_targets(spark):
    at = "http://A.com/x/y/page?q=1#f"
    forms = {
        "page2.html": "http://a.com/x/y/page2.html", "../z": "http://a.com/x/z", "../../../z/": "http://a.com/z/", "./": "http://a.com/x/y/", "..": "http://a.com/x/", "?id=1&amp;k=2": "http://a.com/x/y/page?id=1&k=2",
        "#top": "http://a.com/x/y/page?q=1#top", "/r/./s/../t?u=../v": "http://a.com/r/t?u=../v", "//b.com/c": "http://b.com/c", "https://c.com/?a=1&amp;b=2": "https://c.com/?a=1&b=2",
        "go?to=http://d.com/": "http://a.com/x/y/go?to=http://d.com/", "mailto:me@a.com": None,
    }
    tags = ('<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">')
    rows = [(t, at, tag.format(t)) for t in forms for tag in tags] + [("bare", "http://e.com", tags[0].format("bare")), ("none", "no scheme", tags[0].format("none"))]
    forms |= {"bare": "http://e.com/bare"}
    for r in spark.createDataFrame(rows, "target string, url string, html string").withColumn("found", url_filters.targets_of(F.col("url"), F.col("html"))).collect():
        if r.target != "none":
            assert r.found == ([forms[r.target]] if forms[r.target] else []), r.target
    pages = [(1, "http://f.com/d/a", tags[1].format("b?k=1&amp;l=2")), (2, "http://f.com/d/b?k=1&l=2", tags[0].format("http://bad.net/p")), (3, "no scheme", tags[0].format("none"))]
    got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, Scratch(spark, "t")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "allow"}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nx", "same"), (5, "http://b", "same"), (2, None, None), (3, "http://c", ""), (4, "http://d", "é" * 100_000), (None, "http://e", "same"), (5, "http://b", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    scratch = Scratch(spark, "t")
    path = scratch.path("w")
    warc.write(warc.plan_records(pages, scratch), path, max_bytes=1000)
    got = warc.load(spark, path).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.record_type): r for r in got}
    assert by[1, "revisit"].refers_to == 5 and by[1, "revisit"].payload is None and by[1, "revisit"].payload_bytes == 4
    assert bytes(by[5, "response"].payload) == b"same" and by[5, "response"].payload_digest == by[1, "revisit"].payload_digest == warc.base32(__import__("hashlib").sha1(b"same").digest())
    assert by[2, "revisit"].refers_to == 3 and bytes(by[3, "response"].payload) == b"" and by[4, "response"].payload_bytes == 200_000
    pushed = warc.load(spark, path, "none").filter("record_type = 'revisit' and page_id in (1, 4)")
    assert [r.page_id for r in pushed.collect()] == [1]
    empty = scratch.path("empty")
    warc.write(warc.plan_records(pages.filter("false"), scratch), empty)
    assert warc.load(spark, empty).count() == 0


ROW = {"page_id": 1, "record_type": "response", "target_uri": "u", "payload": b"abc", "payload_digest": "X", "payload_bytes": 3, "refers_to": None}


@pytest.mark.parametrize("pack", [bytes, warc.member, __import__("gzip").compress])
def test_warc_rejects_cut_archives(spark, tmp_path, pack):
    whole = pack(warc.record(ROW))
    (tmp_path / "a.warc").write_bytes(whole[: len(whole) - (12 if pack is not bytes else 6)])
    (tmp_path / "_manifest").write_text("a.warc")
    with pytest.raises(Exception, match="not whole"):
        warc.load(spark, str(tmp_path)).collect()
    (tmp_path / "a.warc").write_bytes(pack(b"WARC/1.1\r\nno colon\r\n\r\n"))
    with pytest.raises(Exception, match="malformed"):
        warc.load(spark, str(tmp_path)).collect()


def test_warc_records_follow_the_standard():
    """Fields that WARC/1.1 requires, HTTP blocks, and revisits that name their response."""
    import gzip
    import hashlib

    digest = warc.base32(hashlib.sha1(b"abc").digest())
    first = warc.record(ROW | {"payload_digest": digest}, "2024-01-02T03:04:05Z")
    again = warc.record(ROW | {"page_id": 0, "record_type": "revisit", "payload": None, "payload_digest": digest, "refers_to": 1})
    heads = []
    for data in (first, again):
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(fields) and head.startswith(b"WARC/1.1")
        assert rest.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(rest) - 4 and rest.startswith(b"HTTP/1.1 200 OK\r\n")
        heads.append(fields)
    assert heads[0]["WARC-Date"] == "2024-01-02T03:04:05Z" and heads[1]["WARC-Refers-To"] == heads[0]["WARC-Record-ID"] != heads[1]["WARC-Record-ID"] and "WARC-Profile" in heads[1]
    assert gzip.decompress(warc.member(first) + warc.member(again)) == first + again


def test_foreign_warc_archives(spark, tmp_path):
    """Archives made by hand, without manifest, page ids or extra fields: plain, by record and nested folders."""
    import gzip

    def made(kind, uri, block, content="application/http; msgtype=response"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{uri}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: {uri}\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n4;x=1\r\ndefg\r\n0\r\n\r\n"
    large = b"HTTP/1.1 200 OK\r\n\r\n" + np.random.default_rng(1).bytes(300_000)
    parts = [made("warcinfo", "info", b"software: x", "application/warc-fields"), made("response", "http://a", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"), made("response", "http://c", chunked), made("resource", "http://r", b"plain", "text/plain"), made("response", "http://l", large)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "two.warc").write_bytes(b"".join(parts))
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.load(spark, str(tmp_path)).collect()
    want = {"info": b"software: x", "http://a": b"body", "http://c": b"abcdefg", "http://r": b"plain", "http://l": large[19:]}
    assert len(got) == 10 and all(bytes(r.payload) == want[r.target_uri] and r.payload_bytes == len(want[r.target_uri]) and r.page_id is None for r in got)
    assert warc.load(spark, str(tmp_path / "two.warc")).filter("record_type = 'resource'").count() == 1
    for mode in ("none", "digest", "full"):
        pushed = warc.load(spark, str(tmp_path), mode).filter("target_uri in ('http://c', 'http://l') and record_type = 'response'").collect()
        assert sorted(r.target_uri for r in pushed) == ["http://c"] * 2 + ["http://l"] * 2
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert not list(reader.pushFilters([warc.In(("record_type",), (None,))])) and not reader._wanted({b"warc-type": b"response"})
    assert not list(reader.pushFilters([warc.IsNotNull(("record_type",))])) and reader.wanted[-1] == ("record_type", None)


def small_lm(texts, size=150):
    """An attention model and pair probabilities from texts; 1 begins and 2 ends."""
    pairs = {}
    for text in texts:
        for last, y in zip([1, *text], [*text, 2], strict=True):
            pairs[last, y] = pairs.get((last, y), 0) + 1
    counts = np.bincount([y for (_, y), n in pairs.items() for _ in range(n)], minlength=size).astype(float)
    classes = np.arange(size) % attention_lm.CLASSES
    sums = {}
    for (last, y), n in pairs.items():
        old = sums.get((last, classes[y]), (0, 0))
        sums[last, classes[y]] = old[0] + n, old[1] + 1
    model = attention_lm.Pairs(counts, classes, tuple(np.array(c) for c in zip(*((*k, *v) for k, v in sums.items()), strict=True)))
    return attention_lm.Attention(1, 2, classes, model.bias(counts)), model, pairs


def segments(texts):
    return [(np.empty(0, np.int64), np.append(t, 2)) for t in texts]


def test_attention_scores_every_token_once():
    rng = np.random.default_rng(2)
    texts = [rng.integers(3, 60, n) for n in (0, 1, 11, 12, 13, 100)]
    model, pairs, counts = small_lm(texts)
    for name, (weight, change) in model.train(iter(segments(texts))).items():
        model.p[name] += (change / np.maximum(weight, 1)[:, None]).astype(np.float32)
    for text, value in zip(texts, model.score(segments(texts)), strict=True):
        # Token by token, each with the window that ends at its half.
        seq = np.concatenate([[1] * (attention_lm.CONTEXT + 1), text, [2] * (attention_lm.STRIDE + 1)])
        total = 0.0
        for k in range(len(text) + 1):
            start = k - k % attention_lm.STRIDE
            window = seq[start : start + attention_lm.WINDOW].copy()
            later = attention_lm.CONTEXT + k - start + 1
            window[later:] = 5  # what comes after must not count
            h = model.hidden(window[None, :])[0][k - start][None, :]
            y = seq[attention_lm.CONTEXT + 1 + k]
            total += float(model.log_probs(h, seq[attention_lm.CONTEXT + k : attention_lm.CONTEXT + k + 1], np.array([y]))[0])
        assert abs(total - value) < 1e-3 * max(1, abs(value))
    # A segment with the ids before it scores as within its text.
    whole, cut = texts[-1], 5 * attention_lm.STRIDE
    apart = model.score([(np.empty(0, np.int64), whole[:cut]), (whole[:cut], np.append(whole[cut:], 2))])
    assert abs(apart.sum() - model.score(segments([whole]))[0]) < 1e-3
    # Both steps together sum to one over all ids.
    for last in (1, 7, 140):
        ids = np.arange(150)
        h = np.full((150, attention_lm.WIDTH), 0.3, np.float32)
        got = np.array([counts.get((last, y), 0) for y in ids])
        log = model.log_probs(h, np.full(150, last), ids) + pairs.log_probs(last << 16 | ids, got)
        by_class = np.zeros(attention_lm.CLASSES)
        np.add.at(by_class, model.classes, np.exp(pairs.log_probs(last << 16 | ids, got)))
        assert np.allclose(by_class, 1, atol=1e-4) and abs(np.exp(log).sum() - 1) < 1e-3


def test_attention_learns_the_end():
    """An end is as likely as it was counted: here after every id 9, and nowhere else."""
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(10, 60, 30), 9) for _ in range(200)]
    model, pairs, counts = small_lm(texts)
    for name, (weight, change) in model.train(iter(segments(texts))).items():
        model.p[name] += (change / np.maximum(weight, 1)[:, None]).astype(np.float32)
    end = lambda before: float(model.score([(before, np.array([2]))])[0] + pairs.log_probs(before[-1:] << 16 | 2, np.array([counts.get((before[-1], 2), 0)]))[0])
    assert end(texts[0]) > np.log(0.8) and end(texts[0][:-1]) < np.log(0.01)


def test_attention_trains_on_every_id(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(3, 60, n) for n in (0, 1, 12, 63, 64, 200)]
    model, _, _ = small_lm(texts)
    seen, gradients = [], model.gradients
    monkeypatch.setattr(model, "gradients", lambda x, y, keep: seen.append(y[keep]) or gradients(x, y, keep))
    model.train(iter(segments(texts)))
    assert np.array_equal(np.sort(np.concatenate(seen)), np.sort(np.concatenate([*texts, [2] * len(texts)])))


def test_gradients_are_of_the_loss_and_ids_are_read_once():
    """Runs hold each id once, and one block more for a text or a step, instead of every window's ids."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(3, 60, n) for n in (0, 1, 11, 12, 13, 100)]
    model, _, _ = small_lm(texts)
    model.p = {n: rng.normal(size=v.shape) * 0.3 for n, v in model.p.items()}
    steps = list(model.batches(iter(segments(texts)), 5))
    windows = sum(-(-(len(t) + 1) // attention_lm.STRIDE) for t in texts)
    assert sum(x.size for x, *_ in steps) <= attention_lm.STRIDE * (windows + len(texts) + len(steps)) < attention_lm.WINDOW * windows
    for x, y, keep, _ in steps:
        loss = lambda x=x, y=y, keep=keep: -model.log_probs(model.hidden(x)[0], x[attention_lm.CONTEXT :], y.ravel())[keep.ravel()].sum()
        for name, grad in model.gradients(x, y, keep).items():
            rows, g = grad if isinstance(grad, tuple) else (np.arange(len(grad)), grad)
            for r, c in zip(rng.integers(0, len(rows), 4), rng.integers(0, g.shape[1], 4), strict=True):
                values, old = [], model.p[name][rows[r], c]
                for step in (1e-5, -1e-5):
                    model.p[name][rows[r], c] = old + step
                    values.append(loss())
                model.p[name][rows[r], c] = old
                assert abs((values[0] - values[1]) / 2e-5 - g[r, c]) < 1e-4 * max(1, abs(g[r, c])), name


def test_blocks_hold_all_words_and_look_each_up_seldom(monkeypatch):
    rnd, looked = random.Random(12), []
    texts = [" ".join(prose(rnd, rnd.choice((0, 3, 40, 900)))) for _ in range(60)] + [None, "  a\tB  "]
    monkeypatch.setattr(attention_lm, "SEGMENT", 2000)
    monkeypatch.setattr(attention_lm, "BLOCK_BYTES", 20_000)

    class Counting(attention_lm._Numbered):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(attention_lm, "_Numbered", Counting)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shared = type("Shared", (), {"value": library.serialized_model_proto()})
    n = range(len(texts))
    rows = pa.RecordBatch.from_arrays([pa.array(n), pa.array(n), pa.array([k % 5 == 1 for k in n]), pa.array(texts)], names=["row", "doc_id", "held", "text"])
    got, chosen, counts = {}, {}, {}
    blocks = list(attention_lm._blocks(shared, 1, 2)(iter([rows])))
    for b in blocks:
        hashes = np.array(b.column("words")[0].as_py())
        at = attention_lm._split(np.frombuffer(b.column("at")[0].as_py(), "<u4"), b.column("word_counts")[0].as_py())
        wanted = [row % 3 == 0 for row in b.column("rows")[0].as_py()]
        some = iter(attention_lm._texts(b, 0, 2, wanted))
        for row, a, (_, ids), w in zip(b.column("rows")[0].as_py(), at, attention_lm._texts(b, 0, 2), wanted, strict=True):
            got.setdefault(row, []).extend(hashes[a].tolist())
            assert not w or np.array_equal(next(some)[1], ids)
        assert next(some, None) is None
        for key, m in zip(hashes.tolist(), b.column("word_train")[0].as_py(), strict=True):
            counts[key] = counts.get(key, 0) + m
    hashed = lambda w: int(np.array(xxhash.xxh64_intdigest(w), np.uint64).view(np.int64))
    wanted = {k: [hashed(w) for w in (t or "").encode().lower().split()] for k, t in enumerate(texts)}
    assert len(blocks) > 3 and got == wanted
    train = [w for k, t in wanted.items() if k % 5 != 1 for w in t]
    assert {k: m for k, m in counts.items() if m} == {w: train.count(w) for w in set(train)}
    assert len(looked) < sum(map(len, wanted.values())) / 2


def test_counts_by_parts_of_keys():
    """A block gets the counts of its lists in their order, from few packed rows instead of one for each entry."""
    rng, lists, total = np.random.default_rng(13), {}, ({}, {})
    for block in range(5):
        lists[block] = [(np.unique(rng.integers(low, high, 3000)), rng.integers(0, 3, 3000) << 33) for low, high in ((-(2**62), 2**62), (0, 5000))]
        lists[block] = [(keys, n[: len(keys)]) for keys, n in lists[block]]
        for kind, (keys, n) in enumerate(lists[block]):
            for key, m in zip(keys.tolist(), n.tolist(), strict=True):
                total[kind][key] = total[kind].get(key, 0) + m
    blocks = pa.RecordBatch.from_pydict({"block": list(lists)} | {c: [x[k][j].tolist() for x in lists.values()] for k, names in enumerate(attention_lm.LISTS) for j, c in enumerate(names)})
    dealt = pa.Table.from_batches(list(attention_lm._deal(3)(iter([blocks]))))
    assert dealt.num_rows == 5 * 2 * 3
    for kind in (0, 1):
        got, sums = {b: np.full(len(lists[b][kind][0]), -1) for b in lists}, {}
        for part in range(3):
            rows = dealt.filter(pa.compute.and_(pa.compute.equal(dealt["part"], part), pa.compute.equal(dealt["kind"], kind)))
            for r in attention_lm._count(rows).to_pylist():
                if r["block"] is None:
                    sums |= dict(zip(attention_lm._longs(r["keys"]).tolist(), attention_lm._longs(r["n"]).tolist(), strict=True))
                else:
                    got[r["block"]][attention_lm._by_part(lists[r["block"]][kind][0], 3)[part]] = attention_lm._longs(r["n"])
        assert sums == {k: n for k, n in total[kind].items() if n}
        assert all(got[b].tolist() == [total[kind][k] for k in lists[b][kind][0].tolist()] for b in lists)


def test_segments_cover_the_text(monkeypatch):
    text = " ".join(prose(random.Random(8), 400)).encode()
    assert list(attention_lm._segments(b"a bb c")) == [([b"a", b"bb", b"c"], True)]
    monkeypatch.setattr(attention_lm, "SEGMENT", 100)
    cut = list(attention_lm._segments(text))
    assert len(cut) > 5 and [w for words, _ in cut for w in words] == text.split() and [e for _, e in cut] == [False] * (len(cut) - 1) + [True]


def test_lm_scores_rows(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(prose(rnd, rnd.randint(0, 120)))) for i in range(60)] + [(200, None), (201, ""), (None, "banar")]
    held = F.col("doc_id") % 5 == 1
    got = attention_lm.score_texts(docs_of(spark, rows).withColumn("score", F.lit("clash")), held, public_tokenizers.path("piece_bpe_32k.model"), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    train = [(t or "").split() for i, t in rows if i is None or i % 5 != 1]
    counts = {}
    for w in (w for t in train for w in t):
        counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    texts = dict(rows)
    for r in got:
        words = (texts[r.doc_id] or "").split()
        p = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        assert r.n_tokens == len(words) + 1 and r.train_tokens == total and r.n_known == sum(w in counts for w in words) + 1
        assert abs(r.base_score - sum(p(counts.get(w, 0)) for w in words) - p(len(train))) < 1e-6
        assert r.score < 0 and r.held_out == (r.doc_id is not None and r.doc_id % 5 == 1)
    assert attention_lm.score_texts(docs_of(spark, []), held, public_tokenizers.path("piece_bpe_32k.model"), Scratch(spark, "t")).count() == 0


def test_ngram_probabilities_sum_to_one_and_judge(spark):
    rnd = random.Random(5)
    good = [(i, " ".join(prose(rnd, 60)), "en") for i in range(80)]
    bad = [(100 + i, " ".join("".join(rnd.choice("qxzjkv#$%") for _ in range(6)) for _ in range(40)), "en") for i in range(10)]
    docs = spark.createDataFrame([*good, *bad, (300, None, None), (301, "", "en"), (None, "banar", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in ngram_quality.judge(docs, labels, Scratch(spark, "t")).collect()}
    assert sum(got[i].kept for i, _, _ in good) >= 76 and not any(got[i].kept for i, _, _ in bad)
    assert got[300].kept and got[300].threshold is None
    nothing = ngram_quality.judge(docs, labels.filter("false"), Scratch(spark, "t")).collect()
    assert all(r.kept and r.perplexity == pytest.approx(ngram_quality.CHARACTERS) for r in nothing)



def test_kneser_ney_against_brute_force(spark):
    """Perplexities of two languages, one model each, by dictionaries and sums over whole alphabets."""
    rnd = random.Random(15)
    rows = [(i, " ".join(prose(rnd, 40)), "en" if i % 3 else "zh-Hans-CN") for i in range(90)] + [(200, "Banar 77 Q", "zh-Hans-TW")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = ngram_quality.ORDER
    model = {r.key: r.value for r in ngram_quality.model_tables(docs.filter("doc_id < 60").select("text", "lang"), Scratch(spark, "t")).collect()}

    def padded(text):
        return ["<"] * (n - 1) + list(" ".join(text.lower().split())) + [">"]

    def trained(texts):
        """For each order, discounted counts by context."""
        grams, out = {}, {}
        for text in texts:
            c = padded(text)
            for k in range(n - 1, len(c)):
                g = tuple(c[k - n + 1 : k + 1])
                grams[g] = grams.get(g, 0) + 1
        for order in range(n, 0, -1):
            kinds = [sum(v == k for v in grams.values()) for k in (1, 2, 3, 4)]
            d = [0.5, 0.75, 0.9]
            if kinds[0] and kinds[1]:
                y = kinds[0] / (kinds[0] + 2 * kinds[1])
                d = [min(max(k - (k + 1) * y * kinds[k] / kinds[k - 1] if kinds[k - 1] else k, 0.05), k - 0.05) for k in (1, 2, 3)]
            out[order] = ({}, {}, {})
            for g, v in grams.items():
                off = min(v, d[min(v, 3) - 1])
                out[order][0][g] = v - off
                out[order][1][g[:-1]] = out[order][1].get(g[:-1], 0) + v
                out[order][2][g[:-1]] = out[order][2].get(g[:-1], 0) + off
            lower = {}
            for g in grams:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            grams = lower
        return out

    def probability(model, window):
        p = 1 / ngram_quality.CHARACTERS
        for order in range(1, n + 1):
            values, totals, left = model[order]
            g = tuple(window[n - order :])
            if g[:-1] in totals:
                p = (values.get(g, 0) + left[g[:-1]] * p) / totals[g[:-1]]
        return p

    keys, values = __import__("pandas").Index(np.array(list(model))), np.array(list(model.values()))
    for lang in ("en", "zh-Hans-CN", "zh-Hans-TW"):
        plain = trained([t for i, t, own in rows if own == lang and i < 60])
        for text in ["", *(t for i, t, own in rows if own == lang and i >= 60)][:6]:
            got = ngram_quality.perplexities(ngram_quality.Grams([ngram_quality.characters(text, lang)]), keys, values, 1 / ngram_quality.CHARACTERS)[0]
            c = padded(text)
            logs = [np.log(probability(plain, c[k - n + 1 : k + 1])) for k in range(n - 1, len(c))]
            assert got == pytest.approx(np.exp(-np.mean(logs)), rel=1e-9)
        if lang != "zh-Hans-TW":
            # A language's characters, and the unseen ones that share what is left, sum to one.
            seen = sum(probability(plain, ["?"] * (n - 1) + [ch]) for (ch,) in plain[1][0])
            left = plain[1][2][()] / plain[1][1][()]
            assert seen + left * (1 - len(plain[1][0]) / ngram_quality.CHARACTERS) == pytest.approx(1)


def test_ngram_edges(spark):
    schema = "doc_id long, text string, lang string, quality int, block string"
    docs = spark.createDataFrame([(1, "banar " * 30_000, "en", 7, "x"), (1, "banar " * 30_000, "en", 7, "x"), (2, None, "en", 7, "x")], schema)
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    got = ngram_quality.judge(docs, labels, Scratch(spark, "t")).collect()
    assert len(got) == 3 and len({r.perplexity for r in got if r.doc_id == 1}) == 1
    assert ngram_quality.judge(docs.filter("false"), labels, Scratch(spark, "t")).count() == 0


def test_quality_does_not_depend_on_input_splits(spark, monkeypatch):
    """Scores are the same where the scoring job splits its input otherwise than the job that fetched the values; missing values are an error."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    held = {r.doc_id: r.perplexity for r in ngram_quality.judge(docs, labels, Scratch(spark, "t")).collect()}
    setting, plain = "spark.sql.files.maxPartitionBytes", ngram_quality._score
    before = spark.conf.get(setting)

    def other(*args):
        spark.conf.set(setting, "65536")
        return plain(*args)

    monkeypatch.setattr(ngram_quality, "_score", other)
    monkeypatch.setattr(ngram_quality, "ROWS", 100)
    try:
        got = {r.doc_id: r.perplexity for r in ngram_quality.judge(docs, labels, Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set(setting, before)
    assert len(set(held.values())) > 900 and got == pytest.approx(held)
    with pytest.raises(FileNotFoundError):
        ngram_quality._values_of("file:///tmp", "no-such-block")
