"""Archives, whitening and Merkle manifests against plain versions, on odd tables and on the registered tables."""

import base64
import hashlib
import io
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from snapfold.llm import common, merkle, queries, warc, whitening

# --- archives

PAGES = "page_id long, url string, html string, text string, sha string"


def plain_archive(rows, least=0):
    """What op11 says of (page_id, url, html) rows."""
    firsts = {}
    for page, _, html in rows:
        if page is not None:
            firsts[html or ""] = min(page, firsts.get(html or "", page))
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        first = firsts.get(html or "")
        again = first is not None and page != first and len(data) >= least
        out.append((page, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def archived(spark, rows, **options):
    folder = warc.new_folder(spark)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)
    warc.write_bundles(df, folder, **options)
    return folder, warc.read_bundles(spark, folder)


def test_archive_of_odd_pages_and_random_access(spark):
    rows = [
        (5, "http://a.b/c?d=e%20f", "<p>x</p>"), (3, "http://a.b", "<p>x</p>"), (None, "http://n", "<p>x</p>"), (None, None, "only without ids"), (None, "u", "only without ids"), (9, "u", None), (8, "", ""),
        (3, "http://twice", "<p>x</p>"), (11, "line\r\nend: 1\r\n\r\n and €", "€\r\n\r\nWARC/1.1\r\n\r\n\U0001f600"), (2**60, "big", "y" * 3_000_000), (12, "u", "<p>x</p> "), (3, "u", "other text under that id"),
    ]
    folder, back = archived(spark, rows, frame=4096)
    got = back.collect()
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain_archive(rows)
    texts = defaultdict(set)
    for page, _, html in rows:
        texts[page].add(html or "")
    assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload).decode() in texts[r.page_id]) for r in got)
    index = warc.read_index(spark, folder).collect()
    assert len(index) == len(rows)
    wanted = spark.createDataFrame([(r.record_id,) for r in got if r.page_id in (11, 2**60)] + [("urn:page:.99:X",)], "record_id string")
    assert {r.page_id: bytes(r.payload).decode() for r in warc.fetch(spark, folder, wanted).collect()} == {11: rows[8][2], 2**60: rows[9][2]}
    least = warc.read_bundles(spark, archived(spark, rows, least=8)[0]).collect()
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in least), key=repr) == plain_archive(rows, 8)


def test_bundles_are_plain_zstandard_and_plain_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 700}</p>" * 20) for i in range(1000)]
    folder, back = archived(spark, rows, frame=10_000, bundle=20_000)
    paths = {r.bundle for r in warc.read_index(spark, folder).collect()}
    assert len(paths) > 4  # a bundle ends at its limit
    seen, frames = [], 0
    for path in paths:
        with open(path.removeprefix("file://"), "rb") as f:
            data = f.read()
        table = warc.read_seek_table(io.BytesIO(data), len(data))
        frames += len(table)
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as r:  # any reader skips the table
            whole = r.read()
        assert len(whole) == sum(t[2] for t in table)
        seen += [rec.headers["WARC-Record-ID"] for rec in warc.records_of(whole) if rec.headers["WARC-Type"] != "warcinfo"]
        for r in warc.read_index(spark, folder).where(F.col("bundle") == path).limit(3).collect():
            assert table[r.frame][:2] == (r.frame_start, r.frame_bytes)
            rec = next(warc.records_of(warc.frame_at(io.BytesIO(data), r.frame_start, r.frame_bytes)[r.start : r.start + r.bytes]))
            assert rec.headers["WARC-Record-ID"] == f"<{r.record_id}>"
    assert len(seen) == len(set(seen)) == 1000 and frames > len(paths) and back.count() == 1000


def test_archive_of_nothing_of_one_payload_and_of_lost_tasks(spark):
    assert archived(spark, [])[1].count() == 0
    kept = common.written()
    folder, back = archived(spark, [(i, "u", "same") for i in range(20_000)])
    kinds = {(r.record_type, r.refers_to): r["count"] for r in back.groupBy("record_type", "refers_to").count().collect()}
    assert kinds == {("response", None): 1, ("revisit", 0): 19_999}
    stray = warc.Bundle(f"{folder}/stray.warc.zst", 1000)  # of a task whose index never was
    stray.add(*warc.page_record("77", "u", b"stray", None, False, warc.now()))
    stray.close()
    assert back.count() == 20_000
    common.release(spark, keep=kept)  # what nobody needs goes, bundles too
    with pytest.raises(Exception):
        warc.read_bundles(spark, folder).count()


def test_damaged_payloads_are_refused():
    name, data = warc.page_record("1", "u", b"payload", None, False, "d")
    assert warc.as_row(next(warc.records_of(data)))[4] == b"payload"
    with pytest.raises(ValueError):
        warc.as_row(next(warc.records_of(data.replace(b"payload", b"payl0ad"))))


# --- whitening


def plain_whitening(vectors, k=32):
    X = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, S = len(X), X.sum(0)
    C = np.array([[float(x - s / n) for x, s in zip(row, S)] for row in X])
    e, U = np.linalg.eigh(C.T @ C / n)
    order = np.argsort(-e)[:k]
    return n, [sum((n * x - s) ** 2 for x, s in zip(row, S)) for row in X], (C @ U)[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def check_whitening(rows, vectors):
    n, deviation, white, explained = plain_whitening([v for _, v in vectors])
    k = len(explained)
    got = defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert len(rows) == k * len(vectors) and sorted(got) == sorted(i for i, _ in vectors)
    W = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i, _ in vectors])
    signs = np.sign((W * white).sum(0))
    assert np.abs(W - white * signs).max() < 1e-7
    for (i, _), d in zip(vectors, deviation):
        assert {(r.n, r.deviation) for r in got[i].values()} == {(n, d)}
    assert all(abs(got[vectors[0][0]][c + 1].explained / x - 1) < 1e-9 for c, x in enumerate(explained))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_of_the_whole_table(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check_whitening(queries.op12_whitening(spark, sf_dir).collect(), vectors)


def test_whitening_of_odd_rows_blocks_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=7).astype(np.float32)]) for i in range(300)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] + [0.0] * 6), (903, [float("inf")] * 7), (904, [3e9] * 7)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in good + bad], "vec_id long, embedding array<float>, component int, n int, v int").repartition(5)
    check_whitening(whitening.whiten(df, tile=3).collect(), good)
    # Blocks smaller than a batch, and tiles that do not divide the dimensions, change nothing.
    rows = df.where("vec_id < 900").select("embedding")
    values = lambda batch: whitening.scaled(whitening.matrix(batch.column(0), 7))
    a, b = (whitening.covariance(rows, values, "long", tile, block) for tile, block in ((2, 7), (50, 4096)))
    assert a.sums == b.sums and np.allclose(a.covariance, b.covariance, rtol=1e-13, atol=1e-9)


def test_whitening_without_variance_ragged_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])] * 3, schema)).collect()
    assert len(same) == 6 and {(r.whitened, r.identity_error, r.explained, r.deviation, r.n, r.vec_id) for r in same} == {(None, None, None, 0, 3, None)}
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0, 7.0]), (3, [4.0, 5.0])], schema)).collect()
    full = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 7.0]), (3, [4.0, 5.0])], schema)).collect()
    assert sorted(map(repr, ragged)) == sorted(map(repr, full))
    far = whitening.whiten(spark.createDataFrame([(i, [c]) for i, c in enumerate([-1.6e7, 0.0, 1.6e7, 1.0])], schema)).collect()
    assert {r.vec_id: r.deviation for r in far} == {0: None, 1: 64**2, 2: None, 3: (4 * 64 - 64) ** 2}  # no long holds the outer ones


def test_deviations_at_the_edge_of_a_long():
    moments = whitening.Moments(1, [0], np.zeros((1, 1)))
    edge = math.isqrt(2**63)
    assert whitening.deviations(np.array([[edge], [edge + 1], [5]]), moments) == [edge**2, None, 25]


# --- manifests


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, forged, changed):
    """rows: (doc_id, source, lang, n_chars, text). One tuple a row."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for r in rows:
        leaf = H("".join(map(enc, r)))
        trees[r[2]].append((r[0], leaf, H("".join(map(enc, (*r[:4], changed(r[4]))))) if forged(r[0]) else leaf))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def way(tree, i):
        for nodes in tree[:-1]:
            yield nodes[i // 8 * 8 : i // 8 * 8 + 8], i % 8
            i //= 8

    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    built = {g: levels([r[1] for r in trees[g]]) for g in order}
    top = levels([built[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (doc, leaf, other) in enumerate(trees[g]):
            beside, h = "", other
            for run, slot in [*way(built[g], i), *way(top, at)]:
                beside += "".join(run[:slot] + run[slot + 1 :])
                h = H("".join([*run[:slot], h, *run[slot + 1 :]]))
            out.append((doc, leaf, built[g][-1][0], top[-1][0], H(beside), h, h == top[-1][0]))
    return sorted(out, key=repr)


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def manifest_of(df):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = merkle.manifest(df, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, F.lit(False)), low)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def forged(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0


@pytest.mark.parametrize("langs", [1, 2, 9, 70])
def test_manifest_of_groups_of_all_sizes(spark, langs):
    rows = [(100 * g + i, None if i % 5 == 0 else "sé", f"l{g}" if g else None, None if i % 7 == 0 else i, f"Text {i} € OF {g}") for g in range(langs) for i in range((g * g) % 90 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    assert manifest_of(df) == plain_manifest(rows, forged, lowered)


def test_manifest_of_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "", "", 0, ""), (7, "s", "en", 3, "ABC"), (7, "s", "en", 3, "ABC"), (7, "s", "en", 3, "abc"), (2**60, "s", "en", 9, "X" * 300_000), (None, "s", "en", 1, "A"),
        (None, "s", "en", 1, "A"), (-5, "s", "en", 1, "A:1:-"), (8, "s", "€", 1, "\U0001f600"), (9, "s", "z", 1, None), (12, "s", "", 1, "lone"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest int, i int, tree int, n int, path int")
    assert manifest_of(df) == plain_manifest(rows, forged, lowered)
    assert manifest_of(df.limit(0)) == []
    one = df.where("doc_id = 8")
    assert manifest_of(one) == plain_manifest([rows[9]], forged, lowered)


def test_manifest_of_one_repeated_row(spark):
    rows = [(4, "s", "en", 1, "Same")] * 3000
    df = spark.range(3000).select(F.lit(4).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("Same").alias("text"))
    assert manifest_of(df) == plain_manifest(rows, forged, lowered)


def test_manifest_does_not_depend_on_partitions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()], forged, lowered)
    assert manifest_of(df.repartition(13)) == want
    assert sorted((tuple(r) for r in queries.op13_merkle(spark, sf_dir).collect()), key=repr) == want
