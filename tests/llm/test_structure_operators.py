"""SimHash, Merkle manifest and periodic runs against plain versions."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import merkle, runs, simhash
from tessera.llm.contract import connected
from tessera.llm.queries import REGISTRY, with_planted_runs
from tests.llm.cases import PLAIN, TEXTS, documents

SPACE = b" \t\n\v\f\r"


def plain_components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


# Components


@pytest.mark.parametrize("seed", range(3))
def test_connected_equals_plain_union(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 3000 + i) for i in range(30)]
    got = {r.id: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components({i for link in links for i in link}, links)
    assert {i: got.get(i, i) for i in want} == want


def test_connected_of_nothing(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


# SimHash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_simhash(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    named = [(i, p) for i, p in prints if i is not None]
    links = [(i, j) for i, p in named for j, q in named if (p ^ q).bit_count() <= 2]
    label = plain_components({i for i, _ in named}, links)
    return sorted(((i, f"{p:016x}", label.get(i)) for i, p in prints), key=repr)


def simhash_rows(df):
    found = simhash.near_duplicates(df).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0"), "component_id"
    )
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_simhash_of_awkward_rows(spark):
    rows = TEXTS + [(20, PLAIN), (20, "alpha beta"), (21, "alpha beta"), (22, "Alpha  BETA")]
    assert simhash_rows(documents(spark, rows)) == plain_simhash(rows)
    assert simhash_rows(documents(spark, [])) == []


def test_simhash_query_equals_plain(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in REGISTRY["op11_simhash"](spark, sf_dir).collect()), key=repr)
    assert got == plain_simhash(rows)


def _near(rng, n, centres, flips):
    heads = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        value = rng.choice(heads)
        for _ in range(rng.randrange(flips + 1)):
            value ^= 1 << rng.randrange(64)
        out.add(value - (1 << 64) if value >> 63 else value)
    return sorted(out)


@pytest.mark.parametrize(("n", "centres", "flips"), [(400, 1, 4), (500, 40, 3), (300, 300, 0), (600, 2, 9)])
def test_probes_and_stars_lose_no_link(spark, n, centres, flips):
    prints = _near(random.Random(n), n, centres, flips)
    table = spark.createDataFrame([(p,) for p in prints], "print long")
    links = [tuple(r) for r in simhash.similar_pairs(table).collect()]
    words = np.array(prints, np.int64).view(np.uint64)
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= 2
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    want = [(prints[i], prints[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    assert plain_components(prints, links) == plain_components(prints, want)


def test_thresholds_use_up_the_units_and_avoid_common_values():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    masks = simhash.correlated_parts(500, np.zeros((64, 64)), 3)
    assert sum(masks) == 2**64 - 1
    masks = np.array(masks, np.uint64)
    common = np.unique(prints[:200] & masks[0])
    listed = [common, np.empty(0, np.uint64), np.empty(0, np.uint64)]
    counts = [np.full(len(common), 100.0), np.empty(0), np.empty(0)]
    got = simhash.Allocator(masks, listed, counts, 0.1).thresholds(prints)
    barred = np.isin(prints & masks[0], common)
    assert barred[:200].all() and (got[~barred] == 0).all()
    assert (got[barred, 0] == -1).all()
    assert ((got[barred, 1:] + 1).sum(axis=1) == 3).all()


def test_places_that_agree_share_a_part():
    rng = np.random.default_rng(2)
    half = rng.integers(0, 2, (2000, 32))
    bits = np.repeat(half, 2, axis=1).astype(float)
    masks = simhash.correlated_parts(2000, bits.T @ bits, 2)
    for mask in masks:
        places = {63 - k for k in range(64) if mask >> k & 1}
        assert all((place ^ 1) in places for place in places)


# Merkle manifest


def plain_field(value):
    if value is None:
        return b"-"
    data = str(value).encode()
    return str(len(data)).encode() + b":" + data


def plain_digest(*parts):
    return sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def plain_tree(digests, arity):
    """The root, and each leaf's siblings (before, after) level by level."""
    paths = [[] for _ in digests]
    owners = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, held = [], []
        for begin in range(0, len(digests), arity):
            run = digests[begin : begin + arity]
            for k in range(len(run)):
                for i in owners[begin + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(plain_digest(*run))
            held.append([i for own in owners[begin : begin + arity] for i in own])
        digests, owners = above, held
    return digests[0], paths


def plain_manifest(rows, arity):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], plain_digest(*[plain_field(v) for v in row])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for group in order:
        leaves = sorted(groups[group], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *plain_tree([h for _, h in leaves], arity)))
    root, above = plain_tree([t[1] for t in trees], arity)
    return root, [
        (i, leaf, subroot, path + above[k])
        for k, (leaves, subroot, paths) in enumerate(trees)
        for (i, leaf), path in zip(leaves, paths, strict=True)
    ]


def manifest_rows(spark, rows, arity):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree int, idx string") \
        if rows else spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.build_manifest(df, arity=arity)
    found = merkle.proofs(manifest).withColumn("end", merkle.as_hex(merkle.folded(F.col("leaf"), F.col("path")))).collect()
    return manifest.root, found


MIXED = [
    (i, f"s{i % 3}", lang, None if i % 5 == 0 else i, t, i, "x")
    for lang, n in (("de", 1), ("en", 13), ("é", 4), (None, 6), ("", 2), ("z", 8))
    for i, t in ((k, "text" * k if k % 4 else None) for k in range(n))
]
MIXED += [(3, "s", "en", 3, "same", 0, None)] * 3 + [(None, None, None, None, None, None, None)]


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("rows", [MIXED, MIXED[:1], MIXED[1:9]], ids=["groups", "one", "one group"])
def test_manifest_equals_plain_tree(spark, rows, arity):
    root, found = manifest_rows(spark, rows, arity)
    want_root, want = plain_manifest([r[:5] for r in rows], arity)
    assert root == want_root
    got = [
        (r.order, r.leaf.hex(), r.subroot.hex(), [(p.before.hex(), p.after.hex()) for p in r.path]) for r in found
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.end for r in found} == {root}


def test_manifest_of_nothing(spark):
    assert manifest_rows(spark, [], 2) == (None, [])


def test_a_changed_row_does_not_fold_to_the_root(spark, sf_dir):
    rows = REGISTRY["op12_merkle"](spark, sf_dir).collect()
    n_chars = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len({r.root for r in rows}) == 1
    for r in rows:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and n_chars[r.doc_id] is not None
        assert r.verified == (not tampered) == (r.folded_root == r.root)


# Periodic runs


def plain_runs(words):
    """Every stretch with its smallest period, tried one period at a time."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                length = j - i + p
                if length >= max(6, 4 * p) and (i, length) not in found:
                    found[i, length] = p
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in found)]


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_equal_plain_search(documents):
    assert runs.runs_of(documents) == [plain_runs(d) for d in documents]


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_runs_of_repeated_blocks(blocks):
    document = [w for block, times in blocks for w in block * times]
    assert runs.runs_of([document, document[::-1]]) == [plain_runs(document), plain_runs(document[::-1])]


def test_long_documents_of_one_word_and_of_one_line():
    line = list(range(12))
    assert runs.runs_of([[7] * 30_000, line * 2_500, list(range(30_000))]) == [
        [(0, 30_000, 1)], [(0, 30_000, 12)], [],
    ]
    often = [w for k in range(5_000) for w in (1, 2, 3, 4, 5, 6, 10 + k)]
    assert runs.runs_of([often]) == [[]]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(plain_collapsed(words, found))
    milli = best[1] and 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())


def test_run_query_equals_plain(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in REGISTRY["op13_runs"](spark, sf_dir).collect()}
    assert sum(r[1] for r in got.values()) > 10
    for r in rows:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)


def test_runs_of_awkward_rows(spark):
    rows = TEXTS + [(30, "a b " * 5), (30, "a b " * 5), (31, "x\ty\nx y\x0bx y\x0cx\ry z"), (32, "a b " * 7)]
    found = runs.find_runs(with_planted_runs(documents(spark, rows))).collect()
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=repr)
    want = []
    for i, t in rows:
        words = planted(i, t)
        one = plain_runs(words) if len(words) < 2_000 else runs.runs_of([_codes(words)])[0]
        want.append((i, one, b" ".join(plain_collapsed(words, one)).decode()))
    assert got == sorted(want, key=repr)
    assert runs.find_runs(documents(spark, [])).collect() == []


def _codes(words):
    numbers = {}
    return [numbers.setdefault(w, len(numbers)) for w in words]
