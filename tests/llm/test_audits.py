"""Divergence audit, Merkle manifest and toxicity against brute force on rows with every oddity."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from urbanflow.llm import divergence, manifest, queries, toxicity

UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- divergence -----------------------------------------------------------------------------------


def audited(docs, least, top):
    """The audit by definition: every source's p of every kept term."""
    groups = collections.defaultdict(list)
    for r in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(UPPER))
        groups[r["lang"] or "", r["source"] or ""].append(terms)
    out = []
    for lang in {g[0] for g in groups}:
        own = {s: texts for (l, s), texts in groups.items() if l == lang}
        docs_with = collections.Counter(t for texts in own.values() for terms in texts for t in set(terms))
        kept = sorted(t for t, n in docs_with.items() if n >= least)

        def shares(texts):
            n = collections.Counter(t for terms in texts for t in terms)
            size = sum(n[t] for t in kept) + divergence.PRIOR * len(kept)
            return {t: 1 + 10 ** 9 * (n[t] + divergence.PRIOR) // size for t in kept}, n

        whole = shares(itertools.chain.from_iterable(own.values()))[0]
        p = {s: shares(texts) for s, texts in own.items()}
        for s in own:
            pair = [(sum(abs(p[s][0][t] - p[h][0][t]) for t in kept), h) for h in own if h != s]
            term = [(p[s][0][t] - whole[t], t) for t in kept if p[s][1][t] and p[s][0][t] > whole[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(found, 1)
                        if part == "pair" or n <= top]
    return sorted(out, key=repr)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("least", [1, 2, 4, 1000])
def test_audit_equals_definition(odd, least):
    found = divergence.audit(odd, least_docs=least, top=5, terms_at_once=50)
    assert found.columns == COLUMNS
    assert rows_of(found, *COLUMNS) == audited(odd.collect(), least, 5)


def test_audit_of_nothing(empty):
    assert divergence.audit(empty).collect() == []


def test_blocks_cut_between_terms(monkeypatch):
    text = "Aé bb-c " * 50 + "x" * 300 + " end"
    whole = [t for block in divergence.blocks(text) for t in block]
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 16)
    parts = list(divergence.blocks(text))
    assert len(parts) > 10 and [t for block in parts for t in block] == whole
    assert [t.decode() for t in whole[:3]] == ["aé", "bb", "c"] and list(divergence.blocks(None)) == []


def test_tree_counts_shared_beginnings_once():
    """Sums over the tree equal the sums over every row and pair of its steps."""
    rng = np.random.default_rng(5)
    paths = sorted({tuple((s, int(rng.integers(5, 8))) for s in sorted(rng.choice(6, rng.integers(1, 6), replace=False).tolist()))
                    for _ in range(200)})
    times = rng.integers(1, 9, len(paths))
    depth = max(map(len, paths))
    number, p, p0 = np.full((len(paths), depth), -1), np.zeros((len(paths), depth), int), np.zeros((len(paths), depth), int)
    for n, steps in enumerate(paths):
        for d, (s, v) in enumerate(steps):
            number[n, d], p[n, d], p0[n, d] = s, v, s
    sums = {}
    divergence._tree_sums(number, p, p0, times, sums)
    want = collections.Counter()
    for steps, n in zip(paths, times.tolist()):
        for (a, x), (b, y) in itertools.combinations(steps, 2):
            want[a, b] += n * (abs(x - y) - abs(x - b) - abs(a - y) + abs(a - b))
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in want.items() if v}


# ---- manifest -------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    def one(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"
    n = row["n_chars"]
    return h(*[one(v) for v in (row["doc_id"], row["source"], row["lang"], None if n is None else n + more, row["text"])])


def climbed(nodes):
    """Levels from the nodes up, and for each node its siblings with their side."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    paths = []
    for at in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            other = at ^ 1
            steps.append((other < at, level[other] if other < len(level) else None))
            at //= 2
        paths.append(steps)
    return levels[-1][0], paths


def manifested(docs):
    groups = collections.defaultdict(list)
    for r in docs:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    kept = {g: sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in order}
    below = {g: climbed([leaf(r) for r in rows]) for g, rows in kept.items()}
    root, above = climbed([below[g][0] for g in order])
    out = []
    for g, top in zip(order, above):
        for r, steps in zip(kept[g], below[g][1]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r, int(tampered))
            for left, other in steps + top:
                now = h(other, now) if left else h(now, other or "")
            proof = h(*[other for _, other in steps + top if other])
            out.append((r["doc_id"], leaf(r), below[g][0], root, proof, now, now == root))
    return sorted(out, key=repr)


RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def written(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_equals_definition(spark, odd, tmp_path, monkeypatch, height):
    monkeypatch.setattr(manifest, "manifest", functools.partial(manifest.manifest, height=height))
    found = queries.op12_manifest(spark, written(spark, tmp_path, odd))
    assert found.columns == RESULT
    want = manifested(odd.collect())
    assert rows_of(found, *RESULT) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_repeated_and_far_ids(spark, tmp_path):
    """A third of the rows share one id, ids are negative and far apart, and a group has one leaf."""
    rng = random.Random(3)
    ids = [7] * 40 + [rng.choice([-1, 1]) * rng.getrandbits(62) for _ in range(60)] + [-64, -63, -1, 0, 63, 64, 65, None, None]
    rows = [(i, f"text {n % 9}", "xx" if n else None, "s", n % 4) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = queries.op12_manifest(spark, written(spark, tmp_path, docs.repartition(5)))
    assert rows_of(found, *RESULT) == manifested(docs.collect())


def test_manifest_of_a_large_and_small_groups_in_one_task(spark, tmp_path, monkeypatch):
    """Rounds in which one group has several nodes and others have one, whose paths are empty, in the same task."""
    monkeypatch.setattr(manifest, "manifest", functools.partial(manifest.manifest, height=1))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [(n, f"text {n}", "b" if n < 21 else "ac"[n % 2], "s", n) for n in range(23)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        found = queries.op12_manifest(spark, written(spark, tmp_path, docs.coalesce(1)))
        assert rows_of(found, *RESULT) == manifested(docs.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_manifest_of_nothing_and_of_one(spark, empty, tmp_path):
    assert queries.op12_manifest(spark, written(spark, tmp_path / "none", empty)).collect() == []
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    row = queries.op12_manifest(spark, written(spark, tmp_path / "one", one)).first()
    assert row["root"] == row["subroot"] == row["leaf"] == row["folded_root"] and row["proof_sha256"] == h("")


# ---- toxicity -------------------------------------------------------------------------------------

BAD = "scumbagger verminoid grotgob sludgewit".split()


def labelled(spark, n=900):
    rng = random.Random(1)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "un", "er")]
    rows, known = [], []
    for i in range(n):
        ws = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(3, 6)):
                ws.insert(rng.randrange(len(ws)), rng.choice(BAD) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(ws)))
        known.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3),
            spark.createDataFrame(known, "doc_id bigint, toxic int"), dict(known))


@pytest.fixture(scope="module")
def trained(spark):
    docs, known, toxic = labelled(spark)
    return docs, known, toxic, toxicity.train(docs, known)


def test_held_out_documents_are_told_apart(trained):
    docs, _, toxic, model = trained
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    unseen = [d for d in found if zlib.crc32(str(d).encode()) % 5 == 0]
    right = sum((found[d] >= 0.5) == bool(toxic[d]) for d in unseen)
    assert len(unseen) > 100 and right / len(unseen) > 0.97


def test_scores_follow_compressed_lengths(trained):
    """Every score recomputed from the model's parts with the library itself, one window at a time."""
    docs, _, _, model = trained
    evidence = dict(zip(model.cells.tolist(), model.evidence.tolist()))

    def length(content, text):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_checksum=False, write_content_size=False,
                                            write_dict_id=False).compress(text))

    rows = toxicity.score(docs.where("doc_id < 12"), model).collect()
    for r in rows:
        values = []
        for word in re.findall(rb"[a-z\x80-\xff]+", r["text"].lower().encode()):
            text = b" " + word + b" " + toxicity.PAD
            a, b, c = (min(n, m - 1) for n, m in zip((len(text), length(model.ordinary, text), length(model.toxic, text)),
                                                      toxicity.LENGTHS))
            values.append(evidence.get((a * toxicity.LENGTHS[1] + b) * toxicity.LENGTHS[2] + c, 0.0))
        top = sorted(values)[-3:]
        x = [top[-1], sum(top), sum(max(v - 0.7, 0) for v in values) ** 0.5, sum(max(v - 1.5, 0) for v in values) ** 0.5,
             sum(values) / len(values), np.log1p(len(values)), 1.0]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))), abs=1e-9)
    assert len(rows) == 12


def test_training_repeats_and_leaves_held_out_labels_alone(spark, trained):
    docs, known, _, model = trained
    again = toxicity.train(docs.repartition(5), known.repartition(2))
    assert again.toxic == model.toxic and again.ordinary == model.ordinary
    assert np.array_equal(again.cells, model.cells) and np.allclose(again.weights, model.weights, atol=1e-9)
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    other = toxicity.train(docs, flipped)
    assert other.toxic == model.toxic and np.allclose(other.weights, model.weights, atol=1e-9)


def test_toxicity_of_odd_rows(odd, empty, known, trained):
    model = trained[3]
    scored = toxicity.score(odd, model)
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert sorted(scored.columns) == sorted(odd.columns)
    none = {r["score"] for r in rows if not toxicity.words(r["text"])}
    assert len(none) == 1
    assert toxicity.score(empty, model).collect() == []
    assert toxicity.train(empty, known) is None and {r["score"] for r in toxicity.score(odd, None).collect()} == {0.5}


def test_long_words_are_several_windows(monkeypatch):
    assert toxicity.words("A" * 150 + " b") == [b"a" * 64, b"a" * 64, b"a" * 22, b"b"]
    cells = toxicity.Cells(b" idiot  fool ", b" the  of ")
    text = "the fool of " * 40
    whole = np.concatenate(list(cells.of(text)))
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.array_equal(np.concatenate(list(cells.of(text))), whole) and list(cells.of(None)) == []
