"""The pipeline's stages one by one, and all of them on a small table against brute force."""

import collections
import string

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from urbanflow.llm import bpe, mixing, quality, simhash

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(corpus_pipeline.RANKS),
                          special_tokens={})


@pytest.fixture(scope="module")
def folder(odd, known, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{at}/documents.parquet")
    known.write.parquet(f"{at}/labels.parquet")
    return at


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "byte_bpe"]
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {f"{n.split('_')[0]}_" for n in names} and "pipeline" in names


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, odd, empty, folder, name, stage):
    found = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    rows = found.collect()
    if name != "byte_bpe":
        assert found.columns == odd.columns and rows
        # What stays is a row of the input, value for value, columns named like an operator's own included.
        assert {tuple(r) for r in rows} <= {tuple(r) for r in odd.collect()}
    else:
        assert len(rows) == odd.count() and all(r["round_trip"] for r in rows)
    assert stage(spark, empty, folder).count() == 0


def fingerprint(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return 0
    n = corpus_pipeline.SHINGLE
    values = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in values) > len(values))


def test_near_copies_stage_broadcasts_no_exploded_rows(spark, odd, monkeypatch):
    written, checkpointed = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: written.append(df) or checkpointed(df))
    corpus_pipeline.without_near_copies(spark, odd, "")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in written]
    exploded = [p for p in plans if "posexplode" in p]
    assert exploded and not any("Broadcast" in p for p in exploded)


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    weights = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    score = quality.Features()
    good = []
    for r in docs.collect():
        at, x = score.vector(r["text"])
        if quality.logistic(float(weights[at] @ x) + weights[-1]) >= corpus_pipeline.GOOD:
            good.append(r)
    last = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        last[(r["text"] or "").translate(LOWER)] = r
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in last.values()}
    roots = {d: d for d in prints}

    def find(d):
        while roots[d] != d:
            d = roots[d]
        return d

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= corpus_pipeline.BITS:
                low, high = sorted((find(a), find(b)))
                roots[high] = low
    kept = [r for r in last.values() if find(r["doc_id"]) == r["doc_id"]]
    mixed = mixing.mix(spark.createDataFrame(kept, docs.schema)).select("doc_id", "copies").collect()
    want = collections.Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == want and all(r["round_trip"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in kept}
    assert all(r["ids"] == PLAIN.encode_ordinary(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            df = entry.queries()[name](spark, FOLDER)
            want = con.execute(sql)
            names = [c[0] for c in want.description]
            assert sorted(names) == sorted(df.columns)
            assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())


def test_query_columns(spark):
    want = {"op1": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
            "op2": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
            "op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
            "op4": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
            "op5": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
            "op6": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
            "op7": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
                    "base_sha256": "string", "spans": "string"},
            "op8": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
            "op9": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint",
                    "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
            "op10": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
            "op11": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
            "op12": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string",
                     "folded_root": "string", "verified": "boolean"},
            "op13": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}}
    for name, query in entry.queries().items():
        if name.startswith("op"):
            df = query(spark, FOLDER)
            assert want[name.split("_")[0]].items() <= dict(df.dtypes).items(), name
            assert name.startswith("op11") or df.select(F.count("*")).first()[0] == 200
