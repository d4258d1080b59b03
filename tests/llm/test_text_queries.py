"""The registered text queries: against their SQL, else against plain Python or held-out rows; and the pipeline stage by stage."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.test_operators import brute_components, contract_words, lower
from trapline.llm import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def test_all_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(name, spark, duck):
    frame = queries.QUERIES[name](spark, str(DATA))
    result = duck.execute(queries.SQL[name])
    columns = sorted(d[0] for d in result.description)
    assert columns == sorted(frame.columns)
    plain = lambda names, rows: sorted(tuple(repr(dict(zip(names, r))[c]) for c in columns) for r in rows)
    assert plain(frame.columns, frame.collect()) == plain([d[0] for d in result.description], result.fetchall())


def test_language_of_held_out_rows(spark, documents):
    found = {r.doc_id: r for r in queries.op2_language_id(spark, str(DATA)).collect()}
    held = [(i, lang) for i, _, lang in documents if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, _ in held} == {i for i, r in found.items() if r.held_out} and len(found) == len(documents)
    assert sum(found[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held)


def test_language_model_beats_word_counts(spark, documents):
    found = queries.op3_language_model(spark, str(DATA)).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(documents) and {r.doc_id for r in held} == {i for i, _, _ in documents if zlib.crc32(str(i).encode()) % 10 == 0}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_token_ids(spark, documents):
    library = Tokenizer.from_file(queries.VOCABULARY)
    hexed = lambda data: hashlib.sha256(data).hexdigest()
    expected = {}
    for i, t, _ in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i] = (len(ids), hexed(np.array(ids, "<u4").tobytes()), hexed(library.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op5_bpe(spark, str(DATA)).collect()} == expected


def test_quality_of_held_out_rows(spark, duck):
    found = {r.doc_id: r for r in queries.op8_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = duck.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(i, q) for i, q in labels if found[i].held_out]
    assert sum(found[i].predicted == q for i, q in held) >= 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in found.items())


def test_pipeline_against_plain_python(spark, duck, documents):
    found = _languages(spark)
    languages, bits = {r.doc_id: r.lang_pred for r in found}, {r.doc_id: r.bits for r in found}
    kept = [(i, t) for i, t, _ in documents if languages[i] != "und" and bits[i] <= 4.0 * len(t.encode()) + 256]
    last = {}
    for i, t in kept:
        last[lower(t)] = max(i, last.get(lower(t), i))
    kept = [(i, t) for i, t in kept if last[lower(t)] == i]
    least = {i: c for i, _, c in brute_components(kept, 5)}
    kept = [(i, t) for i, t in kept if least[i] == i]
    wins = collections.defaultdict(set)
    for (text,) in duck.execute("SELECT text FROM benchmark").fetchall():
        w = contract_words(text)
        size = min(10, len(w))
        wins[size] |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
    clean = lambda w: not any(tuple(w[k : k + n]) in own for n, own in wins.items() if n for k in range(len(w) - n + 1))
    kept = {i: t for i, t in kept if clean(contract_words(t))}
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert set(result) == set(kept) and all(result[i].decoded == t for i, t in kept.items())


def _languages(spark):
    from trapline.llm import language_id

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return language_id.identify(docs, language_id.train(docs)).collect()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(DATA)).columns == docs.columns


def test_no_row_is_left_out_by_a_query():
    text = Path(queries.__file__).read_text()
    assert not re.search(r"\.limit\(|\.sample\(|LIMIT|TABLESAMPLE", text)
