"""Manifest, periodic runs and token counts on small tables with every awkward row, against brute force in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import blank_words, texts
from trapline.llm import merkle, periodic_runs, queries, token_counts

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, lang string, source string, n_chars long, team string, place long, digest string, block int, kept int, path string, runs int, n_tokens int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, [None, "en", "de", "é"][i % 4], "s", i) for i, t in enumerate(texts())]
    found += [(None, "a", "en", None, None), (None, None, None, None, None), (3, "an id that is taken", "en", "s", 1)]
    found += [(7, "same", "en", "s", 4)] * 3
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", 2, 3, "p", 4, 5) for r in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        begin = at // 8 * 8
        out.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + 8])))
        at //= 8
    return out


def brute_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf_of((doc_id, source, lang, n_chars, text)), doc_id))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = [grown([leaf for _, _, leaf, _ in sorted(groups[n], key=lambda r: r[:3])]) for n in names]
    crown = grown([t[-1][0] for t in trees])
    out = []
    for g, name in enumerate(names):
        for at, (_, _, leaf, doc_id) in enumerate(sorted(groups[name], key=lambda r: r[:3])):
            out.append((doc_id, leaf, trees[g][-1][0], crown[-1][0], way(trees[g], at) + way(crown, g)))
    return sorted(out, key=repr)


def found_manifest(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(p["left"], p["right"]) for p in r.proof]) for r in df.collect()), key=repr)


def test_manifest(docs, rows, nothing):
    assert found_manifest(merkle.manifest(docs)) == brute_manifest(rows)
    assert merkle.manifest(nothing).collect() == []


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8,), (9, 1), (64, 65, 1), (512, 2), (513, 1, 70), (4097,), tuple([2] * 70), tuple([1] * 600)])
def test_manifest_of_every_height(spark, sizes):
    rows = [(i, f"t{i}", f"g{g:03}", None, None) for g, size in enumerate(sizes) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found_manifest(merkle.manifest(df)) == brute_manifest(rows)


def test_manifest_tells_changed_rows(docs):
    changed = docs.withColumn("found", merkle.leaf(*[F.upper("text") if c == "text" else F.col(c) for c in merkle.FIELDS]))
    for r in merkle.manifest(changed, keep=("found", "team")).withColumn("back", merkle.folded(F.col("found"), F.col("proof"))).collect():
        assert (r.back == r.root) == (r.found == r.leaf) and r.team == "t"


def brute_runs(words):
    n, least = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                least.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in least.items())


def collapsed(words, runs):
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_words():
    random.seed(5)
    for _ in range(150):
        found = []
        for _ in range(random.randrange(1, 6)):
            kinds, n = random.choice([1, 2, 3, 5, 30]), random.choice([0, 1, 23, 24, 25, 60, 150, 300])
            words = [random.randrange(kinds) for _ in range(n)]
            for _ in range(random.randrange(4) if n > 30 else 0):
                at = random.randrange(n)
                period, end = random.randrange(1, max(2, (n - at) // 3 + 1)), random.randrange(at, n + 1)
                for i in range(at, end):
                    words[i] = words[at + (i - at) % period]
            found.append(words)
        expected = [(d, *r) for d, words in enumerate(found) for r in brute_runs(words)]
        assert list(zip(*(x.tolist() for x in periodic_runs.runs_of([np.array(w, np.int32) for w in found])))) == expected


def test_extensions_reach_far():
    random.seed(6)
    stretch = [random.randrange(3) for _ in range(700)]
    words = np.array([9, *stretch, 4, *stretch, 5, *stretch[:400], 10], np.int32)
    index = periodic_runs.Extensions(words)
    pairs = [(i, j) for i in range(0, len(words) - 1, 37) for j in range(i + 1, len(words), 41)]
    for (i, j), got in zip(pairs, index.at(*np.array(pairs).T).tolist()):
        n = 0
        while j + n < len(words) and words[i + n] == words[j + n]:
            n += 1
        assert got == n


def test_runs_in_texts(spark, docs, rows, nothing):
    random.seed(7)
    more = [(100 + n, "\t".join(w * 9) + " end", "x", "s", 1) for n, w in enumerate([["a"], ["a", "b", "c"], [str(random.randrange(99)) for _ in range(40)]])]
    given = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in more], "doc_id long, text string"))
    expected = []
    for doc_id, text, *_ in rows + more:
        words = blank_words(text)
        runs = [(0, len(words), 1)] if len(set(words)) == 1 and len(words) > 1000 else brute_runs(words)
        expected.append((doc_id, len(words), runs, collapsed(words, runs)))
    found = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(given).collect()), key=repr)
    assert found == sorted(expected, key=repr) and periodic_runs.find_runs(nothing).count() == 0


def test_run_query_against_brute_force(spark):
    expected = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        words, h = blank_words(r.text), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            at = h // 10 % len(words)
            period = 1 + (len(words) - at) // (3 + h // 10 % 8)
            words = [w if i < at else words[at + (i - at) % period] for i, w in enumerate(words)]
        runs = brute_runs(words) if len(words) < 3000 else [tuple(x[1:]) for x in zip(*(y.tolist() for y in periodic_runs.runs_of([np.unique(words, return_inverse=True)[1]])))]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        told = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        expected[r.doc_id] = (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(told), sha(collapsed(words, runs)))
    found = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, DATA).collect()}
    assert found == expected and any(r[0] for r in found.values())


def test_token_counts(docs, rows, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    expected = []
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 512))
    found = token_counts.count_tokens(docs, VOCABULARY)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(nothing, VOCABULARY).count() == 0


def test_token_count_query_and_its_bounds(spark, monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    given = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in given.items()}
    found = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_counts(spark, DATA).collect()}
    assert found == {i: (len(t.encode()), sizes[i], sizes[i] > 512) for i, t in given.items()}
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "LONG", 10)
    count = token_counts.counter(*token_counts.merge_table(VOCABULARY))
    assert all(count(t) == sizes[i] for i, t in list(given.items())[:40])
