"""Text operators on small tables with every awkward row, against brute force in plain Python."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trapline.llm import bpe, chat, decontamination, exact_dedup, exchange, language_id, language_model, near_dedup, quality, queries, substring_dedup, url_templates
from trapline.llm.words import Words, blank_separated, packed, unpacked, unpacked_bits, utf8, windows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, lang string, batch int, digest string, id long, key long, hit boolean, component int"


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def blank_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def texts():
    random.seed(11)
    words = ["Ab", "be", "Ce", "d\u00e9", "\u00fcber", "e", "f,", "g."]
    base = [" ".join(random.choice(words) + str(random.randrange(40)) for _ in range(n)) for n in (30, 60, 90)]
    out = [None, "", "   \n", "a", "A", "a", "b c d", "B c d", "x\u00a0y \u2028z", "<|endoftext|> x <|endoftext|>", "caf\u00e9 \U0001f600 \u0416\u0437", "\u0416", "1 2 3 !?"]
    for b in base:
        out += [b, b.upper(), b + " tail end", "start " + b, b.replace("5", "6"), " ".join(b.split()[::-1]), b]
    out.append("tok " * 30_000)
    out.append("q" * 100_000)
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i, t) for i, t in enumerate(texts())]
    found += [(None, "a"), (None, None), (14, found[14][1]), (3, "another text of an id that is taken")]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "l", 1, "x", 2, 3, True, 4) for i, t in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_words_match_the_pattern(rows):
    column = pa.array([t for _, t in rows], pa.string()).slice(2)
    data, offsets = utf8(column)
    words = Words(data, offsets, blank_separated())
    for d, t in enumerate(column.to_pylist()):
        own = range(words.first[d], words.first[d + 1])
        assert [data[words.starts[i] : words.ends[i]].tobytes().decode() for i in own] == blank_words(t)
    at, hashes = windows(words, words.hashes(), 3)
    by_hash = collections.defaultdict(set)
    for i, h in zip(at.tolist(), hashes.tolist()):
        by_hash[h].add(words.bytes_of(i, 3))
    assert all(len(x) == 1 for x in by_hash.values()) and len({next(iter(x)) for x in by_hash.values()}) == len(by_hash)


def test_packed_values_come_back():
    values = np.array([0, 1, 255, 256, 2**40, 2**64 - 1], np.uint64)
    assert (unpacked(packed(values), len(values)) == values).all() and len(unpacked(packed(values[:0]), 0)) == 0


def test_exact_copies(docs, rows, nothing):
    group = collections.defaultdict(list)
    for i, t in rows:
        group[lower(t)].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in group.items()}
    expected = sorted(((i, top[lower(t)], len(group[lower(t)]), i == top[lower(t)]) for i, t in rows), key=repr)
    for slots in (1 << 20, 1 << 10):  # a small filter lets more rows through to the shuffle, the result stays
        assert sorted_rows(exact_dedup.mark_copies(docs, slots=slots), "doc_id", "keep_id", "group_size", "kept") == expected
    assert sorted_rows(exact_dedup.mark_copies(docs), "doc_id", "keep_id", "group_size", "kept") == expected
    assert [exact_dedup.slots_for(n) for n in (0, 65_536, 65_537, 10**12)] == [1 << 20, 1 << 20, 1 << 21, 1 << 31]
    kept = exact_dedup.drop_copies(docs, slots=1 << 12)
    assert kept.columns == docs.columns and sorted_rows(kept, "doc_id", "text") == sorted(((i, t) for i, t in rows if i == top[lower(t)]), key=repr)
    assert exact_dedup.mark_copies(nothing, slots=1 << 12).count() == 0


def contract_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def test_decontamination(spark, docs, rows, nothing):
    source = [t for _, t in rows if t and len(contract_words(t)) > 40][0]
    items = [(1, " ".join(source.split()[3:20])), (2, "B, c; d"), (3, None), (4, ""), (5, "tok tok"), (None, "a"), (7, " ".join(source.split()[3:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, t in rows:
        w, covered, found = contract_words(t), set(), set()
        for item, it in items:
            own = contract_words(it)
            size = min(10, len(own))
            wins = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
            for k in range(len(w) - size + 1 if own else 0):
                if tuple(w[k : k + size]) in wins:
                    covered |= set(range(k, k + size))
                    found |= {item} - {None}
        expected.append((i, len(w), len(covered), sorted(found)))
    for at_once in (1_000_000, 4):  # in one pass and in several
        hits = decontamination.find_hits(docs, bench, at_once=at_once)
        found = sorted(((r.doc_id, r.n_words, sum(x["end"] - x["start"] for x in r.spans), list(r["items"])) for r in hits.collect()), key=repr)
        assert found == sorted(expected, key=repr)
        clean = decontamination.drop_contaminated(docs, bench, at_once=at_once)
        assert clean.columns == docs.columns and sorted_rows(clean, "doc_id") == sorted(((x[0],) for x in expected if not x[2]), key=repr)
    spans = {(r.doc_id, r.text): r.spans for r in decontamination.find_hits(docs, bench).join(docs, "doc_id").collect()} | {(r.doc_id, r.text): r.spans for r in with_spans(docs, bench)}
    expected_cuts = []
    for i, t in rows:
        cut, at = "", 0
        for x in spans[i, t] if t else []:
            cut, at = cut + t[at : x["from"]], x["to"]
        expected_cuts.append((i, None if t is None else cut + t[at:]))
    for at_once in (1_000_000, 4):
        cut = decontamination.remove_spans(docs, bench, at_once=at_once)
        assert cut.columns == docs.columns and sorted_rows(cut, "doc_id", "text") == sorted(expected_cuts, key=repr)
    assert decontamination.find_hits(nothing, bench).count() == 0
    assert not decontamination.find_hits(docs, bench.limit(0)).filter("size(spans) > 0").count()


def with_spans(docs, bench):
    """Each row alone, so that null and repeated ids meet their own spans."""
    numbered = docs.select("doc_id", "text").withColumn("n", F.monotonically_increasing_id()).persist()
    found = decontamination.find_hits(numbered, bench, doc_id="n").select(F.col("doc_id").alias("n"), "spans")
    return numbered.join(found, "n").collect()


def test_windows_of_equal_hash_are_all_compared():
    rows = [Row(words=2, hash=0, content=b"a x", items=[1]), Row(words=2, hash=0, content=b"b c", items=[2]), Row(words=2, hash=0, content=b"d e", items=[3, 4])]
    for text, items in ((b"b c", {2}), (b"d e", {3, 4}), (b"a x", {1}), (b"b d", set())):
        data = np.frombuffer(text, np.uint8)
        words = Words(data, np.array([0, len(data)]), blank_separated())
        own = windows(words, words.hashes(), 2)[1].view(np.int64)
        index = decontamination.window_index([Row(**r.asDict() | {"hash": int(own[0])}) for r in rows])
        hit, found = decontamination.matches(index, words)
        assert found == [items] and hit.tolist() == [bool(items)] * 2


def test_workers_need_no_package(tmp_path):
    """With the repository on the driver's path only, operators that broadcast a model run."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(bpe.__file__).parents[2])!r})
from pyspark.sql import functions as F
from trapline.llm import bpe, decontamination, language_model, periodic_runs, token_counts
from trapline.session import build_session
spark = build_session("alone", "local[2]", 2)
docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
print([r.n_words for r in decontamination.find_hits(docs, bench).collect()], bpe.encode(docs, {VOCABULARY!r}).count())
print(bpe.decode(bpe.encode(docs, {VOCABULARY!r}), {VOCABULARY!r}).count(), token_counts.count_tokens(docs, {VOCABULARY!r}).count(), periodic_runs.find_runs(docs).count())
print(language_model.score(docs, language_model.train(docs), F.lit(False)).count())
"""
    kept = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=kept, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_language_and_code_length_decide(spark):
    random.seed(6)
    made = [(i, " ".join(random.choice(("der Hund", "die Katze", "und") if n == "de" else ("the dog", "a cat", "and")) for _ in range(60)), n) for i, n in enumerate(["de", "en"] * 30)]
    odd = [(100, "".join(chr(random.randrange(0x4E00, 0x9000)) for _ in range(200)), "en"), (101, "Qx7!", "en"), (102, "1234", "en"), (103, None, "en")]
    table = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    trees = language_id.train(table.filter("doc_id < 100"))
    ids = lambda **options: {r.doc_id for r in language_id.drop_undetermined(table, trees, **options).collect()}
    assert ids() == {i for i, *_ in made} | {101}  # letters that no tree foresees go, a short name stays
    assert ids(wanted=["en"]) - {101} == {i for i, _, n in made if n == "en"}
    assert ids(most_bits=40.0) == {i for i, *_ in made} | {100, 101} and ids(most_bits=0.0, allowance=0.0) == set()


def test_language_identification(spark, docs, nothing):
    random.seed(5)
    alphabets = {"x": "abcd ", "y": "wxyz ", "z": "abyz "}
    made = [(i, "".join(random.choice(alphabets[n]) for _ in range(200)), n) for i, n in enumerate("xyz" * 60)]
    made += [(900, None, "x"), (901, "", "y"), (902, "abc", None), (903, "1234 !", "x"), (904, "\u0416", "x")]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string")
    trees = language_id.train(train, learn=F.col("doc_id") % 4 != 2)
    assert list(trees) == ["x", "y", "z"]
    found = {r.doc_id: r for r in language_id.identify(train, trees).collect()}
    held = [(i, n) for i, _, n in made if i < 900 and i % 4 == 2]
    assert sum(found[i].lang_pred == n for i, n in held) >= 0.97 * len(held)
    assert [found[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3 and found[904].lang_pred != "und" and found[900].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())
    counts = collections.defaultdict(collections.Counter)  # brute force over one language's tree
    for i, t, n in made:
        if n == "x" and t and i % 4 != 2:
            data = b"   " + lower(t).encode()
            for k in range(3, len(data)):
                for order in range(4):
                    counts[data[k - order : k]][data[k]] += 1
    data, bits = b"   " + lower(made[2][1]).encode(), 0.0
    for k in range(3, len(data)):
        for order in range(3, -1, -1):
            seen = counts.get(data[k - order : k])
            if seen and data[k] in seen:
                bits += math.log2((sum(seen.values()) + len(seen)) / seen[data[k]])
                break
            if seen:
                bits += math.log2((sum(seen.values()) + len(seen)) / len(seen))
        else:
            bits += 8
    one = language_id.identify(train.filter("doc_id = 2"), {"x": trees["x"]}).first()
    assert one.bits == pytest.approx(bits)
    kept = language_id.drop_undetermined(docs, trees)
    assert kept.columns == docs.columns and kept.filter("text is null or text = ''").count() == 0
    assert language_id.train(nothing) == {} and language_id.identify(docs, {}).filter("lang_pred != 'und'").count() == 0


def test_documents_stay_where_no_language_is_known(spark):
    table = spark.createDataFrame([(1, "a clean text", None), (2, "1234 !", None), (3, None, None), (4, "", None), (5, "\u0416 1", None)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.keep_known_languages(spark, table, "")
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_language_samples_are_bounded_for_each_language(spark):
    random.seed(8)
    made = [(f"l{k:02}", "".join(random.choices("abcdefgh ", k=20_000))) for k in range(24) for _ in range(20)]
    made += [("hot", "once and again " * 20)] * 400 + [("hot", f"single text number {i}") for i in range(50)]
    made += [("small", "a language of one short text")]
    table = spark.createDataFrame(made, "lang string, text string")
    held = lambda trees: {name: int(levels[-1][1].sum()) for name, levels in trees.items()}
    found = held(language_id.train(table, sample_bytes=30_000))
    assert set(found) == {name for name, _ in made} and all(15_000 <= n <= 30_000 for name, n in found.items() if name[0] == "l")
    assert found["hot"] == sum(len(t) for t in {t for name, t in made if name == "hot"}) and found["small"] == len(made[-1][1])
    few = language_id.train(table, sample_bytes=30_000, nodes=30_000)
    assert sum(len(levels[0][0]) for levels in few.values()) <= 30_000 and held(few)["small"] == found["small"] and held(few)["hot"] == found["hot"]


def test_language_model_against_brute_force(docs, rows, nothing):
    held = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))
    model = language_model.train(docs, learn=~held)
    found = language_model.score(docs, model, held).collect()
    tokens = lambda t: [*blank_words(lower(t)), None]
    counts = collections.Counter(w for i, t in rows if i is None or i % 10 for w in tokens(t))
    total, distinct, once = sum(counts.values()), len(counts), sum(n == 1 for n in counts.values())
    unseen = min(max(once / total, 1 / (total + 1)), 0.5)
    by_key = collections.defaultdict(list)
    for r in found:
        by_key[r.doc_id].append(r)
    assert len(found) == len(rows) and model.tokens.sum() == total
    for i, t in rows:
        words = tokens(t)
        if len(words) > 200:
            continue
        column = pa.array([t], pa.string())
        classes = [*language_model.classes_of(language_model.tokenised(column)).tolist(), language_model.END]
        paths = {s: model.start[s] * model.emit[classes[0], s] for s in range(language_model.STATES)}
        for c in classes[1:]:
            paths = {s: sum(p * model.step[q, s] for q, p in paths.items()) * model.emit[c, s] for s in paths}
        score = math.log10(sum(paths.values()))
        for w, c in zip(words[:-1], classes):
            score += math.log10((1 - unseen) * counts[w] / model.tokens[c]) if counts[w] else math.log10(unseen) if model.tokens[c] else 0
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert any(
            r.score == pytest.approx(score) and r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total) and r.held_out == (i is not None and i % 10 == 0)
            for r in by_key[i]
        )
    assert language_model.score(nothing, language_model.train(nothing), held).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 5, 211])
def test_exchanged_keys_come_back(batches):
    buckets, rng = exchange.buckets_for(batches), np.random.default_rng(batches)
    assert buckets >= max(2, batches) and buckets & (buckets - 1) == 0
    for bits in (48, 64):
        keys = np.unique(np.append(rng.integers(0, 1 << (bits - 1), 500, np.uint64) * np.uint64(2), np.array([0, (1 << bits) - 1], np.uint64)))
        parts = exchange.filled(keys, buckets, bits)
        assert np.array_equal(np.concatenate([keys[own] for _, own in parts]), keys) and len({n for n, _ in parts}) == len(parts) <= len(keys)
        table = exchange.sent(3, keys, buckets, bits, lambda own: b"")
        back = [exchange.opened(table.slice(i, 1), buckets, bits)[0] for i in range(table.num_rows)]
        assert np.array_equal(np.concatenate(back), keys)
    assert exchange.filled(np.zeros(0, np.uint64), buckets, 64) == [] and exchange.sent(0, np.zeros(0, np.uint64), buckets, 64, lambda own: b"").num_rows == 0


def test_windows_with_one_key_are_told_apart_by_their_check():
    keys, checks = np.array([7, 3, 7, 7, 3], np.uint64), np.array([1, 5, 2, 1, 5], np.uint64)
    places, inverse = substring_dedup.distinct(keys, checks)
    assert list(zip(keys[places].tolist(), checks[places].tolist())) == [(3, 5), (7, 1), (7, 2)] and inverse.tolist() == [1, 0, 2, 1, 0]
    extras = [np.array(c, np.uint32).tobytes() + packed(np.array(i, np.uint64)) for c, i in (([5, 1], [9, 4]), ([5, 2], [8, 1]))]
    bits = substring_dedup.earlier_windows([np.array([3, 7], np.uint64)] * 2, extras)
    assert unpacked_bits(bits[0], 2).tolist() == [True, False] and bits[1] is None
    assert [len(x) for x in substring_dedup.distinct(keys[:0], checks[:0])] == [0, 0]


def test_language_model_probabilities_add_up():
    model = language_model.Model.first()
    assert model.start.sum() == pytest.approx(1) and model.step.sum(1) == pytest.approx(1) and model.emit.sum(0) == pytest.approx(1)
    classes, bounds = np.array([1, 2, 3, 4, 5, 1, 2] * 60), np.array([0, 100, 100, 420])
    starts, steps, emits = language_model.expected(classes, bounds, model)
    assert emits.sum() == pytest.approx(len(classes), rel=1e-4) and starts.sum() == pytest.approx(2) and steps.sum() == pytest.approx(len(classes) - 2, rel=1e-4)
    again = language_model.Model.from_counts(starts, steps, emits, np.bincount(classes, minlength=language_model.CLASSES).astype(float))
    one = np.array([0, len(classes)])
    assert language_model.forward(classes, one, again)[0] > language_model.forward(classes, one, model)[0]


def test_language_model_counts_are_those_of_whole_texts(monkeypatch):
    rng, n = np.random.default_rng(3), 300
    classes, bounds = rng.integers(0, 9, n), np.array([0, 1, 4, 50, 57, 250, n])
    emits = np.zeros((language_model.CLASSES, language_model.STATES))
    emits[:9] = rng.random((9, language_model.STATES))
    model = language_model.Model(rng.dirichlet(np.ones(language_model.STATES)), rng.dirichlet(np.ones(language_model.STATES) * 0.3, language_model.STATES), emits / emits.sum(0), np.zeros(1))
    starts, steps, found = np.zeros(language_model.STATES), np.zeros((language_model.STATES,) * 2), np.zeros(emits.shape)
    for a, b in itertools.pairwise(bounds):  # forward and backward over one whole text
        alpha, beta = [model.start * model.emit[classes[a]]], [np.ones(language_model.STATES)]
        for c in classes[a + 1 : b]:
            alpha.append(alpha[-1] @ model.step * model.emit[c])
        for c in classes[a + 1 : b][::-1]:
            beta.insert(0, model.step @ (model.emit[c] * beta[0]))
        total = alpha[-1].sum()
        starts += alpha[0] * beta[0] / total
        for t in range(b - a):
            found[classes[a + t]] += alpha[t] * beta[t] / total
            if t + 1 < b - a:
                steps += model.step * np.outer(alpha[t], model.emit[classes[a + t + 1]] * beta[t + 1]) / total
    for stretch, together, abreast in ((7, 1 << 20, 4096), (7, 20, 2), (1024, 1 << 20, 4096)):
        monkeypatch.setattr(language_model, "LONG", stretch)
        monkeypatch.setattr(language_model, "TOGETHER", together)
        monkeypatch.setattr(language_model, "ABREAST", abreast)
        for got, whole in zip(language_model.expected(classes, bounds, model), (starts, steps, found)):
            np.testing.assert_allclose(got, whole, rtol=1e-3, atol=1e-3)


def test_language_model_learns_from_all_texts_in_every_round(docs, rows, monkeypatch):
    seen, one_round = [], language_model.one_round
    monkeypatch.setattr(language_model, "one_round", lambda texts_, model: seen.append(texts_.count()) or one_round(texts_, model))
    language_model.train(docs)
    assert seen == [len(rows)] * 15


def brute_components(rows, size, similarity=0.8):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = blank_words(lower(t))
        sets[n] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    above = {n: n for n in sets}

    def root(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * len(sets[a] | sets[b]):
            above[root(a)] = root(b)
    least = collections.defaultdict(list)
    for n in sets:
        least[root(n)].append(rows[n][0])
    return [(rows[n][0], len(sets[n]), rows[n][0] if rows[n][0] is None else min(least[root(n)])) for n in sets]


def test_near_duplicates(docs, rows, nothing):
    for size in (4, 5):
        expected = sorted(((i, n, c, i == c) for i, n, c in brute_components(rows, size)), key=repr)
        assert sorted_rows(near_dedup.near_duplicates(docs, size=size), "doc_id", "n_shingles", "component_id", "kept") == expected
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_in_chains_and_blocks(spark, monkeypatch):
    random.seed(2)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    made, text = [], [f"w{random.randrange(10**6)}" for _ in range(80)]
    for i in range(120):
        if i % 40 == 0:
            text = [f"w{random.randrange(10**6)}" for _ in range(80)]
        text = list(text)
        for _ in range(2):
            text[random.randrange(80)] = f"w{random.randrange(10**6)}"
        made.append((1000 - i, " ".join(text)))
    expected = sorted((i, n, c, i == c) for i, n, c in brute_components(made, 4))
    found = near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == expected and len({x[2] for x in expected}) < 120


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    found = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 140))
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_like_the_library(docs, rows, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    expected = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=repr)
    encoded = bpe.encode(docs, VOCABULARY, decoded=True).collect()
    found = sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in encoded), key=repr)
    assert found == expected and all(r.n_tokens == len(r.ids) // 4 for r in encoded)
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert sorted_rows(back, "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)
    assert bpe.encode(nothing, VOCABULARY).count() == 0


def test_substring_dedup(docs, rows, nothing):
    for window in (13, 4):
        first = {}
        for i, t in rows:
            w = blank_words(t)
            for k in range(len(w) - window + 1 if i is not None else 0):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
        expected = []
        for i, t in rows:
            w = blank_words(t)
            gone = {k + j for k in range(len(w) - window + 1 if i is not None else 0) if first[tuple(w[k : k + window])] < i for j in range(window)}
            expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        found = substring_dedup.remove_repeats(docs, window=window)
        assert sorted_rows(found, "doc_id", "n_words", "n_removed", "kept") == sorted(expected, key=repr)
        assert all(sum(x["end"] - x["start"] for x in r.spans) == r.n_removed for r in found.collect())
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_of_neighbouring_large_ids(spark):
    passage = [f"p{k}" for k in range(20)]
    table = [(1, " ".join(passage)), (2**60, " ".join(passage))]
    table += [(2**60 + i, " ".join([f"own{i}-{k}" for k in range(15)] + passage)) for i in range(1, 41)]
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found[1].n_removed == 0 and found[2**60].n_removed == 20 and found[2**60].kept == ""
    assert all(r.kept == " ".join(f"own{i - 2**60}-{k}" for k in range(15)) for i, r in found.items() if i > 2**60)


def test_quality_on_held_out_texts(spark, docs, nothing):
    random.seed(8)
    word = lambda: "".join(random.choice("aeioubcdfg") for _ in range(5))
    made = [(i, " ".join(word() if i % 2 else word().upper() + "!!" for _ in range(60))) for i in range(400)]
    frame = spark.createDataFrame([*made, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in made] + [(1, None), (None, 1), (900, 0)], "doc_id long, quality int")
    model = quality.train(frame, labels, learn=F.col("doc_id") % 3 != 1)
    found = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    held = [i for i, _ in made if i % 3 == 1]
    assert sum((found[i] >= 0.5) == i % 2 for i in held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in found.values()) and found[900] == found[901]
    assert quality.score(docs, model).count() == docs.count()
    assert quality.train(nothing, labels) == {} and {r.score for r in quality.score(docs, {}).collect()} == {0.5} and quality.score(nothing, model).count() == 0


RULES = [url_templates.Rule("allow", "org", "/"), url_templates.Rule("block", "example.org", "/es/"), url_templates.Rule("block", "com", "/de/")]


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "x://org", "x://org/", "x://notexample.org/es/", "x://b.com/de/é\n2#f", "x://b.com?q=/de/", "x://c.com://d/de/"]
    rows = url_templates.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(4, urls[4], "h")], "page_id long, url string, host string"), RULES).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(urls) + 1
    assert [found[i] for i in range(4)] == [("", "", None, "allow")] * 4
    assert found[4] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert found[5] == ("org", "", None, "allow") and found[6] == ("org", "/", "org/", "allow") and found[7][2:] == ("org/", "allow")
    assert found[8] == ("b.com", "/de/é\n2", "com/de/", "block") and found[9] == ("b.com", "", None, "allow") and found[10][:2] == ("c.com:", "//d/de/")
    assert url_templates.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_url_branch_is_rejected_by_its_labels(spark):
    rules = [url_templates.Rule("block", "a.net", "/ad/x/1"), url_templates.Rule("allow", "a.net", "/news/1")]
    urls = [f"x://a.net/ad/x/{i}" for i in range(10, 20)] + [f"x://a.net/ad/x/2{i}" for i in range(3)] + [f"x://a.net/news/1{i}" for i in range(10)] + [f"x://a.net/news/2{i}" for i in range(3)] + ["x://b.net/ad/x/5"]
    rows = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    verdict = {urls[r.page_id]: r.verdict for r in rows}
    assert verdict["x://a.net/ad/x/20"] == "block" and verdict["x://a.net/news/20"] == "allow" and verdict["x://b.net/ad/x/5"] == "allow"
    slugs = [(i, f"x://c.net/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}/p") for i in range(100)]
    assert {r.template for r in url_templates.judge(spark.createDataFrame(slugs, "page_id long, url string"), rules).collect()} == {"/"}


def test_url_branches_that_part_at_the_tenth_segment(spark):
    deep = "https://a.net/" + "/".join("abcdefghi")
    rules = [url_templates.Rule("block", "a.net", "/a/b/c/d/e/f/g/h/i/ad/x/1"), url_templates.Rule("allow", "a.net", "/a/b/c/d/e/f/g/h/i/news/1")]
    urls = [f"{deep}/ad/x/1{i}" for i in range(40)] + [f"{deep}/news/1{i}" for i in range(40)] + [f"{deep}/ad/y/2", f"{deep}/news/2"]
    found = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert (found[80].rule, found[80].verdict, found[80].template) == (None, "block", "/a/b/c/d/e/f/g/h/i/ad")
    assert (found[81].rule, found[81].verdict, found[81].template) == (None, "allow", "/a/b/c/d/e/f/g/h/i/news")


def test_chat_layouts_and_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> \\ [\\\\INST] <s", "", "<s>[/INST", "\n\t\u0000\u2028 \U0001f600", "<<s>></s></s>", "[[INST]]"]
    records = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}',
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"},{"from":"tool","value":"c"}]}',
        '{"output":"o","input":"","instruction":"i"}',
        '{"output":"o","input":"more","instruction":"i"}',
        '{"prompt":"p","response":"[{\\"a\\":1}]"}',
        '{"prompt":"p","other":1}',
        "not json",
        None,
    ]
    found = {r.n: r for r in chat.formatted(chat.canonical(spark.createDataFrame(list(enumerate(records)), "n int, record string"))).collect()}
    turns = {n: None if r.turns is None else [tuple(t) for t in r.turns] for n, r in found.items()}
    assert turns[0] == [("user", "hi"), ("assistant", "")] and turns[1] == [("user", "a"), ("assistant", "b"), ("tool", "c")]
    assert turns[2] == [("user", "i"), ("assistant", "o")] and turns[3][0] == ("user", "i\n\nmore") and turns[4] == [("user", "p"), ("assistant", '[{"a":1}]')]
    assert turns[5] is turns[6] is turns[7] is None and found[7].formatted is None
    assert found[2].fingerprint == found[3].fingerprint != found[0].fingerprint
    rows = [(c, k, ("user", "assistant", "[INST]", None)[(c + k) % 4], t) for c in range(4) for k, t in enumerate(nasty)] + [(9, None, "assistant", None), (9, 1, "user", "x"), (9, 1, "user", "x"), (None, 0, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    given = chat.turns_of(frame).withColumns({"ready": F.lit(1), "loss": F.lit("of the caller")})
    texts_ = chat.formatted(given).withColumns({"back": chat.turns_back(F.col("formatted")), "under": chat.loss_texts(F.col("formatted"), F.col("loss"))}).collect()
    assert len(texts_) == 6
    for r in texts_:
        own = sorted([((k is not None, k or 0), role or "", t or "") for c, k, role, t in rows if c == r.conv_id])
        assert [tuple(x) for x in r.back] == [(role, t) for _, role, t in own]
        assert list(r.under) == [t for _, role, t in own if role == "assistant"]
        assert r.ready == 1
    assert chat.turns_of(frame.limit(0)).count() == 0


def test_fingerprints_choose_the_mapping(spark, monkeypatch):
    rows = [(1, 0, "user", "p"), (1, 1, "assistant", "r"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "assistant", "m"), (4, 0, "user", None), (4, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = {c: [(role, t or "") for i, _, role, t in rows if i == c] for c in (1, 2, 3, 4)}
    layouts = {1: "prompt", 2: "question", 3: "messages", 4: "prompt"}
    read = lambda **options: {r.conv_id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.turns_of(frame, **options).collect()}
    assert read() == {c: (layouts[c], turns[c]) for c in turns}
    for kept in chat.MAPPINGS:  # with one mapping alone only its own layout is read
        assert read(mappings=(kept,)) == {c: (layouts[c], turns[c]) if layouts[c] == kept.name else (None, None) for c in turns}
    typed = "struct<messages:array<struct<role:string,content:string>>,prompt:string,response:string,note:struct<a:string,b:string>>"
    records = [(1, ([], None, None, None)), (2, (None, "p", "r", None)), (3, (None, "p", "r", ("x", None))), (4, (None, None, None, None)), (5, None), (6, ([("user", None)], None, None, None)), (7, (None, None, "r", None))]
    found = {r.n: r for r in chat.canonical(spark.createDataFrame(records, f"n int, record {typed}")).collect()}
    assert [found[n].layout for n in range(1, 8)] == ["messages", "prompt", None, None, None, "messages", None]
    assert found[1].turns == [] and [tuple(t) for t in found[6].turns] == [("user", "")] and found[5].fingerprint is None
    assert found[2].fingerprint == hashlib.sha256(b"prompt\nresponse").hexdigest() and found[3].fingerprint == hashlib.sha256(b"note.a\nprompt\nresponse").hexdigest()
    written = ['{"messages": []}', '{"messages": null}', '{"messages": 3}', '{"messages": [{"role": "user", "content": "x"}]}']
    json_turns = [r.turns if r.turns is None else [tuple(t) for t in r.turns] for r in chat.canonical(spark.createDataFrame(list(enumerate(written)), "n int, record string")).orderBy("n").collect()]
    assert json_turns == [[], [], None, [("user", "x")]]
    monkeypatch.setattr(chat, "fingerprint_of", lambda shape: hashlib.md5(shape.encode()).hexdigest())
    assert all(x == (None, None) for x in read().values())


def test_chat_keeps_long_turns(spark, tmp_path):
    size = 20_000_001
    frame = spark.range(2).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, "q").otherwise(F.repeat(F.lit("y"), size)).alias("text"))
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op6_chat_format(spark, str(tmp_path)).filter("conv_id = 7").first()
    assert (found.n_turns, found.loss_chars) == (2, size) and found.formatted_chars == 3 + 2 * 17 + len("user" + "q" + "assistant") + size
    assert found.loss_sha256 == hashlib.sha256(b"y" * size).hexdigest()
    large = F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("y"), 140_000_000), F.lit('", "response": "z"}'))
    with pytest.raises(Exception, match="too large for Variant"):
        chat.canonical(spark.range(1).select(large.alias("record"))).select(F.size("turns")).collect()


def test_quality_votes_against_plain_numpy(spark, docs, rows, nothing):
    random.seed(4)
    made = [(i, " ".join(random.choice(("good", "fine", "text")) if i % 3 else "$$$ 9" for _ in range(5 + i % 7)), int(i % 3 > 0)) for i in range(120)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, "x", "y") for i, _, q in made] + [(1, 0, "x", "y"), (1, 1, "x", "y"), (None, 1, "x", "y"), (2, None, "x", "y")], "doc_id long, quality int, text string, id string")
    model = quality.train(frame, labels)
    given = [t for _, t, _ in made] + [t for _, t in rows]
    vectors = quality.unit(quality.weighted(quality.features(pa.array(given, pa.string())), model["idf"], model["form"]) @ model["space"])
    every = vectors @ model["vectors"].T  # all pairs
    for t, near, got in zip(given, every, quality.vote(pa.array(given, pa.string()), model)):
        order = sorted(range(len(near)), key=lambda j: (-near[j], j))[: quality.NEIGHBOURS]
        weights = [max(float(near[j]), 0.0) ** 4 * float(model["weight"][j]) for j in order]
        whole = sum(w * float(model["votes"][j]) for w, j in zip(weights, order)) / max(sum(weights), 1e-12)
        assert got == pytest.approx(model["share"] if len((t or "").encode()) < 3 or sum(weights) <= 1e-12 else whole, abs=1e-4)
    assert len(model["votes"]) == len(made) + 2  # one text has three labels
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [1.0, 1.0, 1.0, 1.0, 1.0], [0.1, 0.2, 0.3, 0.4, 0.5]], np.float32)
    assert [sorted(x) for x in quality.nearest(near, 2).tolist()] == [[0, 1], [0, 1], [3, 4]]


def test_digest_of_whole_texts(docs, rows):
    found = {bytes(r.digest) for r in exact_dedup.text_digests(docs).collect()}
    assert found == {hashlib.sha256(lower(t).encode()).digest() for _, t in rows}
