"""Operators over the whole corpus, compared with brute force on small tables."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from sensorloom.llm import cap_filters, mixing, spans, weighted_minhash, words  # noqa: E402
from sensorloom.llm.components import components, joined_components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOCS)


def groups_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == groups_of([x for x in links if x[0] != x[1]], {n for x in links if x[0] != x[1] for n in x})


def test_more_links_join_components(spark):
    first, more = [(1, 2), (3, 4), (5, 6), (20, 21)], [(2, 4), (7, 6), (30, 31)]
    groups = components(spark.createDataFrame(first, "u long, v long"))
    got = {r["node"]: r["component"] for r in joined_components(groups, spark.createDataFrame(more, "u long, v long")).collect()}
    assert got == groups_of(first + more, {n for x in first + more for n in x})
    assert joined_components(groups, spark.createDataFrame([], "u long, v long")).count() == 8


# --- embeddings ---

def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 16)  # several blocks for a group
    rng = np.random.default_rng(2)
    data = rng.normal(size=(120, 24))
    near = data[:40] + rng.normal(size=(40, 24)) * 0.03
    group = data[50] + rng.normal(size=(60, 24)) * 0.12
    vectors = np.concatenate([data, near, group, data[:5], data[5:8] * 3])
    labels = [int(x) for x in np.concatenate([np.arange(120) % 3, np.arange(40) % 3, np.full(60, 50 % 3), np.arange(5) % 3, [5 % 3, 6 % 3, 8 % 3]])]
    frame = spark.createDataFrame([(i, v.tolist(), labels[i]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T
    links = [(i, j) for i in range(len(unit)) for j in range(i) if labels[i] == labels[j] and cosine[i, j] >= 0.98]
    assert not any(abs(cosine[i, j] - 0.98) < 1e-9 for i in range(len(unit)) for j in range(i))
    number = Counter(x for pair in links for x in pair)
    group_of = groups_of(links, range(len(unit)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cap_filters.near_embeddings(frame).collect()}
    assert got == {i: (number[i], group_of[i], group_of[i] == i) for i in range(len(unit))}


def listed(vectors, *code, **options):
    rows, filters = cap_filters.decode(vectors, *code, **options)
    assert (np.diff(rows) >= 0).all()
    return np.split(filters, np.searchsorted(rows, np.arange(1, len(vectors))))


@pytest.mark.parametrize("size,n", [(64, 1500), (256, 1500), (1024, 1000), (4096, 400)])
def test_close_vectors_share_a_filter(size, n):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    shared = np.zeros(len(x), bool)
    for number in range(cap_filters.CODES):
        for k, (a, b) in enumerate(zip(listed(x, size, number, 1), listed(y, size, number, 1))):
            shared[k] |= bool(len(np.intersect1d(a, b)))
    assert shared.mean() >= 0.999


def test_filters_are_all_beyond_the_limit():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, first, second = cap_filters.code(10, 32, 0, 1)
    sums = ((x @ rotation)[:, :5] @ first.T)[:, :, None] + ((x @ rotation)[:, 5:] @ second.T)[:, None, :]
    for top in (32, 6, 3):  # few words at first: the rest are listed again from all
        for row, found in zip(sums.reshape(20, -1), listed(x, 32, 0, 1, top=top)):
            assert len(found) >= cap_filters.LEAST_FILTERS
            assert set(found) == set(np.flatnonzero(row >= row[found].min()))


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        cap_filters.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), threshold=0.9)
    with pytest.raises(ValueError):
        weighted_minhash.near_texts(spark.createDataFrame([], DOCS), threshold=0.6)


# --- words ---

def test_words_are_those_of_a_plain_split():
    rng = random.Random(3)
    texts = ["".join(rng.choice(" ab\n\t\r\x0b\x0c\u00a0é日") for _ in range(rng.randrange(60))).encode() for _ in range(400)] + [b"", b"x" * 3000]
    found = words.Words(texts)
    names = {}
    for i, text in enumerate(texts):
        hashes = found.hashes[found.upto[i]:found.upto[i + 1]].tolist()
        assert len(hashes) == len(text.split())
        for word, h in zip(text.split(), hashes):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_word_hashes_do_not_depend_on_their_place(monkeypatch):
    texts = [b" ".join(b"w%d" % (i % 50) for i in range(500))]
    expected = words.Words(texts).hashes
    monkeypatch.setattr(words, "STRIDE", 37)
    assert (words.Words(texts).hashes == expected).all() and len(set(expected.tolist())) == 50


def test_shingle_sets():
    texts = ["a b c d e f a b c d e", "", "a b", "a b", " ", "a b c d e"]
    hashes, counts, offsets = words.shingle_sets([t.encode() for t in texts], 5)
    assert np.diff(offsets).tolist() == [6, 0, 1, 1, 0, 1]
    assert sorted(counts[:6].tolist()) == [1, 1, 1, 1, 1, 2]
    assert hashes[6] == hashes[7] and hashes[8] == hashes[:6][counts[:6] == 2][0]


# --- near texts ---

def plain_weights(texts, strength=weighted_minhash.STRENGTH, share=weighted_minhash.SHARE):
    sets = []
    for t in texts:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(g for s in sets for g in s)
    n = len(texts)

    def weight(g):
        if df[g] < max(share * n, 2):
            return 1 + strength
        return 1 + strength * min(max(math.log(n / df[g]) / math.log(1 / share), 0), 1)

    return [{g: k * weight(g) for g, k in s.items()} for s in sets]


def plain_similarity(a, b):
    least = sum(min(w, b[g]) for g, w in a.items() if g in b)
    total = sum(a.values()) + sum(b.values()) - least
    return least / total if total else 0.0


def near_corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [prose(rng.randrange(30, 200)) for _ in range(120)]
    passage = prose(60)
    texts += [passage + prose(rng.randrange(10, 120)) for _ in range(60)]  # a shared passage
    base = prose(150)
    for _ in range(80):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    for i in range(40):  # pairs of all grades
        copy = list(texts[i])
        for _ in range(rng.randrange(1, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    return texts + texts[:10] + ["", None, "", "one two", "One  TWO", "a b c d e"]


def test_near_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(weighted_minhash, "STAR_CELL", 8)
    monkeypatch.setattr(weighted_minhash, "TEXT_BLOCK", 8)
    monkeypatch.setattr(weighted_minhash, "SAMPLE_BLOCK", 16)
    texts = near_corpus()
    weights = plain_weights(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(weights[i], weights[j]) >= 0.8 or texts[i] and texts[i] == texts[j]]
    expected = groups_of(links, range(len(texts)))
    frame = docs(spark, texts).repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_texts(frame).collect()}
    blank = [i for i, t in enumerate(texts) if not t]
    assert {i: c for i, c in got.items() if i not in blank} == {i: c for i, c in expected.items() if i not in blank}
    assert {got[i] for i in blank} == {min(blank)}
    kept = weighted_minhash.near_duplicates_removed(frame).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values()))
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_samples_estimate_the_similarity():
    rng = np.random.default_rng(1)
    equal, expected = [], []
    for _ in range(60):
        shared, own = rng.integers(0, 1 << 63, 80, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        a = np.sort(np.concatenate([shared, own[:20]]))
        b = np.sort(np.concatenate([shared, own[20:]]))
        weights = {int(s): float(w) for s, w in zip(np.concatenate([shared, own]), rng.choice([1.25, 1.25, 1.1, 2.5], 120))}
        wa, wb = (np.array([weights[int(s)] for s in x]) for x in (a, b))
        wb = wb * rng.choice([1, 1, 2], len(wb))
        expected.append(weighted_minhash.similarity((a, wa), (b, wb)))
        both = np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a), len(a) + len(b)])
        x, y = weighted_minhash.samples(*both, 1.25, 3)
        equal.append(float((x == y).mean()))
    assert abs(np.mean(equal) - np.mean(expected)) < 0.03


def test_a_cover_touches_every_candidate():
    rng = np.random.default_rng(8)
    for _ in range(50):
        near = rng.random((12, 12)) < 0.15
        near |= near.T
        np.fill_diagonal(near, False)
        pairs = weighted_minhash.cover(near)
        assert all(near[x, y] for x, y in pairs)
        assert {x for p in pairs for x in p} == set(np.flatnonzero(near.any(1)).tolist())


def test_every_shingle_weighs_by_its_own_number_of_documents(spark, monkeypatch):
    monkeypatch.setattr(weighted_minhash, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(weighted_minhash, "RANGE_BYTES", 30_000)
    texts = near_corpus(seed=6)
    sets = [Counter(words.shingle_sets([(t or "").lower().encode()], 5)[0].tolist()) for t in texts]
    df = Counter(g for s in sets for g in s)
    frame = weighted_minhash.texts_of(docs(spark, texts).repartition(3), "doc_id", "text")
    marks = weighted_minhash.signatures(frame, weighted_minhash.Weights(len(texts), 0.25), 5).collect()
    assert len(marks) == len(texts)
    for row in marks:
        own = sorted(sets[row["doc"]])
        assert weighted_minhash.unpacked(row["dfs"] or b"", len(own)).tolist() == [df[g] for g in own]
    assert len({w for w in weighted_minhash.Weights(len(texts), 0.25).of(np.arange(1, 317), np.ones(316))}) == 316
    # The whole query against all pairs, with weights of the plain version that are bounded by no share.
    weights = plain_weights(texts, share=1 / len(texts))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if plain_similarity(weights[i], weights[j]) >= 0.8 or texts[i] and texts[i] == texts[j]]
    expected = groups_of(links, range(len(texts)))
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_texts(docs(spark, texts), share=None).collect()}
    assert all(got[i] == expected[i] for i, t in enumerate(texts) if t)


def test_frequent_shingles_are_counted_exactly(spark):
    texts = near_corpus()
    total, frequent = weighted_minhash.document_frequencies(weighted_minhash.texts_of(docs(spark, texts).repartition(4), "doc_id", "text"))
    df = Counter()
    for t in texts:
        df.update(words.shingle_sets([(t or "").lower().encode()], 5)[0].view(np.int64).tolist())
    assert total == len(texts)
    assert frequent == {h: n for h, n in df.items() if n >= max(weighted_minhash.SHARE * total, 2)}


# --- mixing ---

def plain_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(9)
    texts = [" ".join(f"x{rng.randrange(999)}" for _ in range(rng.choice([0, 3, 50, 400, 3000]))) for _ in range(300)] + [None, "  "]
    sources = [rng.choice(["a", "a", "a", "B", "é", "zz", None, "rare" if rng.random() < 0.1 else "b"]) for _ in texts]
    return texts, sources, docs(spark, texts, sources)


def test_mix_meets_targets_and_limits(mixed):
    texts, sources, frame = mixed
    rows = mixing.contributions(frame, block_words=64, slots_per_shard=50).collect()
    again = mixing.contributions(frame.repartition(3), block_words=64, slots_per_shard=50).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(WORD.findall(t or ""))
    expected, taken = plain_targets(dict(sizes)), defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or ""))
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(texts)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 64 + 0.01 * expected[s]


def test_mix_takes_every_block_once_before_any_twice(mixed):
    _, _, frame = mixed
    placed, pieces, slots = mixing.mix_sources(frame, block_words=64, slots_per_shard=50)
    rows = slots.collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["slot"]):
        by[r["source_no"]].append((r["slot"], r["block"]))
    sizes = {r["source_no"]: r["source_size"] for r in placed.select("source_no", "source_size").distinct().collect()}
    for source, found in by.items():
        n = -(-sizes[source] // 64)
        assert [s for s, _ in found] == list(range(len(found)))
        assert len({b for _, b in found[:n]}) == min(n, len(found)) and len({b for _, b in found[n:]}) == max(0, len(found) - n)
    assert max(Counter(r["shard"] for r in rows).values()) <= 1.5 * 50
    covered = pieces.groupBy("source_no", "start").sum("n_words").count()
    assert covered > 0


def test_permutation_is_one():
    for size in (1, 2, 3, 17, 64, 1000):
        for key in (1, 99):
            got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(got) == list(range(size))


def test_cut_texts():
    text = "a  b\nc d\te f".encode()
    assert spans.cut(text, [(0, 6)]) == text
    assert spans.cut(text, [(1, 2)]) == b"b\nc"
    assert spans.cut(text, [(4, 2), (0, 1), (1, 1)]) == b"a  b\ne f"


def test_rows_of_one_id_and_text_in_two_sources_stay_apart(spark):
    text = " ".join(f"w{i}" for i in range(600))
    rows = [(1, text, "en", "A", 7), (1, text, "de", "B", 8), (1, text, "de", "B", 8), (2, text + " more", "fr", "C", None)]
    frame = spark.createDataFrame(rows, DOCS)
    placed, taken, _ = mixing.mix_sources(frame, block_words=32)
    out = spans.taken_texts(frame, placed, taken).collect()
    wanted = defaultdict(int)
    for r in taken.collect():
        wanted[r["source_no"]] += r["n_words"] * r["times"]
    got = defaultdict(int)
    for r in out:
        assert (r["doc_id"], r["lang"], r["source"], r["n_chars"]) in {(1, "en", "A", 7), (1, "de", "B", 8), (2, "fr", "C", None)}
        got["ABC".index(r["source"])] += len(WORD.findall(r["text"]))
    assert got == wanted and set(got) == {0, 1, 2}


def test_hash_of_rows_tells_nulls_and_all_columns_apart(spark):
    frame = spark.createDataFrame([("a", None, None), (None, "a", None), ("a", "", None), ("a", None, {"k": "v"}), ("a", None, None)], "x string, y string, m map<string,string>")
    assert frame.select(mixing.row_hash(frame).alias("h")).distinct().count() == 4


# --- pipeline ---

@pytest.mark.parametrize("name", ["empty", "edge"])
def test_stages_take_empty_tables_and_odd_rows(spark, name):
    import corpus_pipeline

    text = " ".join(f"v{i}" for i in range(50))
    rows = [] if name == "empty" else [
        (1, text, "en", None, 1), (1, text, "en", None, 1), (None, text + " x", None, "s", None), (2, None, None, None, None), (3, "", "en", "s", 0),
        (4, " ".join(f"long{i}" for i in range(60_000)), "en", "s", 5), (5, "\n\n", "en", "t", 2)]
    frame = spark.createDataFrame(rows, DOCS)
    out = frame
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = spark.createDataFrame(stage(spark, out, "").collect(), stage(spark, out, "").schema)
        assert out.count() == 0 if name == "empty" else out.count() >= 2
        assert number == 4 or out.columns == frame.columns
    if name == "edge":
        assert max(r["n_tokens"] for r in out.collect()) > 60_000



def test_pipeline_equals_its_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    shared = " ".join(f"b{i}" for i in range(30))
    texts = [" ".join(f"v{rng.randrange(5000)}" for _ in range(200)) + (f"\n{shared}" if i < 12 else "") for i in range(40)]
    texts += [texts[0], texts[20] + " more", "too short", None, "", "again and again so " * 30]
    docs(spark, texts, [f"s{i % 4}" for i in range(len(texts))]).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    frame = spark.read.parquet(os.path.join(tmp_path, "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "piece_encoding"]
    clean = corpus_pipeline.quality_stage(spark, frame, "")
    assert {r["doc_id"] for r in clean.collect()} == set(range(42))  # the same verdict as the query's
    lines = corpus_pipeline.line_stage(spark, clean, "")
    texts_now = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert texts_now[3] == texts[3].split("\n")[0] and texts_now[30] == texts[30]
    once = corpus_pipeline.near_stage(spark, lines, "")
    assert {r["doc_id"] for r in once.collect()} == set(range(40))
    mix = corpus_pipeline.mixing_stage(spark, once, "")
    assert mix.columns == lines.columns == once.columns == frame.columns
    rows = mix.collect()
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    for r in rows:
        assert not Counter(WORD.findall(r["text"])) - Counter(WORD.findall(texts_now[r["doc_id"]]))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == len(rows) and {"doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in out.collect())
