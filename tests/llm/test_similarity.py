"""N-gram Jaccard join, chunk deduplication and decontamination against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barspark.llm import chunk_dedup, decontaminate, ngram_join
from barspark.llm.queries import QUERIES, table, texts

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gram_set(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, size, percent):
    """Every pair compared; union-find over ids."""
    sets = {i: gram_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, count=160, sizes=(1, 2, 4, 5, 7, 9, 14, 30, 60, 150)):
    draw = random.Random(seed)
    out = []
    for i in range(count):
        if out and draw.random() < 0.7:
            words = draw.choice(out)[1].split()
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                if words:
                    k = draw.randrange(len(words))
                    words[k : k + draw.choice([0, 1])] = [f"w{draw.randrange(9)}"] * draw.choice([0, 1])
        else:
            words = [f"w{draw.randrange(40)}" for _ in range(draw.choice(sizes))]
        out.append((i, draw.choice([" ", "  ", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("size,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_components_equal_brute_force(spark, size, percent, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df, size=size, percent=percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_large_star_is_dealt_in_squares(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SQUARE", 7)
    draw = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(draw.randrange(6)):
            words[draw.randrange(120)] = f"x{i}{draw.randrange(99)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df, size=4, percent=85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_a_square_gives_a_forest_not_its_pairs():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 1000).astype(np.uint64)
    rows = []
    for i in range(90):  # 50 near copies of one set, 40 that share half of it with nobody else's half
        own = base.copy()
        own[: 10 if i < 50 else 500] = draw.integers(0, 2**63, 10 if i < 50 else 500).astype(np.uint64)
        own = np.unique(own)
        bits = ngram_join.bitmap(own, ngram_join.width(800))
        rows.append({"star": 1, "i": 0, "j": 0, "side": 0, "id": i, "root": i, "n": len(own), "bits": bits, "grams": own.tobytes()})
    found = ngram_join._joined(rows, 80)
    assert len(found) == 49 and {x for r in found for x in (r["a"], r["b"])} == set(range(50))
    assert {r["id"] for r in ngram_join._open(rows, 80)} >= set(range(50))
    one = [{**r, "root": 0} for r in rows[:50]]
    assert ngram_join._joined(one, 80) == [] and ngram_join._open(one, 80) == []
    assert len(ngram_join._joined([{**r, "root": r["id"] % 5} for r in rows[:50]], 80)) == 4


def test_every_linked_pair_shares_a_tile():
    import numpy as np

    draw = np.random.default_rng(1)
    table_ = ngram_join.bands(80)
    for n in [6, 7, 9, 13, 20, 41, 100, 333, 1000]:
        for _ in range(30):
            a = draw.integers(0, 1 << 63, n).astype(np.uint64)
            most = 20 * n // 80
            b = np.concatenate([a, draw.integers(0, 1 << 63, draw.integers(0, most + 1)).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            at = ngram_join.band_of(len(a), 80)
            assert set(table_[at].get().tiles(a).tolist()) & set(table_[at].get().tiles(b).tolist())


def test_bitmap_bounds_from_above():
    import numpy as np

    draw = np.random.default_rng(2)
    for n, m, shared in [(50, 60, 40), (700, 640, 500), (5, 5, 0)]:
        a = draw.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[:shared], draw.integers(0, 1 << 63, m - shared).astype(np.uint64)])
        for wide, slim in [(1024, 1024), (1024, 512), (64, 128)]:
            assert ngram_join.at_most(n, ngram_join.bitmap(a, wide), m, ngram_join.bitmap(b, slim)) >= shared


def test_join_edge_cases(spark):
    rows = [(1, "a b c d e f", 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, "A  b\tC d e f", 9), (4, "A  b\tC d e f", 9), (5, "one", 9), (6, "one", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(df, size=4, percent=85).collect())
    assert got == [(1, 3, 1), (2, 0, 2), (3, 0, 3), (3, 0, 3), (4, 3, 1), (4, 3, 1), (5, 1, 5), (6, 1, 5)]
    assert ngram_join.similarity_components(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in ngram_join.deduplicate(df, size=4, percent=85).collect()) == [1, 2, 3, 3, 5]


def test_join_by_rows_not_ids(spark):
    """Null and repeated ids lose no link, and one row of each component stays."""
    t, more, other = "a b c d e f g h i j k l m n o", "a b c d e f g h i j k l m n o p", "quite another text of some words"
    links = lambda rows: sorted(((r.doc_id, r.component_id) for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()), key=str)
    assert links([(None, t), (7, more)]) == [(7, 7), (None, 7)]
    assert links([(8, other), (8, t), (7, more)]) == [(7, 7), (8, 7), (8, 8)]
    assert links([(None, t), (None, more), (None, "")]) == [(None, None)] * 3
    rows = [(1, t, "x"), (2, t, "x"), (None, t, "x"), (None, t, "x"), (1, t, "y"), (1, other, "z"), (None, None, "e"), (None, "", "e"), (5, "", "e"), (5, "", "e")]
    kept = ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, mark string"), size=4, percent=85).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, t), (1, other), (None, None), (None, ""), (5, ""), (5, "")], key=str)
    nulls = ngram_join.deduplicate(spark.createDataFrame([(None, t), (None, more), (None, other)], "doc_id long, text string")).collect()
    assert len(nulls) == 2


def test_op6_over_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in texts(spark, SF).collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_ngram_join"](spark, SF).collect()}
    assert got == brute_components(rows, 4, 85)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_contamination(docs, items, window):
    out = []
    for i, text in docs:
        words, hit, met = words_of(text), set(), set()
        for item, own in items:
            own = words_of(own)
            length = min(window, len(own))
            wins = {tuple(own[s : s + length]) for s in range(len(own) - length + 1)} if length else set()
            for s in range(len(words) - length + 1):
                if length and tuple(words[s : s + length]) in wins:
                    hit.update(range(s, s + length))
                    met.add(str(item))
        out.append((i, len(words), len(hit), sorted(met)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    draw = random.Random(7)

    def some(n, of):
        return [f"v{draw.randrange(of)}" for _ in range(n)]

    items = [(k, " ".join(some(draw.choice([1, 2, 3, 4, 5, 6, 13, 20]), 400))) for k in range(20)] + [(20, None), (21, "--"), (22, "V1 v1 v1 v1 v1 v1 v1")]
    items.append((23, items[0][1]))
    docs = []
    for k in range(60):
        words = some(draw.choice([0, 1, 3, 30, 80]), 400)
        for _ in range(draw.randrange(3)):
            own = draw.choice(items)[1] or ""
            at = draw.randrange(len(words) + 1)
            words[at:at] = own.upper().split()
        docs.append((k, ", ".join(words)))
    docs += [(90, None), (91, ""), (92, "v1 " * 30), (92, "v1 " * 30)]
    left = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(a, b, 5) for a, b in items], "item_id int, text string, doc_id int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(left, right).collect()), key=str)
    assert got == brute_contamination(docs, items, 13)
    assert decontaminate.contamination(left.limit(0), right).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(left, right.limit(0)).collect()} == {0}


def test_op9_over_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in texts(spark, SF).collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = {r.doc_id: r for r in QUERIES["op9_decontaminate"](spark, SF).collect()}
    for i, n, hit, met in brute_contamination(docs, items, 13):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(met))
        assert r.items_sha256 == hashlib.sha256(",".join(met).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def brute_repeats(rows, length=51):
    """Words in runs of ``length`` words that stand at two places."""
    first, out = {}, defaultdict(set)
    for i, text in rows:
        words = (text or "").encode().lower().split()
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if key in first:
                for j, t in ((i, s), first[key]):
                    out[j].update(range(t, t + length))
            else:
                first[key] = (i, s)
    return out


def test_shared_passages_are_found_and_others_left_alone(spark):
    draw = random.Random(11)

    def fresh(n):
        return [f"{draw.getrandbits(40):x}" for _ in range(n)]

    shared = [fresh(60), fresh(90)]
    rows = []
    for k in range(60):
        words = fresh(draw.randrange(20, 300))
        if k % 3 == 0:
            at = draw.randrange(len(words))
            words[at:at] = shared[k % 2]
        elif k % 3 == 1:
            words[5:5] = shared[0][:12]  # too short to count
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int")
    got = {r.doc_id: r for r in chunk_dedup.repeated_passages(df).collect()}
    truth = brute_repeats(rows)
    assert {i for i, r in got.items() if r.repeated_words} == set(truth) == {k for k in range(60) if k % 3 == 0}
    kept = Counter(k % 2 for k in range(0, 60, 3) if not got[k].removed_words)
    assert kept == {0: 1, 1: 1} and not got[0].removed_words  # the first document of each passage keeps it
    for i, words in truth.items():
        covered = {w for p in got[i].passages for w in range(p.first, p.stop)}
        assert covered <= words and len(words - covered) <= 40


def test_chunks_resist_insertions():
    import numpy as np

    draw = np.random.default_rng(3)
    words = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    longer = np.concatenate([words[:100], draw.integers(0, 1 << 63, 3).astype(np.uint64), words[100:]])
    cuts = chunk_dedup.chunk_ends(words, np.array([0, 400]))
    moved = chunk_dedup.chunk_ends(longer, np.array([0, 403]))
    far = cuts[cuts > 100 + 40]
    assert set((far + 3).tolist()) <= set(moved.tolist()) and set(cuts[cuts < 90].tolist()) <= set(moved.tolist())
    assert np.diff(np.append(0, cuts)).max() <= chunk_dedup.LONGEST and cuts[-1] == 400


def test_chunk_edge_cases(spark):
    same = " ".join(f"s{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, "one two"), (4, same), (5, same), (5, same), (6, same.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.repeated_words, r.removed_words) for r in chunk_dedup.repeated_passages(df).collect())
    assert got == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 2, 0, 0), (4, 80, 80, 0), (5, 80, 80, 80), (5, 80, 80, 80), (6, 80, 80, 80)]
    assert chunk_dedup.repeated_passages(df.limit(0)).count() == 0
    shorter = sorted((r.doc_id, r.text) for r in chunk_dedup.remove_repeats(df.filter("text is not null")).collect())
    assert shorter == [(2, ""), (3, "one two"), (4, same), (5, ""), (5, ""), (6, "")]


def test_words_are_cut_with_the_space_after_them():
    assert chunk_dedup.without_words(" é b\tc  d\n", [(1, 2), (3, 4)]) == " é c  "


def test_op8_over_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in texts(spark, SF).collect()]
    got = {r.doc_id: r for r in QUERIES["op8_chunk_dedup"](spark, SF).collect()}
    truth = brute_repeats(rows)
    assert got.keys() == {i for i, _ in rows} and all(got[i].repeated for i in truth)
    covered = sum(len(truth[i] & {w for p in got[i].passages.split(",") for w in range(*map(int, p.split(":")))}) for i in truth)
    assert covered >= 0.9 * sum(map(len, truth.values()))
    assert math.isclose(sum(r.n_words for r in got.values()), sum(len((t or "").split()) for _, t in rows), rel_tol=0.01)
