"""Spelling variants, Merkle manifest and SimHash links against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from barspark.llm import merkle, simhash, spelling
from barspark.llm.common import Stage, numbered
from barspark.llm.queries import QUERIES, table, texts

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling


def one_apart(a, b):
    """Exactly one symbol inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_vocabulary(rows):
    seen = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            mark = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if mark % 97 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    cut = defaultdict(set)  # neighbours by what is left of them without one symbol
    for w in words:
        cut[w].add(w)
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add(w)
    near = {w: {v for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] for v in cut[k] if one_apart(w, v)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def variants_of(spark, rows, schema="doc_id long, text string"):
    found = spelling.variants(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len({r.word for r in found})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def test_op11_over_whole_table(spark):
    rows = [tuple(r) for r in texts(spark, SF).collect()]
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op11_spelling_variants"](spark, SF).collect()}
    assert found == brute_variants(brute_vocabulary(rows)) and any(f[0] for f in found.values())


@pytest.mark.parametrize("seed", range(3))
def test_near_words_of_a_dense_vocabulary(spark, seed, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 300)
    monkeypatch.setattr(spelling, "TILE", 120)  # groups are dealt into tiles of queries and words
    draw = random.Random(seed)
    words = {}
    while len(words) < 900:
        words["".join(draw.choice("abéÿ") for _ in range(draw.randrange(5, 10)))] = draw.randrange(3, 400)
    staged = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = spelling.near_words(staged, Stage(spark, "test")).collect()
    assert {(p.word, p.near, p.near_n) for p in pairs} == {(a, b, words[b]) for a in words for b in words if one_apart(a, b)}


def test_index_steps_like_a_scan():
    words = [b"banana", b"bandana", b"canal", b"ana", b"bananas"]
    index = spelling.Index(words)
    low, high = index.step(*(spelling.np.array([x]) for x in (ord("a"), 0, index.size)))
    assert high[0] - low[0] == b"".join(words).count(b"a")
    query, word = index.near([b"banana", b"banan"], spelling.np.array([3, 2]))
    assert sorted(zip(query.tolist(), word.tolist())) == [(0, 1)]
    query, word = index.near([b"bandana", b"xanana"], spelling.np.array([4, 3]))
    assert sorted(zip(query.tolist(), word.tolist())) == [(0, 0), (1, 0)]


def test_variants_of_odd_rows(spark):
    assert variants_of(spark, []) == {}
    long = "strange " * 40_000 + "strangee strangeé STRANGE" * 3
    rows = [(None, "Haus hausen"), (1, None), (1, ""), (2, long), (2, long), (None, "hausen hausen ×××××"), (3, "q" * 200_000), (3, "q" * 200_000 + " " + "q" * 199_999)]
    assert variants_of(spark, rows) == brute_variants(brute_vocabulary(rows))
    clash = spark.createDataFrame([(1, "words " * 5, 1, "x", 2)], "doc_id long, text string, n int, word string, id int")
    assert [r.word for r in spelling.variants(clash).collect()] == ["words"]


# Merkle


def brute_manifest(rows, changed):
    """Trees by sorting; ties of one id in order of the leaf. Proof, folded root per row."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def climb(nodes):
        """Levels of a tree."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in order}
    over = climb([trees[g][-1][0] for g in order]) if order else [[None]]
    out = []
    for k, g in enumerate(order):
        for i, row in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            other = leaf(changed(row))
            chain, node = [], other
            for levels, at in ((trees[g], i), (over, k)):
                for level in levels[:-1]:
                    run = at // 16 * 16
                    left, right = level[run:at], level[at + 1 : run + 16]
                    chain += left + right
                    node, at = h(*left, node, *right), at // 16
            out.append((row[0], leaf(row), trees[g][-1][0], over[-1][0], h(*chain), node, node == over[-1][0]))
    return sorted(out, key=str)


def changed_text(row):
    chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
    return (*row[:4], row[4].translate(LOWER)) if chosen and row[4] is not None else row


def manifest_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    made = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=(chosen, {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}))
    return made, sorted(((r.id, r.leaf, r.subroot, made.root, r.proof, r.folded, r.folded == made.root) for r in made.checks().collect()), key=str)


def test_op12_over_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect()), key=str)
    assert found == brute_manifest(rows, changed_text) and {f[-1] for f in found} == {True, False}


@pytest.mark.parametrize("ids", ["dense", "wide", "odd"])
def test_manifest_of_all_shapes(spark, ids):
    """Trees of one leaf, of full and of broken runs, beyond one slot array; ids far apart, below zero, repeated and null."""
    draw = random.Random(ids)
    rows = []
    for source, count in [(None, 3), ("a", 1), ("", 2), ("b", 16), ("c", 17), ("é", 257), ("hot", 4_700), *((f"s{i:02}", 1) for i in range(20))]:
        for i in range(count):
            id = {"dense": i, "wide": draw.randrange(-(1 << 62), 1 << 62), "odd": draw.choice([i, i - 40, None, 7])}[ids]
            text = draw.choice([None, "", "Text", f"Text {i}", "Été Z"])
            rows.append((id, source, draw.choice([None, "en"]), draw.choice([None, i]), text, "clash", 1))
    draw.shuffle(rows)
    made, found = manifest_of(spark, rows)
    want = brute_manifest([r[:5] for r in rows], changed_text)
    if ids != "odd":
        assert found == want
    else:  # equal rows are interchangeable: leaves and roots agree, proofs as a whole
        assert [f[:4] for f in found] == [w[:4] for w in want] and sorted(f[4] for f in found) == sorted(w[4] for w in want)
    for r in made.proofs().limit(50).collect():
        assert merkle.fold(r.leaf.encode(), r.chain.encode()).decode() == made.root
    assert {r.place for r in made.proofs().filter("`group` = 'hot'").select("place").collect()} == set(range(4_700))


def test_manifest_of_small_tables(spark):
    made, found = manifest_of(spark, [])
    assert made.root is None and found == []
    long = "A" * 300_000
    rows = [(1, "s", "en", 1, long, None, None)]
    made, found = manifest_of(spark, rows)
    assert found == brute_manifest([r[:5] for r in rows], changed_text) and found[0][1] == made.root


def test_numbered_gives_every_place_once(spark):
    rows = spark.range(5_000).withColumn("v", F.col("id") % 7)
    got = numbered(rows.repartition(5), Stage(spark, "test"), "place", "v", "id").collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.v, r.id))] == list(range(5_000))


# SimHash


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    marks = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def brute_links(prints, distance):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    some = sorted(root)
    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {p: find(p) for p in some}


def brute_near(rows, distance=4):
    prints = [(id, brute_print(text)) for id, text in rows]
    root = brute_links({p for _, p in prints}, distance)
    least = {}
    for id, p in prints:
        if id is not None:
            least[root[p]] = min(id, least.get(root[p], id))
    return sorted(((id, f"{p:016x}", least.get(root[p])) for id, p in prints), key=str)


def near_of(spark, rows):
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int, root int")).collect()
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found), key=str)


def test_op13_over_whole_table(spark):
    rows = [tuple(r) for r in texts(spark, SF).collect()]
    found = sorted((tuple(r) for r in QUERIES["op13_simhash"](spark, SF).collect()), key=str)
    assert found == brute_near(rows) and len({f[2] for f in found}) < len(found)


@pytest.mark.parametrize("distance", [2, 3, 4, 7])
@pytest.mark.parametrize("tile", [40, 2048])
def test_links_between_crowded_prints(spark, distance, tile, monkeypatch):
    """Prints within some flips of few centres: most share segments, many are linked over others only."""
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(distance)
    centres = [draw.getrandbits(64) for _ in range(6)]
    prints = set()
    for _ in range(700):
        p = draw.choice(centres)
        for bit in draw.sample(range(64), draw.randrange(9)):
            p ^= 1 << bit
        prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    stage = Stage(spark, "test")
    found = simhash.links(spark.createDataFrame(signed, "fp long"), distance, stage).collect()
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in found]
    assert all((a ^ b).bit_count() <= distance for a, b in pairs)
    joined = {p: p for p in prints}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        joined[high] = low
    assert {p: find(p) for p in prints} == brute_links(prints, distance)


def test_simhash_of_odd_rows(spark):
    assert near_of(spark, []) == []
    long = " ".join(f"W{i % 977}\t" for i in range(300_000))
    rows = [(5, None), (3, ""), (None, " \n"), (4, "one"), (None, "one"), (9, "ONE"), (1, long), (2, long + " more"), (2, long), (None, "lonely words only here"), (8, "Été à b")]
    assert near_of(spark, [(*r, 1, 2) for r in rows]) == brute_near(rows)
    with pytest.raises(ValueError):
        simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), distance=1)
