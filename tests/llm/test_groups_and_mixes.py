"""Near-duplicates, mixing and sharding against brute force."""

import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import mixing, sharding, simhash
from tidegauge.llm.components import star_components


def _brute_fingerprint(text, shingle=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps, d):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    nodes = list(parent)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= d:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_near_duplicates_by_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.limit(400).collect()}
    fps = {i: _brute_fingerprint(t) for i, t in texts.items()}
    roots = _components(set(fps.values()), 2)
    least = defaultdict(lambda: 10**18)
    for i, f in fps.items():
        least[roots[f]] = min(least[roots[f]], i)
    got = simhash.near_duplicates(documents.where(F.col("doc_id").isin(list(texts)))).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("d", [0, 1, 2, 3])
@pytest.mark.parametrize("group_rows", [1, 3, 1000])
def test_links_of_crowded_fingerprints(spark, d, group_rows):
    rng = random.Random(d)
    fps = set()
    for centre in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    fps |= {rng.getrandbits(64) for _ in range(30)}
    signed = {simhash._signed(f): f for f in fps}
    links = simhash.hamming_links(spark.createDataFrame([(s,) for s in signed], "fp long"), d, group_rows)
    labels = {r.node: r.label for r in star_components(links).collect()}
    want = _components(fps, d)
    parts = lambda label: Counter(frozenset(g) for g in _groups(label).values())
    assert parts({f: labels.get(s, s) for s, f in signed.items()}) == parts(want)


def _groups(label):
    out = defaultdict(set)
    for node, root in label.items():
        out[root].add(node)
    return out


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.label for r in star_components(edges).collect()} == {0}
    assert star_components(edges.where("a < 0")).collect() == []


def test_near_duplicates_awkward(awkward, empty):
    got = simhash.near_duplicates(awkward)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"] and got.count() == awkward.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[2].component_id == 1 and by[3].fingerprint == "0" * 16
    assert by[5].component_id == by[3].component_id == 3
    assert by[20].fingerprint == f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert simhash.near_duplicates(empty).collect() == []


def _brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left, w = total - 3 * sum(sizes[s] for s in capped), sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] * w < left * weight[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        capped |= over


def test_source_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i:02d}" if i else None: rng.choice([0, 1, 5, 1000, rng.randrange(100_000)]) for i in range(n)}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        have = {r.source: r.target for r in got.collect()}
        assert have == pytest.approx(_brute_targets(sizes))


def test_mix_comes_near_its_targets(spark, documents):
    got = mixing.mix(documents)
    rows = got.join(documents.select("doc_id", "source"), "doc_id").collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        spare = [r.size for r in own if r.copies * r.size < r.target / max(1, r.source_size) * r.size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max([r.size for r in own if r.size] + spare) / 2
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(documents.repartition(13)).collect()))


def test_mix_with_a_third_of_all_rows_repeated(spark):
    rows = [(7, "a b c d e", "hot")] * 300 + [(i, "x " * (i % 9), f"s{i % 5}") for i in range(100, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    hot = [r for r in got if r.doc_id == 7]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 5 and {r.size for r in hot} == {5}


def _one_source_and_another(spark, rows):
    """The rows as a source of which the mix wants only a part: another one takes most."""
    return spark.createDataFrame([(i, t, "a") for i, t in rows] + [(-1, "y " * 600, "b")], "doc_id long, text string, source string")


@pytest.mark.parametrize("own", [None, 5])
def test_rows_that_share_an_id_or_have_none_are_drawn_each_for_itself(spark, own):
    rows = [(own, f"w{i} b c d e") for i in range(400)] + [(own, "x " * 2_000)]
    got = [r for r in mixing.mix(_one_source_and_another(spark, rows)).collect() if r.source_size == 4_000]
    assert len(got) == 401 and got[0].target < 4_000
    assert abs(sum(r.taken for r in got) - got[0].target) <= 5
    assert len({r.copies for r in got if r.size == 5}) == 2


def test_equal_ranks_of_different_sizes_are_ordered_by_size(spark):
    rows = spark.createDataFrame([("a", 7, s) for s in (4, 4, 9, 2)] + [("a", 9, 5)], "source string, rank long, size long")
    for want, full, last in ((11.0, {2: 1, 4: 2, 9: 0}, None), (6.5, {2: 1, 4: 1, 9: 0}, None), (15.0, {2: 1, 4: 2, 9: 0}, (9, 5)), (8.5, {2: 1, 4: 1, 9: 0}, (7, 4))):
        cuts = spark.createDataFrame([("a", want, 7, 0)], "source string, want double, prefix long, done long")
        got = mixing._last_places(rows, cuts).first()
        assert {t.size: t.full for t in got.ties} == full
        assert (got.last and (got.last["rank"], got.last["size"])) == last


def test_inclusion_is_in_proportion_to_size_and_certain_ones_come_first(spark):
    sizes = [1, 2, 2, 3, 5, 8, 13, 40, 90]
    for want in (10.0, 60.0, 100.0, 150.0, 164.0):
        narrow = spark.createDataFrame([("a", s) for s in sizes], "source string, size long")
        r = mixing.inclusion_plan(narrow, spark.createDataFrame([("a", want)], "source string, want double")).first()
        sure: set[int] = set()
        while True:  # by the book: take what is above one, share the rest again
            rest = [s for i, s in enumerate(sizes) if i not in sure]
            each = (want - sum(sizes[i] for i in sure)) / sum(s * s for s in rest) if rest else 0
            more = {i for i, s in enumerate(sizes) if i not in sure and each * s >= 1}
            if not more:
                break
            sure |= more
        assert r.certain == min((sizes[i] for i in sure), default=None)
        assert (r.per_word or 0) == pytest.approx(each) and r.left == pytest.approx(want - sum(sizes[i] for i in sure))


def test_large_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * (30 if i % 2 else 3)) for i in range(2_000)]
    got = [r for r in mixing.mix(_one_source_and_another(spark, rows)).collect() if r.source_size == 33_000]
    large, small = ([r.copies for r in got if r.size == s] for s in (30, 3))
    assert got[0].inclusion != got[1].inclusion and abs(sum(r.taken for r in got) - got[0].target) <= 3
    for copies, size in ((large, 30), (small, 3)):
        pi = next(r.inclusion for r in got if r.size == size)
        assert abs(sum(copies) - 1_000 * pi) < 4 * (1_000 * pi * (1 - pi)) ** 0.5 + 1


def test_mix_awkward(awkward, empty):
    got = mixing.mix(awkward)
    assert got.columns == ["doc_id", "size", "source_size", "target", "copies", "taken", "inclusion"] and got.count() == awkward.count()
    assert {r.size for r in got.where("doc_id in (3, 4, 5)").collect()} == {0}
    kept = mixing.mix(awkward, keep=awkward.columns)
    assert "size" in kept.columns and kept.count() == awkward.count()
    assert mixing.mix(empty).collect() == []


def _brute_shards(rows, limit):
    out, todo = {}, [("", rows)]
    while todo:
        bits, part = todo.pop()
        if sum(n for _, n in part) <= limit or len({h for h, _ in part}) <= 1:
            out[bits] = part
            continue
        for b in "01":
            todo.append((bits + b, [(h, n) for h, n in part if f"{h:060b}"[len(bits)] == b]))
    return out


@pytest.mark.parametrize("limit", [1, 3_000, 60_000, 10**9])
def test_shards_by_brute_force(documents, limit):
    docs = documents.limit(300)
    hashed = docs.select("doc_id", sharding.row_hash("doc_id", "text").alias("h"), F.octet_length("text").cast("long").alias("n"))
    rows = {r.doc_id: (r.h, r.n) for r in hashed.collect()}
    want = _brute_shards(list(rows.values()), limit)
    got = sharding.shard(docs, limit=limit).collect()
    bytes_of = {f"b{bits}": sum(n for _, n in part) for bits, part in want.items()}
    place = {h: f"b{bits}" for bits, part in want.items() for h, _ in part}
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.shard_bytes, r.depth) == (place[rows[r.doc_id][0]], bytes_of[r.shard], len(r.shard) - 1)


def test_repeated_rows_fill_overflow_shards(spark):
    rows = [(1, "abcde")] * 50 + [(i, "xyz") for i in range(2, 40)] + [(99, "w" * 100)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=40).collect()
    assert len(got) == len(rows)
    sums = Counter()
    for r in got:
        sums[r.shard] += r.n_bytes
    assert all(sums[r.shard] == r.shard_bytes for r in got)
    assert all(n <= 40 for s, n in sums.items() if s not in {r.shard for r in got if r.doc_id == 99})
    assert {r.shard_bytes for r in got if r.doc_id == 1} == {40, 10}


def test_shards_awkward(awkward, empty, tmp_path):
    got = sharding.shard(awkward, keep=awkward.columns, limit=100)
    assert got.count() == awkward.count() and got.columns.count("shard") == 1
    sharding.write_shards(got, str(tmp_path / "out"))
    back = awkward.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == awkward.count() and back.select("shard").distinct().count() == got.select("shard").distinct().count()
    assert sharding.shard(empty).collect() == []
