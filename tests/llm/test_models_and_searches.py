"""Learned scores, nearest neighbours and decontamination: held-out quality and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import decontamination, langid, neighbours, toxicity


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _distance_with_swaps(a, b):
    """Edits of single letters, and neighbours that change places as one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def test_automaton_finds_what_edit_distance_says():
    rng = random.Random(5)
    terms = ["idiot", "moron", "worthless", "disgusting", "scum", "morons", "wört", "ass"]
    auto = toxicity.Automaton(terms)
    words = set(terms)
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randrange(4)):
                p = rng.randrange(len(w) + 1)
                op = rng.randrange(4)
                if op == 3:
                    w[p : p + 2] = w[p : p + 2][::-1]
                else:
                    w = w[:p] + [rng.choice("aeio")] * (op < 2) + w[p + (op > 0) :]
            words.add("".join(w))
    for w in words:
        want = {(t, _distance_with_swaps(t, w)) for t in terms if _distance_with_swaps(t, w) <= toxicity.edits(t)}
        assert set(auto.find(w)) == want, w


def test_short_terms_and_swaps_are_caught():
    reader = toxicity.Lexicon(words={"moron": 3.0, "scum": 3.0, "ass": 3.0}).reader()
    for word, found in (("skum", True), ("mroon", True), ("scmu", True), ("as", False), ("sskm", False), ("skm", False)):
        assert bool(reader.hits(f"a {word} here")[0]) == found


def test_context_parts_quotation_from_abuse():
    reader = toxicity.Lexicon(words={"moron": 3.0}).reader()
    abuse = reader.hits("you are such a moron and I mean it")[0][0][3]
    plain = reader.hits("this is such a moron of a text")[0][0][3]
    quoted = reader.hits('he said the word "moron" was printed there')[0][0][3]
    assert abuse > plain > quoted
    assert [h[:3] for h in reader.hits("a morron")[0]] == [("morron", 2.25, False)]


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    ranks, n = got.score.rank(), int(got.toxic.sum())
    auc = (ranks[got.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n))
    assert auc > 0.93 and ((got.predicted == got.toxic).mean()) > 0.97
    assert all(_held_out(i) for i in got.doc_id)


def test_toxicity_ignores_other_columns_and_held_out_labels(spark, awkward):
    rows = [(i, f"filler words number {i} " + ("you grobian" if i % 3 == 0 else "nice day"), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    flipped = spark.createDataFrame(
        [(i, int((i % 3 == 0) != _held_out(i))) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int"
    )
    a = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r for r in toxicity.toxicity(docs, flipped).collect()}
    assert a == b and all(a[i].predicted == (i % 3 == 0) for i in range(400))
    lexicon = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, "hello grobiam"), (2, "hello"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(odd, lexicon, ["doc_id"]).collect()}
    assert got[1].predicted == 1 and got[2] .score == got[3].score == got[4].score < 0.5


def test_toxicity_learns_terms_of_the_long_tail(spark):
    # One term in 25 of 3,000 toxic texts, under one in a hundred, and in no clean text.
    rows = [(i, f"plain words {i} " + ("you grobian" if i % 120 else "wretchling") * (i % 2 == 0), int(i % 2 == 0)) for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert {"grobian", "wretchling"} <= set(lexicon.words) and "plain" not in lexicon.words
    few = toxicity.fit(docs.drop("toxic"), docs.drop("text"), max_terms=3)
    assert len(few.words) + len(few.stems) == 3


def test_copies_of_one_text_are_one_piece_of_evidence(spark):
    rows = [(i, "lorem ipsum dolor grobian" if i % 2 else f"plain words {i} and more", int(i % 2)) for i in range(400)]
    rows += [(1_000 + i, f"some{i} other{i} wretchling here{i} again{i}", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    assert "wretchling" in lexicon.words and not {"lorem", "ipsum", "dolor"} & set(lexicon.words)


def test_copies_are_found_without_moving_their_texts(spark):
    rows = [(i, f"grobian{i % 40} wretchling{i % 40} lorem", int(i % 2)) for i in range(300)]
    rows += [(5, "another text of a repeated id", 1), (7, None, 1), (8, "", 0), (10, None, 0), (5, "another text of a repeated id", 1)]
    texts = spark.createDataFrame(rows, "id long, text string, toxic int").withColumn("at", F.monotonically_increasing_id())
    kept, sizes = toxicity._one_of_copies(texts)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Aggregate" not in plan
    least = {}
    for i, text, label in rows:
        key = label, text or ""
        least[key] = min(i, least.get(key, i))
    got = [(r.toxic, r.text or "", r.id) for r in kept.collect()]
    assert sorted(got) == sorted((*k, i) for k, i in least.items())
    assert sizes == Counter(label for label, _ in least)


def test_misspellings_that_clean_texts_hold_are_all_counted(spark):
    alphabet = "bcdfghjklmnpqrstvwxz"
    wrong = [f"grob{a}an" for a in alphabet] + [f"gro{a}ian" for a in alphabet if a != "b"] + [f"{a}robian" for a in alphabet if a != "g"]
    rows = [(i, f"so{i} ver{i} grobian it{i} is{i}", 1) for i in range(400)]
    rows += [(1_000 + i, f"some{i} clean {wrong[i % len(wrong)]} text{i}", 0) for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.drop("toxic"), docs.drop("text"), max_terms=6)
    assert set(wrong) <= set(lexicon.spelled) and max(lexicon.spelled[w] for w in wrong) < 1.0


def test_toxicity_awkward(awkward, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(awkward, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == awkward.count()
    assert {r.predicted for r in got.collect()} == {0}
    assert toxicity.toxicity(empty, labels).collect() == []


def test_language_on_held_out_rows(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = langid.language(documents).collect()
    own = [r for r in rows if r.held_out]
    assert {r.doc_id for r in own} == {i for i in truth if _held_out(i)}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_kneser_ney_probabilities_sum_to_one():
    key, _ = langid.grams(["the cat sat on the mat", "a cat and a hat"])
    keys, counts = np.unique(key, return_counts=True)
    model = langid.KneserNey.of(keys, counts)
    symbols = np.unique(key & np.uint64(0xFFFF))
    unknown = np.append(symbols, np.uint64(0x7777))
    for context in (keys[3] >> np.uint64(16), keys[-1] >> np.uint64(16), np.uint64(0x7A7A7A7A7A7A)):
        p = np.exp(model.log_p((context << np.uint64(16)) | unknown))
        assert p.sum() == pytest.approx(1.0)


def test_language_keeps_the_most_frequent(spark):
    rows = [(x, g, n) for x in "ab" for g, n in ((1, 5), (2, 9), (3, 5), (4, 1))]
    counted = spark.createDataFrame(rows, "lang string, gram long, n long")
    got = langid._most_frequent(counted, {"a": 4, "b": 4}, 2).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 5), ("a", 2, 9), ("b", 1, 5), ("b", 2, 9)]
    assert langid._most_frequent(counted, {"a": 4, "b": 4}, 4).count() == 8


def test_language_bound_keeps_the_figures_of_all_sequences(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(4)]
    rows = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    counted = langid.count_grams(rows, "text", "lang").persist()
    size, total = counted.count(), sum(r.n for r in counted.collect())
    key, _ = langid.grams(texts)
    whole = langid._all_levels(*np.unique(key, return_counts=True))
    got = langid.levels(counted, {"x": (size, total)}, 1_000)["x"]
    most = int(langid.GROWTH * total**0.5)
    assert 1_000 < len(got[-1].keys) == most < size  # the bound grows with the counts, and binds here
    for a, b in zip(got, whole, strict=True):
        assert (a.once, a.twice, a.rows) == (b.once, b.twice, b.rows)
        at = np.searchsorted(b.keys, a.keys)
        assert (b.keys[at] == a.keys).all() and (b.counts[at] == a.counts).all() and (b.totals[at] == a.totals).all()
    model = langid.KneserNey.of_levels(got)
    symbols = np.append(np.unique(key & np.uint64(0xFFFF)), np.uint64(0x7777))
    for context in key[5:400:40] >> np.uint64(16):
        assert np.exp(model.log_p((context << np.uint64(16)) | symbols)).sum() == pytest.approx(1.0)
    counted.unpersist()


def test_language_cut_among_ties_and_signs(spark):
    rng = random.Random(4)
    rows = list({(x, rng.choice([1, 40_000, -(1 << 62)]) + rng.randrange(200)): (x, 0, 0) for x in "abc" for _ in range(300)})
    rows = [(x, g, rng.choice([1, 1, 1, 2, 70_000, 1 << 40])) for x, g in rows]
    sizes = {x: sum(r[0] == x for r in rows) for x in "abc"}
    for share in ({"a": 10, "b": 150, "c": 1_000}, {"a": 1, "b": sizes["b"] - 1, "c": sizes["c"]}):
        got = langid._most_frequent(spark.createDataFrame(rows, "lang string, gram long, n long"), sizes, share).collect()
        want = [r for x in "abc" for r in sorted((r for r in rows if r[0] == x), key=lambda r: (-r[2], r[1]))[: share[x]]]
        assert sorted(map(tuple, got)) == sorted(want)


def test_language_without_a_bound_keeps_every_sequence(spark):
    rows = [(x, g, 1 + g % 3) for x in "ab" for g in range(1 << 16, 6_000 + (1 << 16))]
    counted = spark.createDataFrame(rows, "lang string, gram long, n long")
    sizes = {x: (6_000, sum(n for y, _, n in rows if y == x)) for x in "ab"}
    bounded, whole = (langid.levels(counted, sizes, m) for m in (100, None))
    assert len(bounded["a"][-1].keys) < 6_000 == len(whole["a"][-1].keys)


def test_language_awkward(awkward, empty):
    got = langid.language(awkward)
    assert got.count() == awkward.count()
    assert {r.lang_pred for r in got.where("doc_id in (3, 4, 5, 8)").collect()} == {"und"}
    assert set(r.lang_pred for r in got.collect()) <= {"und", "en", "de", "fr"}
    assert langid.language(empty).collect() == []
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language(unlabelled).collect()} == {"und"}


def _exact(ids, x, q, k):
    score = np.einsum("ij,j->i", x, x[q])
    rest = np.flatnonzero(ids != ids[q])
    order = rest[np.lexsort((ids[rest], -score[rest]))][:k]
    return list(zip(ids[order].tolist(), score[order].tolist(), strict=True))


@pytest.mark.parametrize("block_bytes", [8 << 20, 20_000])
def test_neighbours_by_brute_force(spark, sf_dir, block_bytes):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = {}
    for r in neighbours.nearest(table, block_bytes=block_bytes, query_bytes=7 * 64 * 8).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want, have = _exact(ids, x, q, 20), found[ids[q]]
        assert sorted(have) == list(range(1, 21))
        hits += len({i for i, _ in want} & {i for i, _ in have.values()})
        total += 20
    assert hits / total >= 0.99


@pytest.mark.parametrize("size", [1e-30, 1e20, 1e140])
def test_neighbours_of_large_and_small_components(spark, size):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3_000, 16)) * size
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, every=100).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.arange(len(x))
    hits = sum(len(found[q] & {i for i, _ in _exact(ids, x, q, 20)}) for q in range(0, 3_000, 100))
    assert hits >= 0.99 * 20 * 30


def test_neighbours_keep_rows_whose_score_is_known():
    for seed in range(400):
        x = np.random.default_rng(seed).standard_normal((21, 64))
        codes, scalars, centre = neighbours.encode(x)
        for _, rows, _ in neighbours.search_block(np.arange(21), x, codes, scalars, centre, np.arange(21), x, 20, 2.5):
            assert len(rows) == 20


def test_neighbours_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)], i) for i in range(1, 60)] + [(20, [1.0, 2.0], 0)] * 3 + [(i, [0.5, 0.5], 0) for i in range(100, 400)]
    rows += [(500, None, 0), (520, [0.0, 0.0], 0), (540, [nan, 1.0], 0), (560, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (580, [1.0, None], 0), (600, [1.0, 1.0, 1.0], 0), (620, [], 0)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect()
    asked = {r.query_id for r in got}
    assert asked == {i for i in range(20, 400, 20) if i < 60 or i >= 100}
    first = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 100)
    by_id = {i: v for i, v, _ in rows if v and len(v) == 2 and i and i < 400}
    want = sorted(((-(v[0] + v[1]) / 2, i) for i, v in by_id.items() if i != 100))[:20]
    assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in first]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_edit_verification_by_plain_table():
    rng = random.Random(2)
    for _ in range(200):
        p = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))], np.uint64)
        t = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(0, 14))], np.uint64)
        got = decontamination.nearest(p, t)
        want = min((_distance(p, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1)), default=len(p))
        if len(t):
            assert got[0] == want and _distance(p, t[got[1] : got[2]]) == want


@pytest.mark.parametrize("chunk_characters", [8 << 20, 3_000])
def test_decontamination_by_brute_force(spark, sf_dir, documents, chunk_characters):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(documents, items, chunk_characters=chunk_characters).collect()}
    texts, bench = documents.collect(), items.collect()
    inside = {(d.doc_id, b.item_id) for d in texts for b in bench if d.text and b.text in d.text}
    assert inside and inside <= set(got)
    hashes = decontamination.WordHashes()
    words = {d.doc_id: np.frombuffer(hashes.of(d.text), np.uint64) for d in texts}
    for (doc, item), r in got.items():
        p = np.frombuffer(hashes.of(next(b.text for b in bench if b.item_id == item)), np.uint64)
        stretch = words[doc][r.start_word : r.end_word]
        assert _distance(p, stretch) == r.distance <= 0.2 * len(p) and r.item_words == len(p)
    for doc in list(words)[:60]:  # no item within its edits is missed in a sample of texts
        for b in bench[:10]:
            p = np.frombuffer(hashes.of(b.text), np.uint64)
            best = decontamination.nearest(p, words[doc])
            assert ((doc, b.item_id) in got) == (best is not None and best[0] <= int(0.2 * len(p)))


def test_recall_of_edited_passages(spark, sf_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/benchmark.parquet").collect()]
    index, hashes, rng = decontamination.Index(bench, 0.2, 0.95), decontamination.WordHashes(), random.Random(4)
    found = 0
    for item, text in bench:
        w = text.split()
        for _ in range(int(len(w) * 0.15)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["new"], [w[p], "more"]])
        packed = hashes.of("before that " + " ".join(w) + " after it") + bytes(8)
        found += any(r[0] == item for r in index.hits(np.frombuffer(packed, np.uint64), [0]).get(0, []))
    assert found / len(bench) >= 0.95


def _edited(words, edits, rng):
    """Copies with so many edits: spread evenly, at either end, missing there, single words anywhere, anything anywhere."""
    n, even, mixed, singles = len(words), list(words), list(words), list(words)
    for k in range(edits):
        even[min(n - 1, 5 * k + 4)] = "new"
        p = rng.randrange(len(mixed))
        mixed[p : p + 1] = rng.choice([[], ["new"], [mixed[p], "more"]])
    for p in rng.sample(range(n), edits):
        singles[p] = "new"
    return even, ["new"] * edits + words[edits:], words[: n - edits] + ["new"] * edits, words[edits:], singles, mixed


@pytest.mark.parametrize("n", [5, 6, 9, 10, 12, 13, 15, 20, 30, 50, 100, 200])
def test_recall_of_passages_with_all_their_edits(n):
    rng, hashes = random.Random(n), decontamination.WordHashes()
    bench = [(i, " ".join(f"w{rng.randrange(5_000)}" for _ in range(n))) for i in range(60)]
    index, found, there = decontamination.Index(bench, 0.2), Counter(), Counter()
    for item, text in bench:
        for kind, copy in enumerate(_edited(text.split(), int(n * 0.2), rng)):
            words = np.frombuffer(hashes.of("before that " + " ".join(copy) + " after it") + bytes(8), np.uint64)
            assert decontamination.nearest(index.words[item], words)[0] <= int(n * 0.2)  # what exact search finds
            there[kind] += 1
            found[kind] += item in {r[0] for r in index.hits(words, [0]).get(0, [])}
    assert all(found[kind] >= 0.95 * there[kind] for kind in there)


def test_exact_copies_of_any_length_are_found():
    rng, hashes = random.Random(8), decontamination.WordHashes()
    bench = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(1 + i % 14))) for i in range(400)]
    index = decontamination.Index(bench, 0.2)
    for item, text in bench:
        words = np.frombuffer(hashes.of(f"before {text} after") + bytes(8), np.uint64)
        assert item in {r[0] for r in index.hits(words, [0])[0]}


def test_walks_fall_into_step_after_an_edit():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**63, 400, dtype=np.uint64) | np.uint64(1)
    b = np.concatenate([a[:50], a[53:], np.zeros(3, np.uint64)])  # three words are missing
    again = 0
    for factor in rng.integers(1, 2**62, 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1):
        sampled = list(range(0, 60, 2))
        (x, _), (y, _) = (decontamination._walk(t, np.array([46]), sampled, factor) for t in (a, b))
        again += sum(p[0] == q[0] for p, q in zip(x[-5:], y[-5:], strict=True)) >= 4
    assert again > 100


def test_decontamination_awkward(spark, awkward, empty):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "lazy dog"), (4, "one"), (5, "The QUICK, brown fox jumps over a lazy dog near the river bank"), (5, "the lazy dog"), (None, "an id is missing")],
        "item_id long, text string",
    )
    got = sorted((r.doc_id or 0, r.item_id or 0, r.distance) for r in decontamination.contaminated(awkward, items).collect())
    fox = [(3, 0), (5, 0), (5, 1)]
    assert got == sorted([(0, 0, 0), (20, 4, 0), *[(d, i, e) for d in (1, 1, 2) for i, e in fox]])
    assert decontamination.contaminated(empty, items).collect() == []
    assert decontamination.contaminated(awkward, items.limit(0)).collect() == []
