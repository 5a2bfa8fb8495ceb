"""The n-gram join against brute force, and the pipeline's stages against plain versions."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexiforge.llm import ngram_join as N


def grams(text, gram=3):
    w = (text or "").encode().lower().split()
    return set() if not w else ({tuple(w)} if len(w) < gram else {tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)})


def brute_force(rows, gram=3, percent=90):
    """(doc_id, set size, smallest doc_id reachable, links), all pairs that share a word n-gram."""
    sets, root, holders, n_links = [grams(t, gram) for _, t in rows], list(range(len(rows))), {}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
                n_links.update((i, j))
        for g in s:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return ordered((d, len(s), least.get(find(i)) if s else d, n_links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert ordered(N.op9_ngram_jaccard(docs).collect()) == brute_force(rows)


def test_near_copies_near_the_threshold_and_edge_cases(spark):
    rng = random.Random(6)
    rows, next_id = [], 0
    for size in (9, 12, 30, 60, 200, 700):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for k in range(14):  # each differs from the base by a few words, so sets lie on either side of 90 %
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 45) + 1)):
                words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append((next_id, " ".join(words)))
            next_id += 1
    for text in (None, "", " ", "a", "A", "a b", "A  B", "a b c", "x " * 500, "X " * 400):
        rows.append((next_id, text))
        next_id += 1
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(5)
    assert ordered(N.op9_ngram_jaccard(docs).collect()) == brute_force(rows)
    assert N.op9_ngram_jaccard(docs.limit(0)).count() == 0


def test_large_clusters_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SETS", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words[: 120 - i // 2])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(N.op9_ngram_jaccard(docs).collect()) == brute_force(rows)


def test_five_words_and_eighty_percent_without_counting(spark):
    rng = random.Random(16)
    rows = []
    for size in (5, 8, 9, 14, 30, 60, 200, 900):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 40) + 1)):
                words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words[: size - rng.randrange(0, size // 8 + 1)])))
    found = N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, count_links=False)
    assert ordered(r[:3] for r in found.select("doc_id", "n_shingles", "component_id").collect()) == ordered(r[:3] for r in brute_force(rows, 5, 80))


def test_repeated_and_null_ids_do_not_depend_on_partitions(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(80)) for p in "abc")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (None, c), (9, c + " z"), (None, "alone here now"), (None, "Alone here now"), (None, None), (7, a), (7, c)]
    for parts in (1, 3, 5):
        assert ordered(N.op9_ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()) == brute_force(rows)


def test_signatures_and_bounds_lose_no_link():
    rng = np.random.default_rng(0)
    for percent in (90, 80):
        parts, linked, room = N.Parts(percent), 0, percent / (100 - percent)
        for _ in range(1500):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(4, 400)), dtype=np.uint64))
            d = int(len(a) / room * rng.random() * 1.2)
            k = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[k:]], rng.integers(0, 2**63, d - k, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= percent * (len(a) + len(b) - common) and N.fingerprint(a) != N.fingerprint(b):
                linked += 1
                assert set(parts.signatures(a).tolist()) & set(parts.signatures(b).tolist())
                assert N.may_link(N.signature_tree([a], [0]), N.signature_tree([b], [0]), percent)
        assert linked > 800


def test_sketches_lose_no_link():
    rng = np.random.default_rng(1)
    for percent in (90, 80, 50):
        linked = 0
        for _ in range(600):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64))
            k = int(len(a) * rng.random() * 2 * (100 - percent) / 100)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[k:]], rng.integers(0, 2**63, int(rng.integers(0, k + 2)), dtype=np.uint64)]))
            if not len(b):
                continue
            common = len(np.intersect1d(a, b))
            found = N.sketch_forest(np.array([len(a), len(b)]), np.array([0, 1]), [N.sketch(a), N.sketch(b)], percent)
            if 100 * common >= percent * (len(a) + len(b) - common):
                linked += 1
                assert len(found) == 1
        assert linked > 100
    apart = [np.unique(rng.integers(0, 2**63, 400 + i, dtype=np.uint64)) for i in range(20)]
    assert not N.sketch_forest(np.array([len(a) for a in apart]), np.zeros(20, int), [N.sketch(a) for a in apart], 80)


def test_texts_that_only_share_a_passage_go_to_no_block(spark, monkeypatch):
    sent, links = [], N.links
    monkeypatch.setattr(N, "links", lambda docs, clusters, *rest: sent.append(clusters.count()) or links(docs, clusters, *rest))
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(250)])) for i in range(60)]
    rows += [(100, rows[0][1] + " z"), (101, rows[7][1] + " y")]
    found = N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, count_links=False)
    assert ordered(r[:3] for r in found.select("doc_id", "n_shingles", "component_id").collect()) == ordered(r[:3] for r in brute_force(rows, 5, 80))
    assert sent == [4]


def test_sketches_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "SKETCH_SETS", 5)
    test_large_clusters_in_several_blocks(spark, monkeypatch)


def test_texts_of_no_cluster_are_not_shuffled(spark, monkeypatch, capsys):
    kept, links = [], N.links
    monkeypatch.setattr(N, "links", lambda *args: kept.append(links(*args)) or kept[0])
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None if i % 5 == 0 else i, " ".join(f"{i}x{k}" for k in range(30))) for i in range(2000)]
    rows += [(5001, text), (5002, text + " z"), (None, text + " y"), (-7, "z " + text)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on a table with many copies
    try:
        found = ordered(N.op9_ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        kept[0].collect()
        kept[0].explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == brute_force(rows)
    shuffled = [float(n) for n in re.findall(r"ShuffleQueryStage.*rowCount=([0-9.E+]+)", capsys.readouterr().out)]
    assert shuffled and max(shuffled) < 400


def test_bitmaps_that_are_full_lose_no_key(spark, monkeypatch):
    rows, keys = spark.range(-20_000, 60_000).select(F.col("id").alias("key")), spark.range(-20_000, 60_000, 8).select(F.col("id").alias("key"))
    for most in (1024, 1):
        monkeypatch.setattr(N, "MOST_BITMAPS", most)
        found = N.may_hold(rows, keys)
        assert found.join(keys, "key").count() == 10_000
        assert found.count() < (13_000 if most > 1 else 40_000)
    assert N.may_hold(rows, keys.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    from lexiforge.llm import mixing, quality

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.keep_quality(spark, documents, sf)
    verdict = {r.doc_id for r in quality.op6_quality_rules(documents).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict and kept.columns == P.COLUMNS
    unique = P.drop_near_duplicates(spark, kept, sf)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in unique.collect()) == sorted(d for d, _, c, _ in brute_force(rows, 5, 80) if d == c)
    mixed = P.mix_sources(spark, unique, sf)
    want = {r.doc_id: r.copies for r in mixing.op5_mixing(unique).where("copies > 0").collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == want and mixed.columns == P.COLUMNS
    odd = kept.limit(20).union(kept.limit(20)).union(kept.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("text_hash", F.lit("clash"))
    assert P.drop_near_duplicates(spark, odd, sf).count() == P.drop_near_duplicates(spark, kept.limit(20), sf).count()
    assert P.drop_near_duplicates(spark, kept.limit(0), sf).count() == 0
    last = P.run(spark, sf)
    assert last.count() > 0 and last.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
