"""Each contract query against its plain version, over sf0.01 and over odd rows."""

import random

import numpy as np
import pytest

from meshlark.llm import brown_lm, fm_decontam, lang_id, license_scan, piece_codec, quality_rules, queries, secret_battery, simhash, token_spans

from . import brute, fixtures

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def both(spark, docs):
    yield spark.createDataFrame(docs, "doc_id bigint, text string"), docs
    yield fixtures.odd(spark), [r[:2] for r in fixtures.odd_rows()]
    yield fixtures.empty(spark), []


def test_simhash(spark, docs):
    for df, rows in both(spark, docs):
        got = [(r["id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash.near_duplicates(df).collect()]
        assert bag(got) == bag(brute.simhash_components(rows))
    out = queries.op1_simhash_pivots(spark, SF)
    assert bag(out.collect()) == bag(brute.simhash_components(docs))


@pytest.mark.parametrize("limit", [64, 3, 1])
def test_simhash_links_with_small_buckets(spark, limit):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(12):
            for _ in range(r.choice((1, 1, 2, 3))):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    from meshlark.llm.components import components

    edges = simhash.link(spark.createDataFrame(signed, "fp bigint"), bucket_limit=limit)
    pairs = {(r["u"] % 2**64, r["v"] % 2**64) for r in edges.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    parent = {f: f for f, in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a,) in enumerate(signed):
        for b, in signed[:i]:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    assert {f: root(f) for f, in signed if root(f) != f} == got


def near(fps, radius, accept=None):
    """Clusters by plain comparison."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius and (accept is None or accept(i, j)):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return [root(k) for k in range(len(fps))]


@pytest.mark.parametrize("radius", [2, 9])
def test_stars_connect_what_pairs_connect(radius):
    r = random.Random(radius)
    for _ in range(20):
        base = [r.getrandbits(64) for _ in range(4)]
        fps = []
        for _ in range(120):
            f = r.choice(base)
            for _ in range(r.randint(0, radius + 1)):
                f ^= 1 << r.randrange(64)
            fps.append(f)
        fps = np.array(fps, np.uint64)
        for accept in (None, lambda i, j: (i * j) % 3 > 0):
            got = simhash.near_stars(fps, simhash.pivots(32), radius, accept and (lambda i, js: np.array([accept(i, j) for j in js.tolist()])))
            parent = list(range(len(fps)))
            for i, j in got:
                assert (int(fps[i]) ^ int(fps[j])).bit_count() <= radius
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                assert a != b
                parent[max(a, b)] = min(a, b)
            roots = []
            for k in range(len(fps)):
                while parent[k] != k:
                    k = parent[k]
                roots.append(k)
            assert roots == near(fps, radius, accept)


def test_alike_is_exact():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    alike = simhash.Alike(sets, 0.5)
    for i in range(60):
        for js in (np.arange(60), r.integers(0, 60, 5)):
            want = [len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j])) for j in js.tolist()]
            assert alike(i, js).tolist() == want


def test_groups_are_not_cut():
    import pyarrow as pa

    r = random.Random(3)
    rows = sorted((r.randrange(12), r.randrange(3), k) for k in range(500))
    batches, at = [], 0
    while at < len(rows):
        n = r.choice((0, 1, 7, 90))
        part = rows[at : at + n]
        batches.append(pa.record_batch([pa.array([x[k] for x in part], pa.int64()) for k in range(3)], ["a", "b", "c"]))
        at += n
    got = {}
    for cols, start, size in simhash.groups(iter(batches), 2):
        for s, k in zip(start, size):
            assert got.setdefault((cols[0][s], cols[1][s]), []) == []
            got[cols[0][s], cols[1][s]] += cols[2][s : s + k].tolist()
    want = {}
    for a, b, c in rows:
        want.setdefault((a, b), []).append(c)
    assert got == want


def test_contraction_in_parts(spark, monkeypatch):
    from meshlark.llm import components as C

    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(399, k) for k in range(0, 90, 2)]
    for hold in (3, 10**6):
        monkeypatch.setattr(C, "HOLD", hold)
        import pyarrow as pa

        cur = sorted((max(e), min(e)) for e in edges if e[0] != e[1])
        for _ in range(60):
            out = []
            for b in C._contract(iter([pa.record_batch([pa.array([e[k] for e in cur], pa.int64()) for k in (0, 1)], ["u", "v"])])):
                out += zip(*(b.column(k).to_pylist() for k in range(3)))
            up = {}
            for u, v in cur:
                up[u] = min(v, up.get(u, v))
            nxt = sorted((u, up.get(v, v)) for u, v, _ in out)  # parents become grandparents, as in the loop
            if nxt == cur and not any(e[2] for e in out):
                break
            cur = nxt
        parent = list(range(400))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
        assert {u: v for u, v in cur} == {k: root(k) for k in range(400) if root(k) != k} and len(cur) == len(dict(cur))


def test_similar_texts(spark, docs):
    r = random.Random(6)
    base = ["w%d" % r.randrange(500) for _ in range(150)]
    many = []
    for k in range(300):  # a group of copies with a few words changed each
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(150)] = "x%d" % r.randrange(10**6)
        many.append((10_000 + k, " ".join(w)))
    long = " ".join("v%d" % r.randrange(10**5) for _ in range(250_000))  # over 1 MB
    many += [(20_000, long), (20_001, long.replace("v7 ", "u7 ")), (20_002, long[: len(long) // 2])]
    for rows, holds in ((docs + many, (1 << 20, 2000)), ([x[:2] for x in fixtures.odd_rows()], (1 << 20,)), ([], (1 << 20,))):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        want = {}
        for t, g in brute.similar_groups([t for _, t in rows]).items() if rows else ():
            want.setdefault(g, set()).add(__import__("hashlib").md5(t.encode()).hexdigest())
        for hold in holds:
            got = {}
            for x in simhash.similar(df, hold=hold).collect():
                got.setdefault(x["root"], set()).add(x["said"])
            assert set(map(frozenset, got.values())) == set(map(frozenset, want.values()))


def test_blocks_of_a_group_over_many_partitions(spark):
    rows = [(k % 3 * (k % 5 > 0), k * 7919 % 101, k) for k in range(3000)]
    want, at = {}, {}
    for root, n, node in sorted(rows):
        want[node] = at.get(root, 0) // 1000
        at[root] = at.get(root, 0) + n
    got = simhash._blocks(spark.createDataFrame(rows, "root long, n long, node long"), 1000).collect()
    assert {r["node"]: r["block"] for r in got} == want and len(got) == len(rows)


def plans(monkeypatch, *modules):
    """The logical plans that these modules persist from now on."""
    seen = []
    for m in modules:

        def noted(df, put=m.persist):
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
            return put(df)

        monkeypatch.setattr(m, "persist", noted)
    return seen


def test_one_worker_a_task(spark, docs, monkeypatch):
    import re

    from meshlark.llm import components as C

    seen = plans(monkeypatch, C, simhash)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    simhash.similar(df)
    simhash.near_duplicates(df)
    assert len([p for p in seen if "MapInArrow" in p]) > 4
    assert not [p for p in seen if re.search(r"MapInArrow[^\n]*\n(?:[^\n]*\b(?:Project|Filter)\b[^\n]*\n)*[^\n]*MapInArrow", p)]


def test_stars_connect_what_edges_connect(spark):
    from meshlark.llm import components as C

    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)
    stars = df.mapInArrow(C.contracted, "u bigint, v bigint")
    assert all(x["u"] > x["v"] for x in stars.collect())
    assert bag(C.components(stars, stars=True).collect()) == bag(C.components(df).collect())


def test_children_of_one_root_are_split(spark, monkeypatch):
    from meshlark.llm import components as C

    seen = plans(monkeypatch, C)
    df = spark.range(1, 3000).selectExpr("id u", "id div 1000 v")
    assert bag(C.components(df).collect()) == bag([(k, 0) for k in range(1, 3000)])
    assert [p for p in seen if "Join" in p] and not [p for p in seen if "Join" in p and "Aggregate" in p]


def test_keep_one(spark):
    import hashlib

    df = fixtures.odd(spark)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    rows = got.collect()
    said = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    assert sorted((r["doc_id"], said(r["text"])) for r in rows) == brute.stay([r[:2] for r in fixtures.odd_rows()])
    assert {(r["n_words"], r["items"], r["score"]) for r in rows} == {(7, "spare", 0.5)}
    # one id, unlike texts: both stay, the copy goes; in every order of rows
    a, b = fixtures.WORDY, "an altogether different text of some words that has nothing in common with it"
    for order in ([(2, a), (1, a), (2, b)], [(2, b), (2, a), (1, a)], [(2, b), (1, a), (2, a), (2, b)]):
        d = spark.createDataFrame([(*x, "s") for x in order], "doc_id bigint, text string, __said string")
        assert bag(simhash.keep_one(d).collect()) == bag([(1, a, "s"), (2, b, "s")])
    assert simhash.keep_one(fixtures.empty(spark)).collect() == []


def test_decontamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "quick brown fox"), (901, None), (902, " - "), (None, "lazy dog"), (900, "quick brown fox"), (903, "one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    items = [x for x in items]
    for df, rows in both(spark, docs):
        want = bag(brute.contamination(rows, items))
        for block in (1 << 20, 3000):
            assert bag(fm_decontam.digest(fm_decontam.hits(df, bench, block_bytes=block)).collect()) == want
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["contaminated"] for r in fm_decontam.hits(fixtures.odd(spark), none).collect()} == {False}


def test_fm_index_against_search():
    r = np.random.default_rng(3)
    for _ in range(30):
        seq = r.integers(1, 5, r.integers(1, 80))
        index = fm_decontam.FMIndex(seq, 5)
        for n in (1, 2, 3):
            p = r.integers(1, 5, (20, n))
            rows = np.zeros((20, 4), np.int64)
            rows[:, 4 - n :] = p
            lo, hi = index.search(rows, np.full(20, n))
            for k in range(20):
                want = [s for s in range(len(seq) - n + 1) if (seq[s : s + n] == p[k]).all()]
                assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_licenses(spark, docs):
    for df, rows in both(spark, docs):
        got = license_scan.scan(df).collect()
        cols = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
        assert bag([tuple(r[c] for c in cols) for r in got]) == bag([(i, *brute.license_base(t)) for i, t in rows])
        for r in got:
            assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]


def test_license_templates():
    autos = {k: license_scan.compile_template(k, t) for k, t in license_scan.TEMPLATES.items()}
    tab = license_scan.byte_table()
    labels = lambda t: license_scan.scan_text(t.encode(), list(autos.values()), tab)[3]
    assert "apache-2.0" in labels("foo. Licensed under the Apache License, Version 2.0.")
    assert "apache-2.0" not in labels("Licensed under the Apache Licence, Version 2.0.")
    assert "gpl-3.0" in labels("This work is licensed under the GNU General Public License, version 3.")
    assert "gpl-3.0" not in labels("licensed under the GNU General Public License, version 2")
    assert labels("Licensed under CC BY-NC 4.0. Text") == ["cc-by", "cc-by-nc"]
    assert labels("Copyright (c) 2020 Some Body, all rights reserved") == ["copyright", "reserved"]
    a = license_scan.compile_template("t", "a <<opt>>b <<opt>>c<</opt>><</opt>> <<var:2>> d")
    for text, ok in (("a d", 1), ("a b d", 1), ("a b c d", 1), ("a x y d", 1), ("a b c x y d", 1), ("a x y z d", 0), ("a c d", 1), ("b d", 0)):
        w = text.encode().split()
        assert (license_scan.accepts(a, w, 0) == len(w)) == bool(ok), text
    with pytest.raises(ValueError):
        license_scan.compile_template("t", "a <<opt>> b")


def test_quality(spark, docs):
    rules = [[quality_rules.Term("upper", True, 0.5)]]
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, rows in both(spark, docs):
        got = quality_rules.judge(df, rules).collect()
        assert bag([tuple(r[c] for c in cols) for r in got]) == bag([(i, *brute.quality_base(t)) for i, t in rows])
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_learns(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.fit(table, labels)
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality_rules.judge(table, rules).collect()}
    seen = [(kept[r["doc_id"]], r["quality"]) for r in labels.collect()]
    good = [k for (k, f), q in seen if q == 1 and not f]
    bad = [k for (k, f), q in seen if q == 0 and not f]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.4 * len(bad)
    assert quality_rules.fit(table, labels.limit(0)) == []


def test_secrets(spark, docs):
    for df, rows in both(spark, docs):
        found = secret_battery.scan(df)
        got = secret_battery.digest(found).collect()
        want = bag([(i, *brute.secret_base(t)[:4]) for i, t in rows])
        assert bag([tuple(r)[:5] for r in got]) == want
        spans = {r["doc_id"]: r["spans"].split(",") for r in got}
        for i, t in rows:
            assert i is None or set(brute.secret_base(t)[4]) <= set(spans[i])
        masked = secret_battery.mask(df)
        assert masked.columns == df.columns
        texts = {r["doc_id"]: r["text"] for r in masked.collect() if r["doc_id"] is not None}
        for i, t in rows:
            if i is not None and t is not None:
                assert brute.secret_base(texts[i])[:3] == (0, 0, 0)


def test_battery_tells_keys_from_words(spark):
    r = random.Random(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(k, "say " + "".join(r.choice(b64) for _ in range(44)) + " end") for k in range(200)]
    rows += [(500 + k, "say " + "".join(r.choice(b64[:52]) for _ in range(48)) + " end") for k in range(100)]  # letters alone
    rows += [(1000 + k, " ".join(r.choice(["understanding", "representational", "internationalization"]) + r.choice(["consideration", "compartmentalize"]) for _ in range(3))) for k in range(400)]
    rows += [(2000 + k, f"see aaaaaaaaaaaaaaaaaaaaaaaa{k:04d} there") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: [(y["s"], y["e"]) for y in x["spans"]] for x in secret_battery.scan(df).collect()}
    hits = [sum(bool(got[k]) for k in ks) for ks in (range(200), range(500, 600), [k for k in got if k >= 1000])]
    assert hits[0] >= 150 and hits[1] >= 25 and hits[2] <= 15, hits
    known = secret_battery.calibration(spark)
    share = lambda band, k: secret_battery.false_share(known[band], k)
    want = brute.random_spans([t for _, t in rows], secret_battery.BANDS, secret_battery.CUTS, share, secret_battery.ALPHA)
    assert [got[k] for k, _ in rows] == want


def test_a_few_documents_get_the_spans_that_many_get(spark):
    r = random.Random(12)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64))
    few = [(k, f"the key is {key[k:]}{key[:k]} and no more") for k in range(5)]
    many = few + [(100 + k, "words and words " * 40 + "internationalization_of_" + r.choice(["names", "texts"]) + "_and_more") for k in range(300)]
    for rows in (few, many):
        got = {x["doc_id"]: len(x["spans"]) for x in secret_battery.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert sum(got[k] for k in range(5)) >= 4 and not any(got[k] for k in got if k >= 100)


def test_random_spans_against_plain(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    known = secret_battery.calibration(spark)
    share = lambda band, k: secret_battery.false_share(known[band], k)
    want = brute.random_spans([t for _, t in docs], secret_battery.BANDS, secret_battery.CUTS, share, secret_battery.ALPHA)
    got = {x["doc_id"]: [(y["s"], y["e"]) for y in x["spans"] if y["kind"] == "random"] for x in secret_battery.scan(df).collect()}
    assert [got[i] for i, _ in docs] == want


def test_unigram_base_and_model(spark, docs):
    for df, rows in both(spark, docs):
        n, want = brute.unigram(rows)
        for head in (1 << 17, 50):
            got = brown_lm.score(df, head=head).collect()
            assert bag([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"]) for r in got]) == bag([w[:4] for w in want])
            assert {r["train_tokens"] for r in got} <= {n}
            a, b = sorted((repr(r["doc_id"]), r["n_tokens"], round(r["base_score"], 6)) for r in got), sorted((repr(w[0]), w[2], round(w[4], 6)) for w in want)
            assert all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-4, rel=1e-9) for x, y in zip(a, b, strict=True))
    held = [r for r in brown_lm.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("head", [1 << 17, 2000, 300])
def test_class_scores(spark, docs, head):
    """Scores against a plain version, with the classes taken from the model."""
    df = spark.createDataFrame(docs, "id bigint, t string").selectExpr("id", "coalesce(t, '') t")
    rows = df.where("crc32(cast(cast(id as string) as binary)) % 5 <> 1").select("t")
    model = brown_lm.train(rows, brown_lm.word_counts(rows), head)
    classes = {w.decode(): int(model.classes[k]) for w, k in model.head.items()}
    assert len(classes) <= head and set(classes.values()) <= set(range(2, brown_lm.CLASSES))
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(df, "id", "t", head=head).collect()}
    want = brute.class_scores(docs, classes, None)
    assert [got[i] for i, _ in docs] == pytest.approx(want, rel=1e-9)


def test_scores_of_held_out_texts(spark, docs):
    held = [r for r in brown_lm.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    ours, base = (10 ** (-sum(r[c] for r in held) / n) for c in ("score", "base_score"))
    assert ours < base


def test_model_is_a_distribution(spark):
    rows = [(k, t) for k, t in enumerate(["a b a c", "b a d", "a a b", "c d a b", "e f g a", "g"] * 3)]
    docs = spark.createDataFrame(rows, "id bigint, t string").select("t")
    counts = brown_lm.word_counts(docs)
    seen = {bytes(r["w"]): r["n"] for r in counts.collect()}
    for head in (1 << 17, 3):
        m = brown_lm.train(docs, counts, head)
        assert np.allclose((10**m.move).sum(1), 1)
        mass = np.zeros(brown_lm.CLASSES)
        for k in range(len(m.head)):
            mass[m.classes[k]] += 10 ** m.emit[k]
        mass[brown_lm.PAST] = sum(10 ** m.emit[-1] * (n + 0.5) for w, n in [*seen.items(), (None, 0)] if w != b"" and w not in m.head)
        assert np.allclose(mass[mass > 0], 1)


def test_words_join_the_likeliest_class():
    r = np.random.default_rng(4)
    c = brown_lm.CLASSES
    n = r.integers(0, 30, (c, c)).astype(float)
    right, left = r.integers(0, 4, (40, c)).astype(float), r.integers(0, 4, (40, c)).astype(float)

    def likelihood(x):
        f = lambda v: (v[v > 0] * np.log(v[v > 0])).sum()
        return f(x) - f(x.sum(0)) - f(x.sum(1))

    got = brown_lm.likeliest(n, right, left)
    for k in range(40):
        rows, cols = n.sum(1), n.sum(0)
        best = []
        for j in range(2, c):  # the class's own counts alone change
            f = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1e-300)), 0)
            gain = f(n[j] + right[k]).sum() - f(n[j]).sum() + f(n[:, j] + left[k]).sum() - f(n[:, j]).sum()
            best.append(gain - f(rows[j] + right[k].sum()) + f(rows[j]) - f(cols[j] + left[k].sum()) + f(cols[j]))
        assert best[got[k] - 2] == pytest.approx(max(best))


def test_exchange_raises_the_likelihood():
    r = np.random.default_rng(1)
    b = np.zeros((42, 42), np.int64)
    for _ in range(4000):  # two kinds of words that follow each other in turn
        a = r.integers(0, 20)
        b[a, 20 + r.integers(0, 20)] += 1
        b[20 + r.integers(0, 20), r.integers(0, 20)] += 1
    b[41, 0] = b[0, 41] = 5

    def likelihood(own):
        n = np.zeros((4, 4))
        np.add.at(n, (own[:, None].repeat(42, 1), own[None].repeat(42, 0)), b)
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(n) - f(n.sum(0)) - f(n.sum(1))

    own = brown_lm.exchange(b, classes=4)
    start = np.concatenate([2 + np.arange(40) % 2, [1, 0]])
    assert likelihood(own) > likelihood(start)
    assert len(set(own[:20])) == 1 and len(set(own[20:40])) == 1 and own[-2:].tolist() == [1, 0]


def test_languages(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang_id.identify(df).collect()
    true = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (brute.rem(r["doc_id"]) == 0) for r in got)
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.97 * len(held)
    odd = {r["doc_id"]: r for r in lang_id.identify(fixtures.odd(spark)).collect()}
    for k in (3, 4, 5):
        assert (odd[k]["lang_pred"], odd[k]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len(lang_id.identify(fixtures.odd(spark)).collect()) == len(fixtures.odd_rows())
    assert lang_id.identify(fixtures.empty(spark)).collect() == []


def test_out_of_place_distance():
    letters = lang_id.letter_table()
    (codes, counts), = lang_id.gram_codes("ab, AB b", letters)
    said = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)).strip("\0"): n for c, n in zip(codes.tolist(), counts.tolist())}
    assert said == {"a": 2, "b": 3, " a": 2, "ab": 2, "b ": 3, " b": 1, " ab": 2, "ab ": 2, " b ": 1}


def test_pieces(spark, docs):
    codec = piece_codec.Codec.load(n=4)
    r = random.Random(2)
    for _ in range(200):  # all segmentations of short units
        u = "▁" + "".join(r.choice("theanouri漢é") for _ in range(r.randint(1, 6)))

        def ways(i):
            if i == len(u):
                yield 0.0, ()
            else:
                for j, ids, s in codec.edges(u, i):
                    for t, rest in ways(j):
                        yield s + t, ids + rest

        want = sorted((s for s, _ in ways(0)), reverse=True)[:4]
        assert [s for s, _ in codec.search(u, 4)] == pytest.approx(want)
    for t in ("", " ", "  a b  c", "▁ x▁▁y", "a\n\tb\x00", "漢字 ☃ \U0001f600", "x" * 500):
        ids, top = codec.encode(t)
        assert codec.decode(ids) == t
        s = "▁" + t.replace("▁", piece_codec.LITERAL).replace(" ", "▁")
        if t and len(t) < 20:
            whole = codec.search(s, 4)
            assert top == pytest.approx([x for x, _ in whole])
    for df, rows in both(spark, docs):
        out = piece_codec.encode(df).collect()
        assert len(out) == len(rows) and all(x["round_trip"] for x in out)
    back = piece_codec.decode(piece_codec.encode(fixtures.odd(spark))).collect()
    assert all(x["decoded"] == (x["text"] or "") for x in back)


def test_n_best_ids_of_a_text(spark):
    codec = piece_codec.Codec.load(n=4)
    score = {i: x for i, x in codec.pieces.values()}
    for t in ("the cat", "a b", "on an oar on", "hat"):
        def ways(u, i=0):
            if i == len(u):
                yield ()
            for j, ids, _ in codec.edges(u, i) if i < len(u) else ():
                for rest in ways(u, j):
                    yield ids + rest

        every = [()]
        for u in codec.units(t):
            every = [a + b for a in every for b in ways(u)]
        ids, top, same = codec.nbest(t)
        assert same
        got = [tuple(x.tolist()) for x in ids]
        assert top == pytest.approx(sorted((sum(score[i] for i in w) for w in every), reverse=True)[:4])
        assert [sum(score[i] for i in w) for w in got] == pytest.approx(top)
        assert len(set(got)) == len(got) and set(got) <= set(every) and got[0] == tuple(codec.encode(t)[0].tolist())
        assert all(codec.decode(x) == t for x in ids)
        r = piece_codec.encode(spark.createDataFrame([(1, t)], "doc_id bigint, text string"), n=4).first()
        assert [r["piece_ids"], *r["other_ids"]] == [list(x) for x in got] and len(r["other_sha256"]) == len(got) - 1


def test_best_comes_from_the_search(docs):
    codec = piece_codec.Codec.load()
    for u in {u for _, t in docs[:60] for u in codec.units(t or "")}:
        (s, ids), *more = codec.search(u, 2)
        raw, best, loss = codec.first(u)
        assert tuple(np.frombuffer(raw, "<i4").tolist()) == ids and best == pytest.approx(s)
        assert loss == pytest.approx(s - more[0][0]) if more else loss == float("inf")


def test_units_together_are_as_alone(docs):
    codec = piece_codec.Codec(*piece_codec.Codec.load().plain())
    by_length = {}
    for u in {u for _, t in docs[:80] for u in codec.units(t or "")} | {u for r in fixtures.odd_rows() for u in codec.units(r[1] or "") if len(u) <= 64}:
        by_length.setdefault(len(u), []).append(u)
    for us in by_length.values():
        assert codec.firsts(us) == [codec.first(u) for u in us]


def test_a_worker_remembers_units_in_bounded_memory():
    import tracemalloc

    codec = piece_codec.Codec({}, [0] * 256, [])
    tracemalloc.start()
    for k in range(520_000):
        codec.remember(f"▁w{k}", (np.int32(k).tobytes() * 3, -k / 7, k / 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and codec.cache and codec.older


def test_pieces_are_much_as_the_library_says(docs):
    import sentencepiece

    lib, codec, same, n, ours, theirs = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL), piece_codec.Codec.load(), 0, 0, 0, 0
    for _, t in docs[:100]:
        for u in codec.units(t or ""):
            if u.count("▁") == 1 and len(u) > 1:
                got, want = list(np.frombuffer(codec.unit(u)[0], "<i4")), lib.encode(u[1:])
                same, n, ours, theirs = same + (got == want), n + 1, ours + len(got), theirs + len(want)
    assert same >= 0.8 * n and abs(ours - theirs) <= 0.03 * theirs


def test_token_counts(spark, docs):
    for df, rows in both(spark, docs):
        got = token_spans.count_tokens(df).collect()
        assert len(got) == len(rows)
        for x in got:
            assert sum(x["section_tokens"]) == x["n_tokens"]
    r = random.Random(4)
    for rule in ("most", "first"):
        for _ in range(200):
            lengths = [r.randint(1, 5) for _ in range(r.randint(0, 12))]
            total = sum(lengths)
            starts = [0, *sorted(r.sample(range(1, total), min(total - 1, r.randint(0, 4))))] if total > 1 else [0]
            owner = [max(k for k, s in enumerate(starts) if s <= b) for b in range(total)]
            want, cross, at, begin = [0] * len(starts), 0, 0, []
            for n in lengths:
                own = owner[at : at + n]
                cross += len(set(own)) > 1
                want[own[0] if rule == "first" else max(sorted(set(own)), key=own.count)] += 1
                begin.append(at)
                at += n
            begin = np.array(begin, np.int64)
            got, n_cross = token_spans.attribute(begin, begin + np.array(lengths, np.int64), np.array(starts), total, rule)
            assert (got.tolist(), n_cross) == (want, cross)


def test_tokens_through_the_query(spark, docs):
    """Every document, token by token and character by character."""
    import re

    import tiktoken

    ranks = token_spans.read_ranks(token_spans.RANKS)
    enc = tiktoken.Encoding("own", pat_str=token_spans.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries.op9_offset_tokens(spark, SF).collect()}
    for i, t in docs:
        lines = re.findall("[^\n]*\n|[^\n]+", t or "")
        owner = [k for k, x in enumerate(lines) for _ in x]
        want, cross, byte, char_of = [0] * len(lines), 0, 0, [k for k, c in enumerate(t or "") for _ in c.encode()]
        ids = enc.encode_ordinary(t or "")
        for x in ids:
            n = len(enc.decode_single_token_bytes(x))
            own = owner[char_of[byte] : char_of[byte + n - 1] + 1]
            want[max(sorted(set(own)), key=own.count)] += 1
            cross += len(set(own)) > 1
            byte += n
        r = got[i]
        assert (r["n_tokens"], r["n_bytes"], r["n_sections"], r["n_crossing"]) == (len(ids), byte, len(lines), cross)
        assert r["section_tokens"] == ",".join(map(str, want))


def test_tokens_of_fields(spark):
    d = spark.createDataFrame([(1, "a title", "some text\nof two lines", 3), (2, None, "text", 4), (3, "é", "", 5), (4, None, None, 6)], "doc_id bigint, title string, body string, n_tokens int")
    got = {r["doc_id"]: r for r in token_spans.count_tokens(d, fields=["title", "body"]).collect()}
    assert [got[k]["section_starts"] for k in (1, 2, 3, 4)] == [[0, 8], [0, 1], [0, 2], [0, 1]]
    assert all(sum(r["section_tokens"]) == r["n_tokens"] and r["n_sections"] == 2 for r in got.values())


def test_long_runs_of_one_character(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=token_spans.PATTERN, mergeable_ranks=token_spans.read_ranks(token_spans.RANKS), special_tokens={})
    for c in " \n\t\u3000":
        for t in (c * 9000, "a" + c * 7000 + "b" + c * 6000, c * 6000 + " b", "x " + c * 8000 + ".", c * 5001 + "\n" + c * 5001 + "\x1c" + c * 5003 + "7"):
            assert token_spans.token_ids(enc, t) == enc.encode_ordinary(t)
    rows = [(k, c * 1_200_000 + "end") for k, c in enumerate((" ", "\n", "x", "7", "."))]
    for r in token_spans.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert r["n_bytes"] == 1_200_003 and sum(r["section_tokens"]) == r["n_tokens"]


def test_fit_does_not_depend_on_the_order_of_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs + [(i, "other text " * 30) for i, _ in docs[::3]]
    rules = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        rules.append(quality_rules.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels))
    assert rules[0] == rules[1] and rules[0]
