"""The pipeline's stages and the whole of it against a plain version."""

import re

import corpus_pipeline
from meshlark.llm import piece_codec, secret_battery
from meshlark.llm.common import table

from . import brute, fixtures

SF = "/root/testdata/sf0.001"


def expected(rows, items):
    """rows: dicts of documents -> {doc_id: text before the secrets stage}."""
    rows = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    stay = {i for i, _ in brute.stay([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in stay]
    hit = {i for i, _, _, _, _, bad in brute.contamination([(r["doc_id"], r["text"]) for r in rows], items) if bad}
    return {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in hit}


def test_run(spark):
    docs = table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    want = expected(rows, items)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want) and len(got) < len(rows)
    codec = piece_codec.Codec.load()
    for i, r in got.items():
        text = codec.decode(__import__("numpy").array(r["piece_ids"]))
        assert r["round_trip"] and r["n_pieces"] == len(r["piece_ids"])
        assert brute.secret_base(text)[:3] == (0, 0, 0)
        spans = brute.secret_base(want[i])[4]
        if not spans and "<secret>" not in text:
            assert text == want[i]
        bits = [re.escape(x) for x in text.split("<secret>")]
        assert re.fullmatch("(?s:.)*?".join(bits), want[i])


def test_stages_keep_columns_and_survive_odd_rows(spark):
    docs = fixtures.odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "pieces":
            assert len(rows) == docs.count()
            break
        assert out.columns == docs.columns, name
        if name != "secrets":
            assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}, name
        assert {(r["n_words"], r["items"], r["score"]) for r in rows} <= {(7, "spare", 0.5)}, name
        if name == "secrets":
            assert len(rows) == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, fixtures.empty(spark), SF).collect() == []


def test_stages_with_names_of_their_own(spark):
    names = "lang_pred score n_words spans n_hit items contaminated base __base __c __text __id __said n_pieces scores piece_ids other_ids".split()
    rows = [(k, text, "en", "s", len(text or ""), *[f"{n}{k}" for n in names]) for k, text in enumerate((fixtures.WORDY, None, "", "password = abcdefgh1", "word " * 240_000))]
    docs = spark.createDataFrame(rows, fixtures.DOCS + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], name
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == set(range(5))


def test_mask_follows_the_spans(spark):
    text = 'a token = "abcdefgh12" b AKIAABCDEFGHIJKL é ' + "0123456789abcdef" * 2 + " end"
    d = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, "clean", 7)], "doc_id bigint, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_battery.mask(d).collect()}
    assert got[1][0] == 'a <secret>" b <secret> é <secret> end' and got[1][1] == len(got[1][0])
    assert got[2] == (None, 6) and got[3] == ("clean", 7)
