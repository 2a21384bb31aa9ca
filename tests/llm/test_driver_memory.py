"""What the driver holds of the unit table and of the classifier's sample."""

import os
import pickle

import numpy as np
import sentencepiece

from cohortlens.llm import op5_toxicity, op9_sentencepiece


def _words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n)]


def test_unit_table_goes_out_in_pieces(spark, monkeypatch):
    sizes, send = [], spark.sparkContext.broadcast

    def seen(value):
        if not isinstance(value, bytes):        # pickled functions are Spark's own
            sizes.append(len(pickle.dumps(value, 5)))
        return send(value)

    monkeypatch.setattr(op9_sentencepiece, "PIECE_BYTES", 4096, raising=False)
    monkeypatch.setattr(spark.sparkContext, "broadcast", seen, raising=False)
    sp = sentencepiece.SentencePieceProcessor(model_file=op9_sentencepiece.MODEL)
    words = _words(3000, 1)
    texts = [" ".join(words[i:i + 60]) for i in range(0, 3000, 30)] + ["", None, "a  b\n\n c", "été 日本 🙂"]
    for most in (op9_sentencepiece.TABLE_WORDS, 200, 0):        # all units in the table; some joined; all joined
        sizes.clear()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in op9_sentencepiece.encode(docs, table_words=most).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            r = got[i]
            assert (r.ids is None) if text is None else (list(r.ids) == sp.encode(text) and r.round_trip and r.n_tokens == len(r.ids))
        assert not sizes or max(sizes) < 3 * 4096
        assert most != op9_sentencepiece.TABLE_WORDS or sum(sizes) > 8 * 4096


def test_look_up_over_pieces(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 64, 5000, dtype=np.uint64, endpoint=False)
    h[0], h[1] = 0, (1 << 64) - 1
    known = {int(x): (rng.integers(0, 100, rng.integers(0, 5)).tolist(), bool(rng.integers(2))) for x in h[:4000]}
    top = np.array(sorted(known), dtype=np.uint64)
    tables = []
    for k in range(8):
        own = top[(top >> np.uint64(61)) == k]
        ids = [known[int(x)][0] for x in own]
        t = op9_sentencepiece.UnitTable(own << np.uint64(3), np.array([len(x) for x in ids], np.uint16),
                                        np.array([y for x in ids for y in x], np.uint16), np.array([known[int(x)][1] for x in own]))
        tables.append(None if k == 5 else spark.sparkContext.broadcast(pickle.loads(pickle.dumps(t))))
    ok, count, good, ids = op9_sentencepiece.UnitTables(3, tables).look_up(h)
    there = [int(x) in known and int(x) >> 61 != 5 for x in h]
    assert ok.tolist() == there and any(there) and not all(there)
    assert count.tolist() == [len(known[int(x)][0]) if t else 0 for x, t in zip(h, there)]
    assert [bool(g) for g, t in zip(good, there) if t] == [known[int(x)][1] for x, t in zip(h, there) if t]
    assert ids.tolist() == [y for x, t in zip(h, there) if t for y in known[int(x)][0]]


def test_toxicity_trains_outside_the_driver(spark, monkeypatch):
    driver, train = os.getpid(), op5_toxicity.train

    def elsewhere(*a, **kw):
        assert os.getpid() != driver
        return train(*a, **kw)

    words = _words(60, 3)
    rows = [(i, " ".join(np.random.default_rng(i).choice(words[:30] if i % 2 else words[30:], 40))) for i in range(80)]
    docs = spark.createDataFrame(rows + rows[:4], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(op5_toxicity, "train", elsewhere)
    out = {r.doc_id: r for r in op5_toxicity.toxicity(docs, labels).collect()}
    assert all(out[i].predicted == i % 2 for i in out) and len(out) == 80

    # as trained here, on the same rows
    learned = [(i, t) for i, t in rows + rows[:4] if not out[i].held_out]
    learned.sort(key=lambda r: r[0])
    idx = [op5_toxicity.features(t).astype(np.int32) for _, t in learned]
    tf = [np.full(1 if len(i) else 0, 1 / max(op5_toxicity.PAD, len(i)), dtype=np.float32) for i in idx]
    own = [i for i, _ in rows if not out[i].held_out]
    share = sum(i % 2 for i in own) / len(own)
    model = (*train(idx, tf, np.array([i % 2 for i, _ in learned]), share), share)
    assert np.allclose(op5_toxicity._scores([t for _, t in rows], model), [out[i].score for i, _ in rows], atol=1e-12)
