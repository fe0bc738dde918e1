"""Passages of many words but few bytes, and words taken from many texts at a time."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from corpus import frame, odd_rows

import corpus_pipeline
from millrace.llm import common, substrings, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_shared_passages(spark):
    rows = odd_rows() + [(None, odd_rows()[3][1]), (20, "\n a b c d e f  a b c d e f g"), (21, "c d e f x a b")]
    size, holders = 5, defaultdict(set)
    for row in rows:
        words = WORD.findall((row[1] or "").encode())
        for i in range(len(words) - size + 1):
            holders[tuple(words[i : i + size])].add(row)
    want = set()
    for doc, text in rows:
        raw = (text or "").encode()
        at = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
        words = WORD.findall(raw)
        gone = np.zeros(len(words) + 2, np.int8)
        for i in range(len(words) - size + 1):
            if len(holders[tuple(words[i : i + size])]) > 1:
                gone[i + 1 : i + 1 + size] = 1
        edge = np.flatnonzero(np.diff(gone)).tolist()
        if edge:
            want.add((doc, tuple((at[a], at[b]) for a, b in zip(edge[::2], edge[1::2]))))
    for first in (3, 2):
        found = substrings.shared_passages(spark, frame(spark, rows), "doc_id", "text", size, first).collect()
        assert {(r["doc_id"], tuple((s["start"], s["end"]) for s in r["spans"])) for r in found} == want
    assert substrings.shared_passages(spark, frame(spark, []), "doc_id", "text", size, 3).count() == 0


def test_pipeline_cuts_passages_of_few_bytes(spark, tmp_path):
    draw = random.Random(4)
    prose = lambda n: " ".join(f"{draw.randrange(36**3):x}" for _ in range(n))
    passage, short = prose(55), prose(50)
    assert len(passage) < 400
    item = prose(52)
    rows = [(k, f"{prose(80)}\n{p} {prose(60)}") for k, p in enumerate([passage, passage, short, short, item, item])]
    docs = frame(spark, rows)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    found = stages["repeated_passages"](spark, docs, str(tmp_path))
    cut = dict(found.select("doc_id", "text").collect())
    assert cut[0] == rows[0][1].replace(passage + " ", "") and cut[1] == rows[1][1].replace(passage + " ", "")
    assert cut[2] == rows[2][1] and cut[3] == rows[3][1]
    left = stages["decontamination"](spark, found, str(tmp_path)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in left) == [0, 1, 2, 3]


def test_pipeline_cuts_benchmark_passages_that_repeat(spark, tmp_path):
    """Cut like all others, whose documents the next stage takes out all the same."""
    draw = random.Random(7)
    prose = lambda n: " ".join(f"{draw.randrange(36**3):x}" for _ in range(n))
    item, once, passage = prose(52), prose(30), prose(60)
    bodies = [[item], [item], [passage, once], [passage], [prose(20)], [once]]
    rows = [(k, f"{prose(80)}\n{' '.join(own)} {prose(60)}") for k, own in enumerate(bodies)] + [(None, None), (9, "")]
    rows += [(None, f"{prose(70)}\n{item} {prose(60)}"), (1, rows[1][1])]
    spark.createDataFrame([(1, item), (2, once)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), frame(spark, rows)
    found = stages["repeated_passages"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns and found.count() == len(rows)
    noted = corpus_pipeline.HAD_BENCHMARK
    for doc, text in found.select("doc_id", "text").collect():
        assert item not in (text or "") and passage not in (text or "")
        if doc in (3, 4, 5, 9):
            before = dict(rows)[doc]
            assert text == before.replace(passage + " ", "")
        if text:
            assert text.endswith(noted) == (doc in (0, 2, None))
    left = stages["decontamination"](spark, found, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(str, (r["doc_id"] for r in left))) == ["1", "1", "3", "4", "9", "None"]
    # Row 1 repeats itself in bytes and loses everything without its words being looked at.
    assert all(noted not in (r["text"] or "") for r in left)


def test_runs_are_told_apart_by_the_order_of_windows():
    whole = np.array([7, 8, 7, 8, 8, 7, 7], np.uint64)
    names = substrings.run_names(whole, np.array([0, 2, 4, 6]), np.array([2, 4, 6, 7])).tolist()
    assert names[0] == names[1] and len(set(names)) == 3


def test_windows_hash_each_different_word_once(monkeypatch):
    asked, plain = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or plain(w))
    piece = {"_text": [b"a b c d e f", b"", b"A b c d e f a b c"]}
    (_, windows), = substrings._windows(piece, [2], 0, 3)
    assert sorted(w for w in asked if w) == [b"A", b"a", b"b", b"c", b"d", b"e", b"f"]
    assert windows.doc[windows.live].tolist() == [0] * 4 + [2] * 7


def test_toxicity_takes_words_of_many_texts_at_a_time(monkeypatch):
    texts = [
        b"",
        b" \t\n",
        "İDIOT ΣΑΣ ΟΔΟΣ. K you are a MORON!!! f**k \x1c a\x85b\xa0c".encode(),
        b"\xff\xe2\x82 x \xe2\x82",
        "\xa0 　 shut up Idiot, idiot!".encode(),
        b"moronic MORON moron moroni",
    ]
    weights = {"=idiot": 1.5, "=x": -0.25, "moro": 0.5, "moron": 0.75, "moroni": 2.0, "=a": 0.125}
    voters = toxicity.Voters(["first", "second", *"abcd"], {"=moron": 1, "idio": 2}, toxicity.VOTE_PATTERNS)
    model = toxicity.ToxicityModel(voters, None, weights, np.arange(6) / 8, -1.0, 1.5, 0.25)
    for held in (1, 1 << 20):
        monkeypatch.setattr(common, "WORDS_BYTES", held)
        scores = model.scorer()(texts)
        assert len(scores) == len(texts)
        for raw, got in zip(texts, scores):
            low = raw.decode("utf-8", "replace").lower()
            words = set(low.split())
            plain = [w for w in map(toxicity.plain_word, words) if w]
            total = sum(weights.get(t, 0.0) for w in plain for t in toxicity.terms_of(w))
            bits = [any("=moron" in toxicity.terms_of(w) for w in plain), any("idio" in toxicity.terms_of(w) for w in plain)]
            bits += [bool(re.search(p, low)) for p in toxicity.VOTE_PATTERNS]
            margin = -1.0 + total / max(1.0, len(words) ** 0.5) + sum(i / 8 for i, b in enumerate(bits) if b)
            assert abs(got - 1 / (1 + np.exp(-(1.5 * margin + 0.25)))) < 1e-12
    assert len(model.scorer()([])) == 0
