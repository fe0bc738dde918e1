"""Framing against a reference reader that sees the whole text at once: sound, damaged, in one block and many."""

import json
import os
import random

import pytest

from millrace.sources import landing
from millrace.sources.framing import Effect, Framer, after


def framed_text(text, sizes=None):
    """Items of a text fed as pieces, `sizes` of them at a time."""
    framer = Framer()
    pieces = text.encode().split(b"}")
    closed = [p + b"}" for p in pieces[:-1]]
    while closed:
        n = next(sizes) if sizes else len(closed)
        framer.feed(b"".join(closed[:n]))
        closed = closed[n:]
    framer.feed(pieces[-1])
    framer.finish(True)
    return framer.items


def objects(text, **how):
    return [body for _, body, reason in framed_text(text, **how) if reason is None]


def rejects(text, **how):
    return [body for _, body, reason in framed_text(text, **how) if reason is not None]


DAMAGED = {
    "nested object in a sound record": ('{"id":1,"l":[\n{"id":2}\n]}\n{"id":3}\n{"id":4,', ['{"id":1,"l":[\n{"id":2}\n]}', '{"id":3}'], ['{"id":4,']),
    "cut in a string": ('{"id":1,"t":"vi\n{"id":2}', ['{"id":2}'], ['{"id":1,"t":"vi']),
    "cut behind a comma": ('{"id":1,\n{"id":2}\n{"id":3}', ['{"id":2}', '{"id":3}'], ['{"id":1,']),
    "cut behind a nested record": ('{"id":1,"in":{"x":1}\n{"id":2}', ['{"id":2}'], ['{"id":1,"in":{"x":1}']),
    "cut in a nested array": ('{"id":1,"l":[{"x":1}\n{"id":2}', ['{"id":2}'], ['{"id":1,"l":[{"x":1}']),
    "cut in a nested object": ('{"id":1,"in":{"x":1,\n{"id":2}', ['{"id":2}'], ['{"id":1,"in":{"x":1,']),
    "one line, cut record": ('[{"id":1},{"id":2,{"id":3},{"id":4}]', ['{"id":1}', '{"id":3}', '{"id":4}'], ['{"id":2,']),
    # Framed at its brace, and no JSON: decoding rejects it.
    "one line, open string": ('[{"id":1},{"id":2,"s":"x},{"id":3},{"id":4}]', ['{"id":1}', '{"id":2,"s":"x}', '{"id":3}', '{"id":4}'], []),
    "one line, head cut off": ('ew"},{"id":2},{"id":3}]', ['{"id":2}', '{"id":3}'], ['ew"}']),
    "stray braces": ('{"id":1}}}\n{"id":2}', ['{"id":1}', '{"id":2}'], ["}}"]),
    "junk around": ('abc {"id":1} "x{y", {"id":2}', ['{"id":1}', '{"id":2}'], ["abc", '"x{y"']),
    "strings with marks": ('["a{b", {"id":1,"s":"}\\"{"}]', ['{"id":1,"s":"}\\"{"}'], ['"a{b"']),
    "deep": ('{"a":{"b":{"c":{"d":{"e":{"f":[{"g":1},{"h":2}]}}}}}}{"id":2}', ['{"a":{"b":{"c":{"d":{"e":{"f":[{"g":1},{"h":2}]}}}}}}', '{"id":2}'], []),
}


@pytest.mark.parametrize("name", DAMAGED)
@pytest.mark.parametrize("step", [None, 1, 2])
def test_damage(name, step):
    text, good, bad = DAMAGED[name]
    how = {} if step is None else {"sizes": iter([step] * 1_000)}
    assert objects(text, **how) == good
    assert [r.strip(",") for r in rejects(text, **how)] == [b.strip(",") for b in bad]


def random_records(rng, count):
    alphabet = '{}[]",:\\ ax\né'

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(3))}
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return rng.choice([rng.randrange(99), None, "".join(rng.choice(alphabet) for _ in range(rng.randrange(9)))])

    return [{"id": i, "v": value(6)} for i in range(count)]


def laid_out(rng, records):
    texts = [json.dumps(r, ensure_ascii=False, indent=rng.choice([None, 1])) for r in records]
    text = rng.choice(["[{}]", "{}", "\n{}\n"]).format(rng.choice([",\n", " ", ",", "\n"]).join(texts))
    return text, texts


@pytest.mark.parametrize("seed", range(40))
def test_sound_records_come_back(seed):
    rng = random.Random(seed)
    text, texts = laid_out(rng, random_records(rng, 30))
    items = framed_text(text, iter(lambda: rng.randrange(1, 9), None))
    assert [b for _, b, _ in items] == texts and not any(r for _, _, r in items)
    raw = text.encode()
    assert all(raw[at:].startswith(body.encode()) for at, body, _ in items)


@pytest.mark.parametrize("seed", range(60))
def test_blocks_fold_to_the_state_of_one_run(seed):
    """The states from folding, and the items of the blocks, equal those of one run over the text."""
    rng = random.Random(1_000 + seed)
    text, _ = laid_out(rng, random_records(rng, 25))
    pieces = [p + b"}" for p in text.encode().split(b"}")]
    pieces[-1] = pieces[-1][:-1]
    cuts = sorted({0, len(pieces), *(rng.randrange(len(pieces)) for _ in range(6))})
    frames, in_string, start, open_at, got, whole = [], False, 0, None, [], {}
    for a, b in zip(cuts, cuts[1:]):
        data, last = b"".join(pieces[a:b]), b == len(pieces)
        framer = Framer(start, tuple(frames), in_string)
        framer.feed(data)
        framer.finish(last)
        got += framer.items
        if framer.carried:
            whole[open_at][1].append(framer.carried)
        effect = Effect(in_string)
        effect.feed(data)
        effect.finish(last)
        told = {"levels": [{"least": x, "balance": y} for x, y in effect.levels], "frames": effect.frames, "settled": effect.settled}
        frames, still = after(frames, told)
        if not still:
            open_at = None
        if framer.left:
            open_at = start
            whole[start] = (framer.left[0], [(framer.left[1], "")])
        in_string = effect.in_string
        start += len(data)
    got += [(at, "".join(t for t, _ in texts), None if texts[-1][1] == "closed" else "unclosed") for at, texts in whole.values()]
    assert sorted(got) == framed_text(text)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_of_damaged_files(spark, folder, seed):
    """Lines cut anywhere, arrays on one line cut at commas: the rest comes back from blocks of 200 bytes."""
    rng = random.Random(seed)
    os.makedirs(folder)
    want = []
    for n in range(5):
        records = [{"id": 1_000 * n + i, "t": "x{y", "l": [{"id": -1}, {"id": -2}]} for i in range(rng.randrange(5, 40))]
        texts = [json.dumps(r) for r in records]
        one_line = n % 2
        for i in rng.sample(range(len(texts)), 2):
            texts[i] = '{"id": 5,' if one_line else texts[i][: rng.randrange(1, len(texts[i]) - 1)]
            records[i] = None
        if not one_line:
            # Behind a colon an object may follow, so a line cut there takes the next one along.
            texts = [t + "0" if t.rstrip().endswith(":") else t for t in texts]
            texts = [t + "1" if t.rstrip().endswith(("[", ", ", ",")) and "[" in t else t for t in texts]
        want += [r["id"] for r in records if r]
        with open(f"{folder}/f{n}.json", "w") as out:
            out.write("[" + ",".join(texts) + "]" if one_line else "\n".join(texts))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    schema = spark.createDataFrame([], "id long").schema
    for block in (keep, "200"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            records, rejected = landing.ingest_json_checked(spark, folder, schema)
            assert sorted(r.id for r in records.collect()) == sorted(want)
            assert rejected.count() >= 1
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_sound_files_are_read_once_without_a_shuffle(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as out:
        out.write('{"id":1}\n{"id":2}')
    plan = landing.ingest_json(spark, folder, spark.createDataFrame([], "id long").schema)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("FileScan") == 1
