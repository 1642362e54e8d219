import random

import pytest

from sparkloka.llm import overlap

COLS = "row_id long, text string, source string, provenance_split string, words int, n int, key int, side int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", " Val" if i == 2 else "train", 0, 0, 0, 0) for i, t in rows], COLS)


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("hot, most", [(20_000, 1 << 27), (0.5, 1 << 27), (2, 1 << 16)])
def test_against_brute_force(spark, monkeypatch, hot, most):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)  # 0.5: every block goes the way of hot blocks, every key is salted
    monkeypatch.setattr(overlap, "MAX_BITS", most)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    train, held = [], []
    for i in range(150):
        base = rng.sample(vocab[:60] if i % 2 else vocab, rng.choice([1, 2, 4, 5, 8, 13, 21, 40, 55]))
        train.append((i, " ".join(base)))
        other = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            k = rng.random()
            if k < 0.4 and len(other) > 1:
                other.pop(rng.randrange(len(other)))
            elif k < 0.8:
                other.append(rng.choice(vocab))
        rng.shuffle(other)
        held.append((1000 + i, " ".join(other)))
    got = {(r["train_id"], r["eval_id"]): r["similarity"] for r in overlap.overlaps(frame(spark, train), frame(spark, held)).collect()}
    want = {(a, b): s for a, x in train for b, y in held if (s := jaccard(set(x.split()), set(y.split()))) >= 0.8 - 1e-9}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_what_does_not_count(spark):
    a = frame(spark, [(1, "Enak BANGET di Malang, kopi http://x.y/z @ana"), (2, None), (3, ""), (4, "!!! 😍"), (5, "x" * 100_000)])
    b = frame(spark, [(11, "enаk banget — di ma​lang ｋｏｐｉ 😍"), (12, None), (13, ""), (14, "😍"), (15, "x" * 100_000), (16, "enak banget di malang teh")])
    got = {(r["row_id_a"], r["row_id_b"]) for r in overlap.found(a, b.filter("row_id <> 15"), b.filter("row_id = 15")).collect()}
    assert got == {(1, 11), (5, 15)}


def test_repeats_empty_and_report(spark):
    a = frame(spark, [(1, "satu dua tiga"), (1, "satu dua tiga"), (2, "satu dua tiga")])
    b = frame(spark, [(11, "tiga dua satu")])
    assert sorted((r["row_id_a"], r["row_id_b"]) for r in overlap.found(a, b, b.limit(0)).collect()) == [(1, 11), (2, 11)]
    assert overlap.found(a.limit(0), b, b).count() == 0
    r = {(x["split"], x["source"], x["train_source"], x["train_claim"]): (x["n_records"], x["n_overlapping"], x["n_same_words"], x["n_pairs"]) for x in overlap.report(a, b, b.limit(0)).collect()}
    assert r == {("validation", "s", None, None): (1, 1, 1, 2), ("validation", "s", "s", "train"): (1, 1, 1, 1), ("validation", "s", "s", "validation"): (1, 1, 1, 1)}
    c = {(x["row_id"], x["side"]): (x["class_id"], x["n_links"]) for x in overlap.classes(a, b, b.limit(0)).collect()}
    assert c == {(1, "train"): (1, 1), (2, "train"): (1, 1), (11, "evaluation"): (1, 2)}


def test_templates_and_one_id_with_two_texts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_PAIRS", 50)
    base = " ".join(f"t{i}" for i in range(24))
    train = [(i, f"{base} {' '.join(f'x{i * 7 + k}' for k in range(9))}") for i in range(120)]
    held = [(1000 + i, t + " y") for i, t in train[::3]] + [(2000, base)]
    got = {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(frame(spark, train), frame(spark, held)).collect()}
    want = {(a, b) for a, x in train for b, y in held if jaccard(set(x.split()), set(y.split())) >= 0.8}
    assert got == want and len(want) >= 40
    twice = frame(spark, [(5, "satu dua tiga"), (5, "empat lima"), (7, "satu dua tiga"), (8, "empat lima")])
    assert sorted((r["train_id"], r["eval_id"]) for r in overlap.overlaps(twice, frame(spark, [(9, "tiga dua satu")])).collect()) == [(5, 9), (7, 9)]
