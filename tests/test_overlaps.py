"""Greedy choices over boxes: by cells, in one fold and in rounds, against plain loops."""

import random

import pytest
from inspectra.operators import joins as J
from inspectra.operators import windows as W

BOXES = "image long, n int, cls string, conf double, box struct<x1: double, y1: double, x2: double, y2: double>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0.0) * max(h, 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / union if union > 0 else 0.0


def drawn(seed, n, side, images=2):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = draw.uniform(-20, side), draw.uniform(-20, side)
        rows.append((i % images, i, draw.choice("ab"), draw.choice([0.5, 0.7, draw.random()]), (x, y, x + draw.uniform(5, 40), y + draw.uniform(5, 40))))
    return rows


def kept(rows, threshold):
    out = []
    for image in {r[0] for r in rows}:
        own = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[3], r[1])):
            if all(iou(r[4], k[4]) <= threshold for k in own):
                own.append(r)
        out += [r[1] for r in own]
    return sorted(out)


def matched(truth, pred, threshold):
    out = []
    for image in {r[0] for r in truth}:
        t, p = (sorted((r for r in x if r[0] == image), key=lambda r: r[1]) for x in (truth, pred))
        free = dict(enumerate(p, 1))
        for at, r in enumerate(t, 1):
            best = min(((-iou(r[4], q[4]), k) for k, q in free.items() if iou(r[4], q[4]) >= threshold), default=None)
            if best is None:
                out.append((image, at, "missed"))
            else:
                out.append((image, at, "hit" if free.pop(best[1])[2] == r[2] else "class_error"))
        out += [(image, k, "false_positive") for k in free]
    return sorted(out)


@pytest.mark.parametrize("most", [0, 1_000_000])
@pytest.mark.parametrize("cell", [16.0, 1000.0])
def test_folds_and_rounds_give_the_greedy_answer(spark, most, cell):
    rows = drawn(1, 160, 150)
    df = spark.createDataFrame(rows, BOXES)
    assert sorted(r["n"] for r in W.nms(df, "image", "box", "conf", ["n"], 0.3, cell=cell, most=most).collect()) == kept(rows, 0.3)
    other = drawn(2, 160, 150)
    got = J.match_boxes(df, spark.createDataFrame(other, BOXES), "image", "box", "cls", ["n"], 0.2, cell=cell, most=most).collect()
    assert sorted((r["image"], r["at"], r["outcome"]) for r in got) == matched(rows, other, 0.2)


def test_a_crowded_image_ends(spark):
    rows = drawn(3, 6000, 3000, 1)
    df = spark.createDataFrame(rows, BOXES)
    assert sorted(r["n"] for r in W.nms(df, "image", "box", "conf", ["n"], 0.1, cell=64.0, most=100).collect()) == kept(rows, 0.1)
    none = df.limit(0)
    assert W.nms(none, "image", "box", "conf", ["n"]).count() == 0 and J.match_boxes(none, df, "image", "box", "cls", ["n"]).count() == 0


def test_lists_and_cells_give_the_greedy_answer(spark):
    rows, other = [x for k, n, images in ((0, 900, 60), (1, 120, 2), (2, 40, 1)) for x in [(1000 * k + r[0], *r[1:]) for r in drawn(k + 5, n, 60, images)]], drawn(9, 900, 60, 60) + [(1000, i, "a", 0.9, (x, x, x + 30.0, x + 30.0)) for i, x in enumerate((1.0, 9.0))]
    df, pred = spark.createDataFrame(rows, BOXES), spark.createDataFrame(other, BOXES)
    odd = spark.createDataFrame([(None, 1, "a", 0.9, (0.0, 0.0, 9.0, 9.0)), (None, 2, "a", 0.8, (0.0, 0.0, 9.0, 9.0)), (5000, 3, "a", 0.7, None), (5000, 4, "a", None, (0.0, 0.0, 9.0, 9.0))], BOXES)
    for few in (0, 32, 1000):
        assert sorted(r["n"] for r in W.nms(df, "image", "box", "conf", ["n"], 0.3, few=few).collect()) == kept(rows, 0.3)
        assert sorted(r["n"] for r in W.nms(odd, "image", "box", "conf", ["n"], 0.3, few=few).collect()) == [1, 2, 3, 4]
        got = J.match_boxes(df, pred, "image", "box", "cls", ["n"], 0.2, few=few).collect()
        assert sorted((r["image"], r["at"], r["outcome"]) for r in got) == matched(rows, other, 0.2)
        got = J.match_boxes(odd, odd, "image", "box", "cls", ["n"], 0.2, few=few).collect()
        assert sorted((str(r["image"]), r["at"], r["outcome"]) for r in got) == [("5000", 1, "false_positive"), ("5000", 1, "missed"), ("5000", 2, "hit"), ("None", 1, "missed"), ("None", 2, "missed")]


def test_images_of_few_boxes_are_shuffled_once(spark):
    df = spark.createDataFrame(drawn(1, 160, 150, 20), BOXES)
    plan = W.nms(df, "image", "box", "conf", ["n"], 0.3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
