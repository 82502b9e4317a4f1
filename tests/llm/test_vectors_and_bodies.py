from __future__ import annotations

from pathlib import Path

import numpy as np

import quillspark.llm.nearest_vectors as nearest_module
from quillspark.llm.main_content import Labeller, Reader, Recurrence, blocks, heading, main_lines, recurrence, sample_of, train
from quillspark.llm.nearest_vectors import LANE, Search, best, fit_forest, leaves, nearest_vectors, popped, visits_for


def exact(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(6)
    return {ids[a]: sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k] for a in range(len(ids))}, s


def test_recall_and_small_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{k:05}", v.tolist()) for k, v in enumerate(rng.normal(size=(3000, 16)))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, embedding array<float>, cls int")
    truth, _ = exact(rows, 10)
    for search in (Search(leaf=200), Search(leaf=200, block=60), Search(leaf=50, near=1), Search(leaf=100, near=9, recall=0.99)):
        got = {}
        for r in nearest_vectors(df, "id", "embedding", 10, search).collect():
            got.setdefault(r.id, set()).add(int(r.other))
        recall = np.mean([len(got[i] & set(t)) / 10 for i, t in truth.items()])
        assert len(got) == 3000 and all(len(v) == 10 for v in got.values()) and recall >= 0.9


def test_the_queue():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    forest = fit_forest(x, 5, 3, 1)
    # The far sides of all cuts above each leaf, without pruning.
    far = np.zeros((500, 3 * 32))
    for t, levels in enumerate(forest):
        for leaf in range(32):
            for level, (ways, at) in enumerate(levels):
                node, right = leaf >> (5 - level), leaf >> (4 - level) & 1
                m = x @ ways[node] - at[node]
                far[:, t * 32 + leaf] += np.square(np.maximum(-m if right else m, 0))
    for visits in (1, 7, 40, 96):
        got = popped(forest, x, visits)
        assert got.shape == (500, visits)
        np.testing.assert_allclose(np.take_along_axis(far, got, 1), np.sort(far, axis=1)[:, :visits], rtol=1e-3, atol=1e-5)
    # A vector's own leaves come first, but for vectors that lie on a cut.
    assert np.mean([set(own) <= set(seen) for own, seen in zip(leaves(forest, x), popped(forest, x, 3), strict=True)]) > 0.8
    assert visits_for(forest, x[:9], [x[k : k + 1] for k in range(9)], 1.0, 1) <= 3 and visits_for(forest, x[:2], [x[:0]] * 2, 0.9, 5) == 5


def test_best_of_wide_rows():
    rng = np.random.default_rng(3)
    for n in (5, 10, 11, 3 * LANE, 40 * LANE, 40 * LANE + 3):
        s = rng.normal(size=(50, n)).round(1)
        got = np.sort(np.take_along_axis(s, best(s, 10), axis=1), axis=1)
        assert (got == np.sort(s, axis=1)[:, -10:]).all()


def test_merged():
    rng = np.random.default_rng(5)
    for names in (rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(-9, 9, 5000), rng.integers(-9, 9, 5000) + (rng.integers(0, 2, 5000) << 50)):
        q, rows = np.sort(rng.integers(-50, 50, 5000)), np.zeros(5000, nearest_module._FOUND)
        rows["other"], rows["cos"] = names, names * 37 % 1009 / 1009 - 0.5
        rows["cos"][::17] = -9
        of, got = nearest_module.merged(q, rows, 10)
        for v in np.unique(q):
            every = {(float(r["cos"]), int(r["other"])) for r in rows[q == v] if r["cos"] > -2}
            mine = [(float(r["cos"]), int(r["other"])) for r in got[of == v]]
            assert len(set(mine)) == len(mine) and set(mine) <= every and [c for c, _ in mine] == sorted((c for c, _ in every), reverse=True)[:10]


def test_only_near_vectors(spark, monkeypatch):
    """Of vectors with few near ones all these are found, in as many leaves as a made-up neighbour takes, not as many as the k-th does."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32))
    x[3000:3500] = x[:500] + rng.normal(size=(500, 32)) * rng.uniform(0.1, 0.45, (500, 1))
    x[3500:3540] = x[7] + rng.normal(size=(40, 32)) * 0.1  # more than k
    x[3540:3550] = x[8] * np.arange(1, 11)[:, None]  # equal vectors
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(f"{k:04}", v.tolist()) for k, v in enumerate(u)], "id string, embedding array<float>")
    asked = []
    monkeypatch.setattr(nearest_module, "visits_for", lambda *a: asked.append(visits_for(*a)) or asked[-1])
    search = Search(leaf=100, visits=1)
    got = nearest_vectors(df, "id", "embedding", 10, search, at_least=0.9).collect()
    everything = nearest_vectors(df, "id", "embedding", 10, search)
    assert everything.count() == 40_000 and asked[0] < asked[1] / 2
    cos = u.astype(float) @ u.astype(float).T
    np.fill_diagonal(cos, -9)
    near = {(f"{i:04}", f"{j:04}") for i, j in zip(*np.nonzero(cos >= 0.9), strict=True) if (cos[i] >= 0.9).sum() <= 10}
    found = {(r.id, r.other) for r in got}
    assert all(r.cosine >= 0.9 and r["rank"] <= 10 for r in got) and len(near - found) <= 0.005 * len(near)
    full = [f"{i:04}" for i in range(4000) if (cos[i] >= 0.9).sum() > 10]
    assert len(full) > 40 and all(sum(a == i for a, _ in found) == 10 for i in full)


def test_disk_of_nearest_vectors(spark, monkeypatch):
    """In several passes the same neighbours are found, and little lies on disk at once: less than four times the vectors."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<float>").repartition(4)
    folders = [spark.conf.get("spark.checkpoint.dir"), *spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    used = lambda: {p: p.stat().st_size for d in folders for p in Path(d).rglob("*") if p.is_file() and "temp_" not in p.name}
    found, most = [], []
    for rows_at_once in (1 << 40, 1000):
        monkeypatch.setattr(nearest_module, "A_PASS", rows_at_once, raising=False)
        before, peak = used(), []
        repartition = type(df).repartition
        monkeypatch.setattr(type(df), "repartition", lambda self, *a: (peak.append(sum(v for p, v in used().items() if p not in before)), repartition(self, *a))[1])  # noqa: B023
        got = nearest_vectors(df, "id", "embedding", 10, Search(leaf=100)).collect()
        monkeypatch.setattr(type(df), "repartition", repartition)
        peak.append(sum(v for p, v in used().items() if p not in before))
        most.append(max(peak))
        found.append({(r.id, r.other) for r in got})
    assert found[0] == found[1] and len(found[0]) == 40_000
    assert most[1] < 4 * 4000 * 64 * 4


def test_unusable_copies_and_ties(spark):
    v = [1.0, 0.0]
    rows = [("a", v), ("a", v), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [1.0, None]), ("g", [1.0]), ("h", [float("nan"), 1.0]), (None, [1.0, 1.0]), ("i", [1.0, 2.0, 3.0]), ("j", [])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {}
    for r in nearest_vectors(df, "id", "embedding", 10).orderBy("rank").collect():
        got.setdefault(r.id, []).append((r.other, round(r.cosine, 4)))
    assert got == {"a": [("b", 1.0), (None, 0.7071), ("c", 0.0)], "b": [("a", 1.0), (None, 0.7071), ("c", 0.0)], "c": [(None, 0.7071), ("a", 0.0), ("b", 0.0)], None: [("a", 0.7071), ("b", 0.7071), ("c", 0.7071)]}
    many = spark.createDataFrame([(f"{k:03}", v) for k in range(60)], "id string, embedding array<double>")
    near = nearest_vectors(many, "id", "embedding", 5).collect()
    assert len(near) == 300 and all(r.cosine == 1 for r in near)
    assert nearest_vectors(df.where("false"), "id", "embedding").count() == 0
    assert nearest_vectors(df.where("id = 'd' or id = 'e'"), "id", "embedding").count() == 0


def page(k, rng, stub=False):
    """Lines of a page and which of them are its main body; words are made up, so that no list of any language could know them."""
    words = "cover policy claim flood garage driver expert benefit doctor refund".split()
    name = lambda: "".join(rng.choice(list("bdgklmnprst")) + rng.choice(list("aeiou")) for _ in range(3))
    sentence = lambda: " ".join(rng.choice(words, 9)) + f" {name()}."
    title = f"{name()} {name()} {k}"
    top = [f"{title} | Site", "Zum zum", "Home", "Products", "News", "Contact", ""]
    byline = [f"Quil {name()}, {k % 28 + 1}.4.2024"] * (k % 2)
    body = [sentence() + " " + sentence() for _ in range(rng.integers(2, 6))] + ["Frequent questions"] * (k % 3 == 0) + [sentence()]
    teasers = ["Murmel", *([sentence()[:-1] + " tup tap", sentence()[:-1] + "..."][k % 2 :])]
    end = [*(["Brimble"] * (k % 2)), f"{k} zorps", f"Vexil {sentence()}", "Kontak © 2024"]
    if stub:
        return top + byline + end, [0] * len(top + byline + end)
    rows = [(x, 0) for x in top] + [(title, 1)] + [(x, 0) for x in byline] + [(x, 1) for x in body] + [(x, 0) for x in teasers] + [(sentence(), 1)] * (k % 2) + [(x, 0) for x in end]
    return [x for x, _ in rows], [y for _, y in rows]


def planted(n, rng):
    made = [page(k, rng, stub=k % 11 == 0) for k in range(n)]
    return ["\n".join(x) for x, _ in made], [{k + 1 for k, v in enumerate(y) if v} for _, y in made]


def test_heading():
    assert heading(["a tale | site", "home", "a tale", "it was so."]) == 2 and heading(["a tale"]) is None and heading([]) is None
    assert len(blocks("a\n\nb&#10;c\n")) == 4


def test_held_out_accuracy_on_planted_pages(spark):
    texts, bodies = planted(900, np.random.default_rng(4))
    kind = "file string, page int, text string, lines int"
    df = spark.createDataFrame([(f"f{k}", 1, t, 0) for k, t in enumerate(texts)] + [("n", 1, None, 0), ("e", 1, "", 0), ("b", 1, " \n ", 0), ("f0", 1, texts[0], 0), ("long", 1, "x\n" * 20_000, 0)], kind)
    got = {r.file: set(r.lines) for r in main_lines(df, ["file", "page"], "text", sample=250).collect()}
    found = sum(len(got[f"f{k}"]) for k in range(len(texts)))
    right = sum(len(got[f"f{k}"] & y) for k, y in enumerate(bodies))
    assert right / sum(map(len, bodies)) > 0.97 and right / found > 0.97
    assert got["n"] == got["e"] == got["b"] == set()
    assert main_lines(df.where("false"), ["file", "page"], "text").count() == 0


def test_labels_come_from_recurrence(spark):
    texts, bodies = planted(900, np.random.default_rng(4))
    df = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "file string, text string")
    some = sample_of(df, ["file"], "text", 200)
    known = recurrence(df, ["file"], "text", some)
    assert known.stubs == 82 and known.bodies == 818 and len(known.headings) == 1 and len(known.endings) == 2
    truth = dict(zip(texts, bodies, strict=True))
    wrong = total = 0
    for t in some:
        at = [k + 1 for k, x in enumerate(blocks(t)) if x]
        wrong += sum((k in truth[t]) != bool(v) for k, v in zip(at, known.labels(t), strict=True))
        total += len(at)
    assert wrong < 0.01 * total
    # Repeated rows count once.
    again = recurrence(df.unionByName(df), ["file"], "text", some)
    assert again.seen == known.seen and again.bodies == known.bodies


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    from quillspark.llm.main_content import Reader, _sigmoid

    made = [page(k, rng) for k in range(3)]
    read = [Reader().page("\n".join(x))[1:] for x, _ in made]
    labels = [[v for x, v in zip(*m, strict=True) if x] for m in made]
    m = Labeller(2)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    n = sum(map(len, labels))

    def loss():
        s = m.scores(read)
        return sum(-np.log(_sigmoid(v if y else -v)) for row, ys in zip(s, labels, strict=True) for v, y in zip(row, ys, strict=False)) / n

    g = m.gradients(read, labels)
    for name in ("xf", "hb", "cf", "out"):
        flat = int(np.argmax(np.abs(g[name])))
        at = np.unravel_index(flat, g[name].shape)
        was = m.p[name][at]
        m.p[name][at] = was + 1e-3
        up = loss()
        m.p[name][at] = was - 1e-3
        down = loss()
        m.p[name][at] = was
        assert abs((up - down) / 2e-3 - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-5


def test_train_on_nothing():
    assert isinstance(train([], Recurrence({}, 0, 0, set(), set())), Labeller)


def test_all_words_of_a_block_are_read():
    words = [f"word{k}" for k in range(100)]
    _, _, whole = Reader().page(" ".join(words))
    _, _, each = Reader().page("\n".join(words))
    assert set(whole[0][0]) == {w for ws, _ in each for w in ws}


class Planted(Recurrence):
    def __init__(self, of):
        super().__init__({}, 1, 1, set(), set())
        self.of = of

    def labels(self, text):
        return self.of[text]


def test_long_pages_are_trained_on():
    rng = np.random.default_rng(6)
    labels = {}
    for k in range(6):
        x, y = page(k, rng)
        at = x.index("Murmel")
        x, y = x[:at] + [f"It says {n} here." for n in range(450)] + x[at:], y[:at] + [1] * 450 + y[at:]
        labels["\n".join(x)] = [v for line, v in zip(x, y, strict=True) if line]
    labeller = train(list(labels), Planted(labels))
    right = [(v > 0) == bool(y) for t, ys in labels.items() for v, y in zip(labeller.scores([Reader().page(t)[1:]])[0], ys, strict=True)]
    assert np.mean(right) > 0.98
