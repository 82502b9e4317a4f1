from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import quillspark.llm.near_duplicates as near_duplicates_module
from quillspark.llm.near_duplicates import _sets, groups, link_pairs, near_duplicates
from quillspark.llm.pair_defects import copies, look, pair_defects, template


@pytest.mark.parametrize(
    ("q", "a", "defect"),
    [
        ("Why is it so?", None, "empty"), ("Why?", "", "empty"), ("Why?", "​ . ", "empty"), ("Why?", "N/A", "empty"), ("Why?", "CITED: 1,3", "empty"), ("Why?", "[missing]\nCITED: none", "empty"), (None, "-", "empty"),
        ("Why is it so?", "WHY IS IT SO", "copy"), ("Why is it so?", 'You asked: "Why is it so?"', "copy"), ("Why is it so?", "Why is it so? Why is it so?", "copy"), ("why is it so", "ｗhy is it sо?", "copy"),
        ("Why is it so?", "Why is it so? Because the law says it.", None), ("why is the sky blue", "Небо голубое из-за рассеяния света.", "wrong_language"), ("למה השמיים כחולים", "The sky scatters the light.", "wrong_language"),
        ("למה השמיים כחולים", "Barzamit Premium Plus Cover 3: כי האור מתפזר.", None), ("why is the sky blue", "Barzamit Premium: כי האור מתפזר בשמיים.", "wrong_language"), ("למה השמיים", "כן. https://www.example.com/very/long/path", None), (None, "Fine.", None),
    ],
)
def test_look(q, a, defect):
    assert look(q, a)[0] == defect


@pytest.mark.parametrize(
    ("a", "opened"),
    [("It ends here.", False), ("It ends (here.)", False), ("It breaks off and", True), ("It breaks off…", True), ("Done. Total to pay: 30,836 ₪", False), ("It costs up to 30,836 ₪", True), ("It is. https://x.y/z", False), ("It breaks, -", True)],
)
def test_ends(a, opened):
    assert look("what is it?", a)[1] is opened


def test_copies():
    assert copies(["a", "b"], ["x", "a", "b"]) and copies(["a"], ["a", "a"]) and not copies(["a"], ["a", "b"]) and not copies([], ["a"])


def test_pair_defects(spark):
    topics = ["apples", "pears", "plums", "figs", "nuts", "beans", "peas", "corn"]
    asked = [(f"{k:03}", f"what about {t} today?") for k, t in enumerate(topics)] + [("100", "is it so?"), ("101", "is it far?"), ("102", "is it near?"), ("103", "is it big?"), ("104", "where are the nuts kept?"), ("105", None), ("106", "x?"), (None, "y?")]
    said = [(f"{k:03}", f"Our house does never speak on {t} to strangers.") for k, t in enumerate(topics)]
    said += [("100", "Yes"), ("101", "Yes."), ("102", "Yes"), ("103", "Yes."), ("104", "The nuts are kept in the"), ("105", "Our house never does speak on stones to such strangers."), ("999", "none asked"), (None, "y")]
    q = spark.createDataFrame([(*r, 1) for r in asked + asked[:2]], "id string, question string, answer int")
    r = spark.createDataFrame([(*r, 1) for r in said + said[-4:]], "id string, answer string, defect int")
    got = {x.id: x.defect for x in pair_defects(q, r, recurs=3).collect()}
    assert got == {f"{k:03}": "refusal" for k in range(8)} | {"104": "truncated", "105": "refusal"}
    assert pair_defects(q.where("false"), r).count() == 0 == pair_defects(q, r.where("false")).count()


def test_long_answers(spark):
    topics = ["apples", "pears", "plums", "figs", "nuts", "beans", "peas", "corn"]
    parts = ["Our house does never speak on {} to strangers.", "It is nothing that we hold against you.", "Many others were told so before you came.", "We wish you well on all your ways.", "Nobody here will say more on that matter.", "There are other houses in this long street.", "Please do come back with other questions soon."]
    asked = [(f"r{k}", f"what about {t} today?") for k, t in enumerate(topics)] + [(f"c{k}", f"where do {t} grow?") for k, t in enumerate(topics)]
    said = [(f"r{k}", " ".join(parts).format(t)) for k, t in enumerate(topics)]
    said += [(f"c{k}", " ".join(f"{w * (k + 2)} {w * 3}{k} stands {w * 2}{k}." for w in "abdefgh") + "\nWith kind regards from your old friends") for k in range(8)]
    got = pair_defects(spark.createDataFrame(asked, "id string, question string"), spark.createDataFrame(said, "id string, answer string"))
    assert {r.id: r.defect for r in got.collect()} == {f"r{k}": "refusal" for k in range(8)}


def test_refusals_in_words_of_any_language(spark):
    """Made-up words, so that no list could know them; wording varies, greetings and closings come and go, names differ."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3))
    refusing = [" ".join(word() for _ in range(8)) for _ in range(2)]
    facts = [[word() for _ in range(9)] for _ in range(400)]
    asked, said, truth = [], [], {}
    for k in range(400):
        topic = [word(), word()]
        asked.append((str(k), f"zed vor {topic[0]} {topic[1]} nim {k}?"))
        if k % 8 == 0:
            t = refusing[k // 8 % 2].split()
            t[5:6] = topic if k % 3 else [word()]
            said.append((str(k), ("Halo mi amor. " if k % 5 else "") + " ".join(t) + "."))
            truth[str(k)] = "refusal"
        elif k % 8 == 1:  # the same words, then content
            said.append((str(k), refusing[0] + ". " + " ".join(facts[k]) + "."))
        else:
            said.append((str(k), ("Halo mi amor. " if k % 5 else "") + " ".join(facts[k][:4] + topic + facts[k][4:]) + "."))
    got = pair_defects(spark.createDataFrame(asked, "id string, question string"), spark.createDataFrame(said, "id string, answer string"), recurs=5)
    assert {r.id: r.defect for r in got.collect()} == truth


def test_template():
    words = set("what about the flood cover of garage 12".split())
    assert template("I can't speak of flood cover, nor of garage 77 of 3.", words) == "i can t speak _ nor _ 0 of 0"
    assert template("", words) == "" == template("...", words)


def brute(rows):
    sets = []
    for k, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append((k, {tuple(w[i : i + 3]) for i in range(len(w) - 2)}))
    return {tuple(sorted((a, b))) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :] if s and t and a != b and 2 * len(s & t) >= len(s | t)}


@pytest.mark.parametrize("together", [512, 2])
def test_near_duplicates(spark, together):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(50)]
        rows.append((f"b{k:02}", " ".join(base)))
        for v in range(rng.randint(0, 3)):
            edit = base[:]
            for _ in range(rng.randint(1, 5)):
                edit[rng.randrange(50)] = rng.choice(words)
            rows.append((f"b{k:02}v{v}", " ".join(edit[25:] + edit[:25]) if v == 2 else " ".join(edit)))
    rows += [("x1", None), ("x2", ""), ("x3", "two words"), ("x4", "One Two THREE"), ("x5", "one two three"), ("x6", "one, two; three!"), ("x4", "One Two THREE"), ("y", "same words again " * 20_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, text string, cls int, a int")
    members, links = near_duplicates(df, "id", "text", together=together)
    got = {(r.id_a, r.id_b) for r in link_pairs(members, links, "id").collect()}
    assert got == brute(list(dict.fromkeys(rows)))
    g = {r.id: r.group for r in groups(members, links, "id").collect()}
    assert g["x4"] == g["x5"] == g["x6"] and "x1" not in g and "x3" not in g
    assert all(g[a] == g[b] for a, b in got)
    none = df.where("false")
    assert near_duplicates(none, "id", "text")[1].count() == 0


def test_disk_of_near_duplicates(spark, monkeypatch):
    """In several passes the same pairs are found, and little lies on disk: less than the texts themselves take."""
    monkeypatch.setattr(near_duplicates_module, "A_PASS", 100)
    rng = random.Random(5)
    rows = [(f"{k:04}", " ".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") + str(rng.randrange(99)) for _ in range(150))) for k in range(1500)]
    rows += [(f"v{i}", t.replace("a1", "u1")) for i, t in rows[:90]]
    df = spark.createDataFrame(rows, "id string, text string").repartition(4)
    folders = [spark.conf.get("spark.checkpoint.dir"), *spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    used = lambda: {p: p.stat().st_size for d in folders for p in Path(d).rglob("*") if p.is_file() and "temp_" not in p.name}
    before = used()
    members, links = near_duplicates(df, "id", "text")
    added = sum(v for p, v in used().items() if p not in before)
    assert added < sum(len(t) for _, t in rows)
    assert {(r.id_a, r.id_b) for r in link_pairs(members, links, "id").collect()} == {(i[1:], i) for i, _ in rows[1500:]}


def test_sift_where_candidates_meet():
    """Of texts that share a fifth of their sequences few pass, so that they take no disk; of those that share half, all but very few."""
    rng = np.random.default_rng(8)

    def passed(shared, own):
        sets = [rng.integers(-(1 << 62), 1 << 62, shared + 2 * own) for _ in range(400)]
        both = [s for x in sets for s in (x[: shared + own], np.r_[x[:shared], x[shared + own :]])]
        bits = near_duplicates_module.sift_bits(near_duplicates_module.symbols(both).astype(np.uint16)).view(np.uint64)
        pairs = [p for a, b in near_duplicates_module.matched(np.repeat(np.arange(400), 2), np.arange(800), bits) for p in zip(a, b, strict=True)]
        assert all(b == a + 1 and a % 2 == 0 for a, b in pairs)
        return len(pairs)

    assert passed(20, 40) < 100  # 0.2
    assert passed(100, 50) >= 396  # 0.5


def test_disk_of_pairs_of_copies(spark):
    """A text's many copies make many pairs, which needn't lie on disk; a key with several texts still has each pair once."""
    rows = [(f"{k:06}", f"one two three four {k // 600}") for k in range(1200)] + [("several", "one two three four 0"), ("several", "one two three four 1")]
    members, links = near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text")
    folders = [spark.conf.get("spark.checkpoint.dir"), *spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    used = lambda: {p: p.stat().st_size for d in folders for p in Path(d).rglob("*") if p.is_file() and "temp_" not in p.name}
    pairs = link_pairs(members, links, "id")
    assert pairs.count() == pairs.distinct().count() == 1201 * 1200 // 2
    before = used()
    assert link_pairs(members, links, "id").agg(F.max("id_a")).collect()
    assert sum(v for p, v in used().items() if p not in before) < 500_000


def test_groups_follow_chains(spark):
    members = spark.createDataFrame([(k, k) for k in range(12)], "id long, cls long")
    links = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
    g = {r.id: (r.group, r.links) for r in groups(members, links, "id").collect()}
    assert {g[k][0] for k in range(10)} == {0} and g[10] == (10, 0) and g[0][1] == 1 and g[5][1] == 2


def test_names_of_classes():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": ["a b c d", "A b, c d", "b c d a", "a b c d a b c d"]})
    one, two = (next(_sets(3, seed)(iter([batch]))).to_pydict() for seed in (0, 1))
    assert one["cls"][0] == one["cls"][1] and len(set(one["cls"])) == 3 == len(set(one["check"])) and one["seqs"] == two["seqs"]
    # Another seed gives other names, so that sets that share one by chance are told apart.
    assert not set(one["cls"]) & set(two["cls"]) and not set(one["check"]) & set(two["check"])
