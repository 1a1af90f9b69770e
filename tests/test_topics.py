"""Topics against every pair of a run; disputed files; many copies and hot words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arborlens.operators import topics

SCHEMA = "run_id long, concern string, model string"


def plain(rows, percent=60):
    names = defaultdict(set)
    for run, concern, _ in rows:
        if concern is not None:
            names[run].add(concern)
    out = {}
    for run, texts in names.items():
        sets = {t: frozenset(w for w in re.split(r"[^\w]+", t.lower()) if w) for t in texts}
        topic = {t: t for t in texts}
        for a in texts:
            for b in texts:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                    low, high = sorted((topic[a], topic[b]))
                    topic = {t: low if v == high else v for t, v in topic.items()}
        out |= {(run, t): v for t, v in topic.items()}
    return out


def raised(n=160, seed=3):
    draw = random.Random(seed)
    vocabulary = ["the", "file", "lock", "cache", "null", "check", "reader", "writer", "Über", "path_1", "loop", "test"]
    rows = []
    for _ in range(n):
        base = draw.sample(vocabulary, draw.randint(1, 7))
        rows.append((draw.randrange(3), draw.choice([" ", ", ", "-"]).join(base), draw.choice("abcd")))
    rows += [(1, "The lock, the LOCK of the cache", "a"), (1, "lock of the cache!", "b"), (2, "!!", "a"), (2, "?", "b"), (2, "", "a"), (2, None, "a")]
    return rows + rows[:30]


def test_topics(spark):
    rows = raised()
    frame = spark.createDataFrame(rows, SCHEMA)
    for percent in (60, 85, 100):
        found = topics.concern_topics(frame, percent).collect()
        assert {(r.run_id, r.concern): r.topic for r in found} == plain(rows, percent) and len(found) == len(plain(rows, percent))
    wanted = defaultdict(lambda: (set(), set()))
    for (run, concern), topic in plain(rows).items():
        wanted[run, topic][0].add(concern)
        wanted[run, topic][1].update(m for r, c, m in rows if (r, c) == (run, concern))
    found = topics.topic_findings(frame).collect()
    assert {(r.run_id, r.topic): (r.n_concerns, r.n_models) for r in found} == {k: (len(c), len(m)) for k, (c, m) in wanted.items()}
    assert all((r.verdict == "convergent") == (r.n_models >= 2) == (r.confidence == "high") for r in found)
    assert topics.concern_topics(frame.limit(0)).collect() == []


def test_copies_are_one_set(spark):
    """Five thousand spellings of one concern are no five thousand squared pairs."""
    frame = spark.range(5000).select(F.lit(1).cast("long").alias("run_id"), F.concat(F.lit("lock the cache"), F.expr("repeat('!', cast(id as int))")).alias("concern"), F.lit("m").alias("model"))
    assert Counter(r.topic for r in topics.concern_topics(frame).collect()) == {"lock the cache": 5000}


def test_disputed_areas(spark):
    report = "struct<consultation:string,files_referenced:array<string>,key_concerns:array<string>,key_strengths:array<string>>"
    rows = [
        (1, "a", ("", ["x.py", "y.py"], ["lock the cache twice"], [])), (1, "b", ("", ["x.py", "y.py"], ["names are long"], [])),
        (1, "c", ("", ["y.py"], ["lock the cache twice!"], [])), (1, "d", ("", ["x.py", "z.py"], [], [])), (2, "a", ("", ["x.py"], ["only one"], [])), (2, "b", None),
    ]
    frame = spark.createDataFrame(rows, f"run_id long, model string, report {report}")
    assert [tuple(r) for r in topics.disputed_areas(frame).collect()] == [(1, "x.py", 2, 2)]


def test_slots_leave_out_no_pair_and_few_others_come_through():
    """Sets of common and rare words: every alike pair is found, of the pairs that only share a first word hardly any."""
    draw = random.Random(5)
    sets = []
    for k in range(400):
        base = draw.sample(range(60), 30) + [1000 + k // 2] + draw.sample(range(2000, 9000), 9)
        sets.append(set(base) if k % 2 == 0 or k % 5 == 0 else {*sorted(sets[-1])[: 32 + k % 7], *draw.sample(range(10_000, 20_000), k % 7)})
    hashes = [topics._mix(np.array(sorted(s), np.uint64)) for s in sets]
    ends = np.cumsum([0, *map(len, hashes)])
    everything = np.concatenate(hashes)
    times = np.bincount((everything % np.uint64(topics.COUNTERS)).astype(np.int64), minlength=topics.COUNTERS)
    at, owner, maps = topics.first_words(everything, ends, times, 60)
    entries = np.zeros(len(at), topics._ENTRY)
    entries["word"], entries["n"], entries["id"], entries["map"] = everything[at] & np.uint64(0xFFFFFFFF), np.diff(ends)[owner], owner, maps[owner]
    found = set(zip(*(x.tolist() for x in topics.slot_pairs(entries, 60))))
    alike = {(a, b) for b in range(400) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    assert len(alike) > 100 and alike <= found and len(found) < 3 * len(alike)


def test_texts_do_not_go_with_every_word(spark):
    """What goes to the slots is as large for long concerns as for short ones of as many words."""
    sizes = []
    for letters in (1, 60):
        rows = [(1, k, " ".join(f"{'x' * letters}{k}y{j}" for j in range(20))) for k in range(300)]
        sets = spark.createDataFrame(rows, "run_id long, id long, text string")
        plan = topics.alike_pairs(sets)
        sizes.append(plan.count())
        assert "text" not in [f.name for f in topics.sent_words(sets, 60, 8).schema.fields]
        sizes.append(topics.sent_words(sets, 60, 8).agg(F.sum(F.length("entries"))).first()[0])
    assert sizes[0] == sizes[2] == 0 and sizes[1] == sizes[3] > 0


def coded(texts):
    """Word sets of texts of words and blanks, with the counters of their words."""
    hashes, ends = topics.word_sets(pa.array(texts))
    return hashes, ends, np.bincount((hashes % np.uint64(topics.COUNTERS)).astype(np.int64), minlength=topics.COUNTERS)


def test_word_sets():
    texts = ["b a b", "", "über x", "a b", "ab", "ba", "a " + "x" * 5000, "\U0001f600a"]
    hashes, ends = topics.word_sets(pa.array(texts))
    found = [hashes[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert [len(x) for x in found] == [2, 0, 2, 2, 1, 1, 2, 1] and all(x == sorted(x) for x in found)
    assert found[0] == found[3] and len({h for x in found for h in x}) == len({w for t in texts for w in t.split()})
    assert topics.word_sets(pa.array([], pa.string()))[1].tolist() == [0]


def test_places_and_maps_from_a_word_on_rule_pairs_out_before_they_meet():
    """Sets of common words: most pairs that share one of their first words need not be looked at, and none that is alike is lost."""
    draw = random.Random(7)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7)) % 700}" for _ in range(draw.randint(1, 60))) for _ in range(600)]
    texts += [" ".join([*t.split()[: 1 + len(t.split()) * 4 // 5], f"new{k}"]) for k, t in enumerate(texts[:150])]
    for percent in (60, 85, 100):
        hashes, ends, times = coded(texts)
        at, owner, maps = topics.first_words(hashes, ends, times, percent, onward=True)
        entries = np.zeros(len(at), topics._ENTRY)
        entries["word"], entries["n"], entries["id"], entries["map"] = hashes[at] & np.uint64(0xFFFFFFFF), np.diff(ends)[owner], owner, maps
        entries["place"] = np.arange(len(at)) - np.searchsorted(owner, owner)
        found = set(zip(*(x.tolist() for x in topics.slot_pairs(entries, percent))))
        sets = [set(hashes[a:b].tolist()) for a, b in zip(ends, ends[1:])]
        alike = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert alike and alike <= found and len(found) < 1.5 * len(alike)
        whole = topics.first_words(hashes, ends, times, percent)[2]
        assert (whole == maps[entries["place"] == 0]).all()


def test_pairs_looked_at_stay_few(monkeypatch):
    """Sets that share common words only, far behind in one of them: no pair of them is looked at."""
    texts = [" ".join([f"a{k}", f"b{k}", f"c{k}", "the", "of"]) for k in range(3000)]
    hashes, ends, times = coded(texts)
    times[(hashes % np.uint64(topics.COUNTERS)).astype(np.int64)] = 1
    at, owner, maps = topics.first_words(hashes, ends, times, 60, onward=True)
    entries = np.zeros(len(at), topics._ENTRY)
    entries["word"], entries["n"], entries["id"], entries["map"] = 1, 5, owner, maps
    entries["place"] = np.arange(len(at)) - np.searchsorted(owner, owner)
    seen = []
    monkeypatch.setattr(topics, "PAIRS", 1000)
    monkeypatch.setattr(topics.np, "bitwise_count", lambda x, f=np.bitwise_count: (seen.append(len(x)), f(x))[1])
    last = entries[entries["place"] == 2]
    assert len(last) == 3000 and len(topics.slot_pairs(last, 60)[0]) == 0 and sum(seen) == 0


def test_findings_count_spellings_and_models(spark):
    """Spellings of one set, alike sets, concerns without words, rows without a run, a model or a concern."""
    rows = [
        (1, "Lock the cache", "a"), (1, "lock the cache!", "b"), (1, "lock the cache", None), (1, "lock that cache the", "b"), (1, "!!", "a"), (1, "?", "a"),
        (1, "!!", "b"), (None, "lock the cache", "c"), (1, None, "c"), (2, "lock the cache", None), (2, "\u2160 \u0130x", "a"), (2, "i\u0307X \u2170", "c"),
    ]
    found = {(r.run_id, r.topic): (r.n_concerns, r.n_models, r.verdict) for r in topics.topic_findings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {
        (1, "Lock the cache"): (4, 2, "convergent"), (1, "!!"): (1, 2, "convergent"), (1, "?"): (1, 1, "unique"), (2, "lock the cache"): (1, 0, "unique"),
        (2, "i\u0307X \u2170"): (2, 2, "convergent"),
    }


def test_texts_are_cut_into_words_three_times(spark, monkeypatch):
    """For the keys, the counters and the first words; only sets of candidate pairs are cut once more."""
    calls = []
    monkeypatch.setattr(topics, "spaced", lambda text, f=topics.spaced: (calls.append("spaced"), f(text))[1])
    monkeypatch.setattr(topics, "words", lambda text, f=topics.words: (calls.append("words"), f(text))[1])
    assert topics.topic_findings(spark.createDataFrame(raised(), SCHEMA)).count() and sorted(calls) == ["spaced"] * 3 + ["words"]
