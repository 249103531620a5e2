"""Repeated passages: planted ones are found, chance is left alone, chains equal a quadratic reference."""

from __future__ import annotations

import cProfile
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import leaks, passages
from wardline.llm.common import word_hashes


def brute_best_chain(links):
    """Score of the best chain, over all predecessors."""
    links = sorted(links, key=lambda m: (m[0], -m[1]))
    score = []
    for j, (p, a) in enumerate(links):
        ways = [score[i] - passages.GAP_COST * (p - q + a - b) for i, (q, b) in enumerate(links[:j]) if q < p and b < a]
        score.append(passages.SEED_WORDS + max([0, *ways]))
    return max(score)


def chain_score(links):
    steps = zip(links, links[1:])
    return len(links) * passages.SEED_WORDS - sum(passages.GAP_COST * (p - q + a - b) for (q, b), (p, a) in steps)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=40))
def test_chains(links):
    links = sorted(links)
    # one link per place of the document, as the seeds give them
    links = list({p: (p, a) for p, a in links}.values())
    pos, apos = np.array([p for p, _ in links]), np.array([a for _, a in links])
    chains = passages.chained(pos, apos)
    assert sorted(i for c in chains for i in c) == list(range(len(links)))
    for c in chains:
        assert (np.diff(pos[c]) > 0).all() and (np.diff(apos[c]) > 0).all()
    first = [links[i] for i in chains[0]]
    assert chain_score(first) == pytest.approx(brute_best_chain(links))


def test_any_24_equal_words_share_a_seed():
    rng = random.Random(4)
    for _ in range(200):
        common = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(24)]
        found = []
        for side in "xy":
            before, after = ([f"{side}{rng.random()}" for _ in range(rng.randrange(60))] for _ in range(2))
            import pyarrow as pa
            words = word_hashes(pa.array(before + common + after + ["other"] * 30))
            n = len(before) + 24 + len(after)
            places, hashes = passages.kept_seeds(words, np.array([0, n, n + 30]))
            found.append({int(h) for p, h in zip(places, hashes) if p < n})
        assert found[0] & found[1]


def planted(rng, words):
    """Documents with 60-word passages in common, up to one word in fifty changed, and documents without."""
    docs, where = {}, {}
    for d in range(80):
        docs[d] = [rng.choice(words) for _ in range(rng.choice([0, 30, 200, 400]))]
        where[d] = []
    for n in range(12):
        text = [rng.choice(words) for _ in range(60)]
        for d in rng.sample(range(60), rng.choice([2, 3, 10])):
            own = list(text)
            if rng.random() < .5:
                own[rng.randrange(60)] = "changed"
            if rng.random() < .3:
                del own[30]
            at = rng.choice([0, len(docs[d])])
            docs[d][at:at] = own
            where[d] = [(p + len(own) if p >= at else p, m) for p, m in where[d]] + [(at, n)]
    return docs, where


def test_planted_passages_are_found(spark):
    rng = random.Random(9)
    docs, where = planted(rng, [f"v{i}" for i in range(3000)])
    rows = [(d, " ".join(w), 1) for d, w in docs.items()]
    rows += [(100, None, 1), (101, "", 1), (102, "again and " * 3000, 1), (103, rows[70][1] or "x " * 90, 1),
             (103, rows[70][1] or "x " * 90, 1), (None, " ".join(docs[0][:0] + [f"z{i}" for i in range(90)]), 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = {}
    for r in passages.repeated_passages(frame).collect():
        got.setdefault(r["id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    holders = {}
    for d, own in where.items():
        for _, n in own:
            holders.setdefault(n, set()).add(d)
    for d, own in where.items():
        for at, n in own:
            if len(holders[n]) > 1:
                spans = got[d][0]["first"] if d == min(holders[n]) else got[d][0]["later"]
                assert any(s["start"] <= at + 8 and s["end"] >= at + 50 for s in spans), (d, at, n, spans)
                if d != min(holders[n]):
                    assert min(holders[n]) in got[d][0]["sources"]
    clean = [d for d, own in where.items() if not own and d not in (70,)]
    assert clean and not any(got[d][0]["later"] or got[d][0]["first"] for d in clean)
    assert not got[100][0]["later"] and not got[101][0]["first"] and not got[102][0]["later"]
    assert passages.repeated_passages(frame.limit(0)).collect() == []


def test_merged():
    assert passages.merged([(0, 30), (32, 60), (70, 90)], 50) == [(0, 60)]


def found_ids(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    rows = passages.repeated_passages(frame).collect()
    return {r["id"] for r in rows if r["later"]}, {r["id"] for r in rows if r["first"]}


def test_passage_whose_halves_stood_apart_before(spark):
    rng = random.Random(31)
    other = [[f"o{k}_{i}" for i in range(60)] for k in range(4)]
    passage = rng.choices([f"p{i}" for i in range(900)], k=50)
    texts = [" ".join(other[0] + passage[:25]), " ".join(passage[25:] + other[1]),
             " ".join(other[2] + passage), " ".join(passage + other[3])]
    later, _ = found_ids(spark, texts)
    assert {3, 4} <= later and 1 not in later and 2 not in later


def test_decoys_that_hold_the_seeds_alone(spark):
    """Document 1 holds every 5-gram of a passage that documents 2 and 3 share, but scattered."""
    rng = random.Random(32)
    passage = rng.choices([f"p{i}" for i in range(900)], k=60)
    decoy, fresh = [], iter(range(10_000))
    for i in rng.sample(range(56), 56):
        decoy += passage[i:i + 5] + [f"d{next(fresh)}" for _ in range(110)]
    texts = [" ".join(decoy), " ".join([f"a{i}" for i in range(40)] + passage),
             " ".join(passage + [f"b{i}" for i in range(40)])]
    later, first = found_ids(spark, texts)
    assert later == {3} and first == {2}


@pytest.mark.parametrize("size, rate", [(60, 0), (60, .05), (60, .1), (60, .15), (100, .1), (100, .15)])
def test_recall_of_fuzzy_passages(spark, size, rate):
    """Of pairs that have a span of 50 words at 80 % on their diagonal at least nine in ten are found."""
    rng = random.Random(size)
    vocabulary, texts, wanted = [f"w{i}" for i in range(3000)], [], set()
    for n in range(60):
        base = rng.choices(vocabulary, k=size)
        other = [rng.choice(vocabulary) if rng.random() < rate else w for w in base]
        span = leaks.best_span(np.array([a == b for a, b in zip(base, other)]), passages.MIN_SIMILARITY)
        if span and span[1] - span[0] >= 50:
            wanted.add(2 * n + 2)
        for own in (base, other):
            text = rng.choices(vocabulary, k=80)
            text[40:40] = own
            texts.append(" ".join(text))
    later, _ = found_ids(spark, texts)
    assert len(later & wanted) >= .9 * len(wanted) and len(later - wanted) <= 3


def test_small_corpora_against_all_pairs(spark):
    """Documents of few passages: what is reported as repeated is what all pairs of documents have in common."""
    rng = random.Random(34)
    for corpus in range(3):
        pool = [rng.choices([f"c{corpus}_{i}" for i in range(2000)], k=rng.choice([30, 55, 80])) for _ in range(8)]
        docs = []
        for d in range(24):
            words = [f"u{corpus}_{d}_{i}" for i in range(20)]
            for part in rng.sample(pool, rng.choice([0, 1, 2])):
                words += part + [f"v{corpus}_{d}_{len(words)}_{i}" for i in range(15)]
            docs.append(words)
        wanted = set()
        for i, one in enumerate(docs):
            for other in docs[:i]:
                grams = {tuple(other[k:k + 50]) for k in range(len(other) - 49)}
                if any(tuple(one[k:k + 50]) in grams for k in range(len(one) - 49)):
                    wanted.add(i + 1)
        later, _ = found_ids(spark, [" ".join(d) for d in docs])
        assert later == wanted


def test_single_links_are_judged_all_at_once():
    """The same verdicts as word by word, at the ends of texts, in short texts and in slices of a batch."""
    rng = random.Random(12)
    texts = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 140))),
              bytes(rng.choice(b"abc") for _ in range(rng.randrange(5, 140)))) for _ in range(400)]
    texts += [(b"x" * n, b"x" * n) for n in (5, 9, 10, 23, 24, 25, 125)]
    at = np.array([rng.randrange(0, len(own) - 4) for own, _ in texts])
    there = np.array([rng.randrange(0, len(other) - 4) for _, other in texts])
    wanted = []
    for i, j, (own, other) in zip(at, there, texts):
        back, on = min(i, j), min(len(own) - i, len(other) - j)
        one, two = (np.frombuffer(x, np.uint8)[k - back:k + on] for x, k in ((own, i), (other, j)))
        wanted.append(bool(passages.too_different(one == two)))
    own, other = (pa.array([b"before"] + [t[k] for t in texts]).slice(1) for k in (0, 1))
    assert passages.alone(at, there, own, other).tolist() == wanted and 0 < sum(wanted) < len(wanted)
    none = np.zeros(0, np.int64)
    assert passages.alone(none, none, own.slice(0, 0), other.slice(0, 0)).tolist() == []


def test_refuted_seeds_are_written_once(spark, monkeypatch):
    """Both readers of the refuted seeds read a written table; they used to gather the fragments twice."""
    inputs, links = [], passages.links
    monkeypatch.setattr(passages, "links", lambda seeds, scratch: inputs.append(seeds) or links(seeds, scratch))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[::-1])), (3, "x " + " ".join(words))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["sources"] for r in found.collect()} == {1: [], 2: [], 3: [1]}
    plan = inputs[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def aligned_word_by_word(pos, apos, words, awords, base, abase):
    """Fragments of one chain, one diagonal and one span after the other."""
    def same(i, j):
        return base <= i < base + len(words) and abase <= j < abase + len(awords) and words[i - base] == awords[j - abase]

    partner = {i: i + apos[0] - pos[0] for i in range(base, pos[0])}
    partner |= {i: i + apos[-1] - pos[-1] for i in range(pos[-1], base + len(words))}
    for p, q, a, b in zip(pos, pos[1:], apos, apos[1:]):
        ways = [sum(same(i, i + a - p) for i in range(p, turn)) + sum(same(i, i + b - q) for i in range(turn, q))
                for turn in range(p, q + 1)]
        turn = p + ways.index(max(ways))
        partner |= {i: i + (a - p if i < turn else b - q) for i in range(p, q)}
    equal, found, parts = np.array([same(i, partner[i]) for i in sorted(partner)]), [], [(0, len(words))]
    while parts:
        a, b = parts.pop()
        span = leaks.best_span(equal[a:b], passages.MIN_SIMILARITY)
        if span and span[1] - span[0] >= passages.MIN_FRAGMENT:
            i, j = base + a + span[0], base + a + span[1]
            found.append((i, j, partner[i], partner[j - 1] + 1))
            parts += [(a, i - base), (j - base, b)]
    return found


def random_chains(rng, count):
    """(pos, apos, words, awords, base, abase) of texts with shifted and slightly changed copies."""
    chains = []
    while len(chains) < count:
        letters = bytes(rng.sample(range(256), rng.choice([2, 4, 100])))
        own, other = (bytearray(rng.choices(letters, k=rng.choice([5, 12, 40, 200]))) for _ in range(2))
        links = {rng.randrange(len(own) - 4): rng.randrange(len(other) - 4)}
        for _ in range(rng.randrange(5)):
            size = rng.randrange(5, min(len(own), len(other)) + 1)
            i, j = rng.randrange(len(own) - size + 1), rng.randrange(len(other) - size + 1)
            other[j:j + size] = bytes(w if rng.random() < .9 else letters[0] for w in own[i:i + size])
            links |= {i + k: j + k for k in range(0, size - 4, 6)}
        pos, apos = np.array(sorted(links)), np.array([links[p] for p in sorted(links)])
        for chain in passages.chained(pos, apos):
            p, a = pos[chain].tolist(), apos[chain].tolist()
            base, abase = max(0, p[0] - passages.REACH), max(0, a[0] - passages.REACH)
            beyond = passages.SEED_WORDS + passages.REACH
            chains.append((p, a, bytes(own[base:p[-1] + beyond]), bytes(other[abase:a[-1] + beyond]), base, abase))
    return chains


def batch_of(chains):
    kinds = [pa.list_(pa.int32())] * 2 + [pa.binary()] * 2 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*chains), kinds)],
                                      names=["pos", "apos", "words", "awords", "base", "abase"])


def test_chains_of_a_batch_are_aligned_as_one_by_one():
    chains = random_chains(random.Random(41), 600)
    wanted = {(n, *span) for n, chain in enumerate(chains[7:]) for span in aligned_word_by_word(*chain)}
    spans = [x.tolist() for x in passages.aligned(batch_of(chains).slice(7))]
    assert set(zip(*spans)) == wanted and len(spans[0]) == len(wanted) > 100
    assert [len(x) for x in passages.aligned(batch_of(chains).slice(len(chains)))] == [0] * 5


def test_aligning_more_chains_takes_no_more_calls():
    """Chains used to be aligned one after the other in Python, which took most of the operator's time."""
    chains = random_chains(random.Random(42), 50)
    calls = []
    for batch in (batch_of(chains), batch_of(chains * 20)):
        profile = cProfile.Profile()
        profile.runcall(passages.aligned, batch)
        calls.append(sum(entry.callcount for entry in profile.getstats()))
    assert calls[0] == calls[1]


def test_refuted_seeds_are_not_held_against_every_fragment(spark):
    """As by comparing all links with all fragments of a document; the plan sorts them together instead."""
    rng = random.Random(43)
    links = [(rng.randrange(20), 99, rng.randrange(300), 0, rng.choice([None, n]), rng.choice([None, 7])) for n in range(900)]
    spans = [(rng.randrange(15), 99, start, start + rng.choice([1, 12, 90])) for start in rng.choices(range(300), k=60)]
    linked = spark.createDataFrame(links, "row long, anchor long, pos int, apos int, pair long, id long")
    found = spark.createDataFrame(spans, "row long, anchor long, start int, end int")
    got = passages.refuted(linked, found)
    assert "Join" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "lambda" not in plan
    wanted = [(pair, pair, pos, row, n) for row, _, pos, _, pair, n in links if pair is not None
              and not any(r == row and a <= pos < b for r, _, a, b in spans)]
    assert sorted(map(tuple, got.select("h", "pair", "pos", "row", "id").collect()), key=str) == sorted(wanted, key=str)
    assert 0 < len(wanted) < sum(pair is not None for *_, pair, _ in links)
