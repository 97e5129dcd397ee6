"""Collocations and their automata against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import collocations
from tabloom.llm.collocations import Collocations, SuffixAutomaton

DOCS = "doc_id long, text string, lang string, phrase string, n string, k int"


def brute(rows, least, share=100, most=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and inside(p, q) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(out)


def rows(seed, docs=40):
    r = np.random.default_rng(seed)
    vocab = ["a", "B", "ä", "Ä", "über", "x-y", "c", "d", "l'eau", "\x00z"]
    fixed = "The quick  brown\tfox jumps over"
    out = [(None, "en"), ("", "en"), (" \t ", None), ("..!?", "de"), ("one", "xx"), ("w" * 70_000 + " " + "v" * 70_000, "en"), ("a b " * 3000, "de")]
    for i in range(docs):
        words = [vocab[k] for k in r.integers(0, len(vocab), r.integers(0, 60))]
        seps = [[" ", " ", "  ", "\t", ", ", ".", "\n", " ! "][k] for k in r.integers(0, 8, len(words))]
        out.append(("".join(a + b for a, b in zip(words, seps, strict=True)) + fixed * (i % 3), [None, "und", "en", "de"][i % 4]))
    return [*out, out[9], out[9]]


@pytest.mark.parametrize(("seed", "least", "share", "shard"), [(1, 2, 100, 1 << 20), (2, 5, 60, 50), (3, 1, 100, 500)])
def test_equals_brute_force(spark, monkeypatch, seed, least, share, shard):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    data = rows(seed)
    df = spark.createDataFrame([(i, *r, "clash", "clash", 1) for i, r in enumerate(data)], DOCS).repartition(3)
    op = Collocations(df, least=least, share=share)
    assert sorted(map(tuple, op.run().collect())) == brute(data, least, share)
    assert sorted(map(tuple, op.run(top=3).collect())) == brute(data, least, share, top=3)
    op.close()


def test_full_bit_sets_change_nothing(spark, monkeypatch):
    """With one word of bits nearly all hashes are false hits: more work, the same counts."""
    monkeypatch.setattr(collocations, "WORD_BITS", 64)
    monkeypatch.setattr(collocations, "STRING_BITS", 64)
    monkeypatch.setattr(collocations, "KNOWN_LANGUAGES", 1)
    data = rows(4)
    df = spark.createDataFrame([(i, *r, "", "", 1) for i, r in enumerate(data)], DOCS)
    assert sorted(map(tuple, Collocations(df, least=6).run().collect())) == brute(data, 6)


def test_nothing_frequent(spark):
    assert Collocations(spark.createDataFrame([], DOCS)).run().collect() == []
    assert Collocations(spark.createDataFrame([(1, "a b c", None, "", "", 1)], DOCS)).run().collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(2, 6))
def test_automaton(words, depth):
    """Classes are exactly the sets of strings with the same end places, cut at the depth; links lead to the next class."""
    a = SuffixAutomaton.build(np.array(words, np.int64), depth)
    ends = defaultdict(set)
    for i in range(len(words)):
        for k in range(1, depth + 1):
            s = tuple(words[max(0, i - k + 1) : i + 1])
            if len(s) == k and 0 not in s:
                ends[s].add(i)
    classes = defaultdict(list)
    for s, at in ends.items():
        classes[frozenset(at)].append(len(s))
    assert sorted((a.count[i], a.shortest[i], a.longest[i]) for i in range(len(a.count))) == sorted((len(at), min(k), max(k)) for at, k in classes.items())
    state = lambda i, k: tuple(words[a.end[i] - k + 1 : a.end[i] + 1])
    for i in range(len(a.count)):
        assert len(ends[state(i, a.longest[i])]) == a.count[i]
        if a.shortest[i] == 1:
            assert a.link[i] == -1
        else:
            up = a.link[i]
            assert a.longest[up] == a.shortest[i] - 1 and state(up, a.longest[up]) == state(i, a.longest[up]) and a.count[up] > a.count[i]
    got = Counter({state_: c for k, e, n in a.strings(1, depth) for state_, c in (((*words[x - k + 1 : x + 1],), c) for x, c in zip(e.tolist(), n.tolist(), strict=True))})
    assert got == Counter({s: len(at) for s, at in ends.items()})
