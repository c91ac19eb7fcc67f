import hashlib
import random

import brute
import numpy as np
import pytest

from segmill.llm import substrings, suffix


def test_suffix_array():
    r = random.Random(5)
    for _ in range(800):
        k, n = r.choice([1, 2, 3, 5, 200]), r.randint(0, 60)
        t = bytes(r.choices(range(k), k=n)) if r.random() < 0.7 else bytes(r.choices(range(k), k=5)) * r.randint(1, 9)
        a = np.frombuffer(t, np.uint8)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        got = suffix.suffix_array(a)
        assert got.tolist() == want
        if len(t) < 2:
            continue
        before, common = suffix.permuted_common_prefixes(a, got, 1000)
        for x, y in zip(want, want[1:]):
            m = next((m for m in range(len(t)) if max(x, y) + m >= len(t) or t[x + m] != t[y + m]), 0)
            assert (before[y], common[y]) == (x, m)


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_against_brute_force(spark, hot):
    r = random.Random(3)
    line = lambda n: "".join(r.choices("abcdeäß \n", k=n))
    passage, other = line(90), line(70)
    texts = [None, "", "x" * 200, passage, line(300)]
    texts += [line(r.randint(0, 80)) + passage + line(r.randint(0, 80)) for _ in range(30)]
    texts += [passage[r.randint(0, 20) :] + other + passage[: r.randint(30, 90)] for _ in range(20)]
    texts += [texts[-1], texts[-1], other * 3, "ab" * 100]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, th string")
    out = substrings.strip_repeats(df, length=40, gram=10, hot=hot, shard=3000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out.collect()}
    want = dict(enumerate(brute.stripped(texts, 40)))
    assert got == want
    assert all(r.text == want[r.doc_id][3].decode("utf-8", "ignore") for r in out.collect())
    assert all(r.kept_sha256 == hashlib.sha256(want[r.doc_id][3]).hexdigest() for r in out.collect())


def test_repeats_come_from_the_suffix_array(spark, monkeypatch):
    text = "".join(random.Random(1).choices("abcdefgh ", k=900))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    monkeypatch.setattr(substrings, "repeated_starts", lambda pieces, *_: [np.zeros(0, np.int64) for _ in pieces])
    assert [r.n_removed for r in substrings.strip_repeats(df).collect()] == [0, 0]


def test_parts_of_a_context():
    r = random.Random(8)
    data = bytes(r.choices(range(97, 123), k=70))
    for width in (31, 8, 3, 1):
        parts = list(substrings.parted(data, n=31, lead=30, key=5, width=width, length=40))
        starts = [a + i for a, n, *_ in parts for i in range(n)]
        assert sorted(starts) == list(range(31))
        assert all(lead == 30 - a for a, _, lead, *_ in parts)
        # The same string with the anchor at the same place has the same key in another context.
        other = b"?" * 5 + data[12:52] + b"!" * 9
        keys = {a: key for a, n, _, key, _ in substrings.parted(other, n=15, lead=23, key=5, width=width, length=40)}
        if width == 1:
            assert keys[5] == next(key for a, _, _, key, _ in parts if a == 12)


def test_long_text_in_parts(spark, monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    texts = ["".join(r.choices("abcdefgh ", k=5000)), "".join(r.choices("abcdefgh ", k=900))]
    texts += [texts[0][1000:3500] + texts[1], "ab" * 1500, texts[1][::-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in substrings.strip_repeats(df, length=60, gram=20).collect()}
    assert got == dict(enumerate(brute.stripped(texts, 60)))


def test_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=900))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:500]), (None, "kurz")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in substrings.strip_repeats(df).collect())
    assert got == [(0, 4, 0), (0, 500, 500), (1, 900, 900), (1, 900, 900)]
    assert substrings.strip_repeats(df.limit(0)).count() == 0
