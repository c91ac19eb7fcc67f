import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.llm import bpe, flat, separators
from segmill.llm.shared import new_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
ALPHABET = "ab 'st\n\t 1é<|endoftext|>ß日　\x1c\x85  'llΣΑİ́́e!?XY"


def texts(n=3000):
    r = random.Random(3)
    odd = ["".join(r.choices(ALPHABET, k=r.randint(0, 60))) for _ in range(n)]
    return odd + ["a" + c + "b1" + c + c + " " + c + "!" + c + "\n" for c in map(chr, range(0x3000))] + ["<|endoftext|>x<|endoftext|>", "", "a" * 5001, " " * 900, "aaaaaaaa" * 40]


def test_bpe_is_the_librarys():
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    v = bpe.Vocabulary(bpe.default_vocabulary())
    some = texts()
    ids, sizes = v.encode(some)
    back, at = v.decode(ids, sizes), 0
    for x, n, d, e in zip(some, sizes, back, t.encode_batch(some, add_special_tokens=False)):
        assert ids[at : at + n].tolist() == e.ids, x
        assert d == t.decode(e.ids, skip_special_tokens=False)
        at += n


def test_bpe_forgets_and_still_encodes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    v = bpe.Vocabulary(bpe.default_vocabulary())
    for x in texts(40):
        ids, sizes = v.encode([x])
        assert v.decode(ids, sizes) == [x]


def test_bpe_query(spark):
    df = spark.createDataFrame([(1, "Hallo Welt", "x"), (2, None, "y"), (2, "", "y"), (None, "é" * 9, "z")], "doc_id long, text string, ids string")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df).collect())
    want = []
    for i, x in ((1, "Hallo Welt"), (2, ""), (2, ""), (0, "é" * 9)):
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(x.encode())))
    assert got == sorted(want)
    coded = bpe.encode(df).collect()
    assert [r.ids for r in coded if r.doc_id == 1] == [t.encode("Hallo Welt").ids]
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_flat_encoder_is_the_librarys():
    t = tokenizers.Tokenizer.from_file(flat.default_vocabulary())
    enc = flat.Encoder(flat.default_vocabulary())
    some = texts() + ["Größe, Éa!! ÄÖ<|startoftext|> don't x'll {a}"]
    ids, sizes = enc.encode(some)
    at = 0
    for x, n, e in zip(some, sizes, t.encode_batch(some, add_special_tokens=False)):
        assert ids[at : at + n].tolist() == e.ids, x
        at += n


def expected_files(rows):
    t = tokenizers.Tokenizer.from_file(flat.default_vocabulary())
    base, out = 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((i, base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        base += len(ids)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_flat_files(spark, parts):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["der", "Hund", "läuft", "weit"], k=r.randint(0, 30)))) for i in r.sample(range(1000), 200)] + [(2000, None), (2001, ""), (2002, "x"), (2002, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "t")
    shards = flat.write_shards(df.repartition(3), folder, partitions=parts)
    got = [tuple(x) for x in flat.read_documents(spark, shards).orderBy("start").collect()]
    assert got == expected_files(rows)
    assert [s["base"] for s in shards] == [sum(s["tokens"] for s in shards[:i]) for i in range(len(shards))]
    one = flat.Shard(shards[0]["path"], shards[0]["width"])
    assert isinstance(one.offsets, np.memmap) and one.offsets.dtype == np.dtype("<u8")
    assert os.path.getsize(shards[0]["path"].removeprefix("file://") + ".bin") == 2 * shards[0]["tokens"]


def test_flat_odd_rows(spark):
    df = spark.createDataFrame([(None, "b"), (-5, "a"), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in flat.token_files(df).orderBy("start").collect()] == [None, None, -5]
    assert flat.token_files(df.limit(0)).count() == 0


def test_scan_block():
    seps, head, tail, inner = separators.scan_block(np.array([1, 0, 2, 3, 0, 0, 4]), end=0)
    assert (seps, head, tail, inner.tolist()) == (3, 2, 1, [3, 1])
    assert separators.scan_block(np.array([1, 2]), end=0)[:3] == (0, 0, 2)


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_counts_across_blocks(spark, block):
    r = random.Random(block)
    folder = new_path(spark, "flat")
    path = folder.removeprefix("file://")
    os.makedirs(path)
    want = []
    for f in range(3):
        sizes = [r.choice([1, 1, 2, 5, 30]) for _ in range(40)] if f else []
        ids = [x for s in sizes for x in [*[7] * (s - 1), separators.END]]
        if f == 2:
            ids += [7, 7]
            sizes.append(2)  # open at the end
        np.array(ids, "<u2").tofile(f"{path}/part-{f}.bin")
        want += [(f"part-{f}.bin", i, s) for i, s in enumerate(sizes)]
    assert sorted(tuple(x) for x in separators.count_tokens(spark, folder, block=block).collect()) == want


def test_counted(spark):
    df = spark.createDataFrame([(1, "Hallo Welt"), (2, None), (3, ""), (3, ""), (None, "x y z")], "doc_id long, text string")
    enc = separators.encoding(separators.default_vocabulary())
    n = lambda t: len(enc.encode_ordinary(t)) + 1
    got = sorted((r.doc_id or 0, r.n_tokens) for r in separators.counted(df).collect())
    assert got == [(0, n("x y z")), (1, n("Hallo Welt")), (2, 1), (3, 1), (3, 1)]
    assert separators.counted(df.filter(F.lit(False))).count() == 0


def test_long_words_are_the_librarys(monkeypatch):
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    v = bpe.Vocabulary(bpe.default_vocabulary())
    assert v.ordered
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for x in ("".join(r.choices(letters, k=200_000)), "a" * 50_001, "ab" * 900 + " " + "é" * 700, "=-" * 5000, " " * 3000):
        ids, sizes = v.encode([x, "kurz", x])
        want = t.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want + t.encode("kurz", add_special_tokens=False).ids + want and v.decode(ids, sizes)[2] == x
    monkeypatch.setattr(bpe, "LONG", 2)  # all words in linked rounds
    some = texts(300)
    v.forget()
    assert v.encode(some)[0].tolist() == [i for e in t.encode_batch(some, add_special_tokens=False) for i in e.ids]


def test_flat_with_another_vocabulary():
    path = bpe.default_vocabulary()
    enc, t = flat.Encoder(path), tokenizers.Tokenizer.from_file(path)
    some = ["Hallo  Welt, it's 10!", "", "a\n b"]
    ids, sizes = enc.encode(some)
    assert not enc.cuts and flat.Encoder(flat.default_vocabulary()).cuts
    assert ids.tolist() == [i for x in some for i in t.encode(x, add_special_tokens=False).ids] and len(sizes) == 3


def test_long_texts_and_clashing_columns(spark):
    long = "Der Hund läuft 10 km. " * 40_000
    df = spark.createDataFrame([(1, long, "s", 5), (2, "x", "t", 6)], "doc_id long, text string, shard string, n_tokens int")
    assert [tuple(r) for r in flat.token_files(df).orderBy("start").collect()] == expected_files([(1, long), (2, "x")])
    enc = separators.encoding(separators.default_vocabulary())
    assert {r.doc_id: r.n_tokens for r in separators.counted(df.withColumnRenamed("shard", "position")).collect()} == {1: len(enc.encode_ordinary(long)) + 1, 2: len(enc.encode_ordinary("x")) + 1}
    plan = separators.counted(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
