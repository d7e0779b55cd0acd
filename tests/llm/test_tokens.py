from __future__ import annotations

import io
import random
import struct
import zlib

import numpy as np
import pytest
from leafmill.llm import tokens
from leafmill.llm.queries_tokens import lookup_tokens, op2_token_output, tokenizer_path, write_tokens
from leafmill.llm.sstable import Reader, Writer, identifier_of, key_of, open_shard
from leafmill.llm.tokens import ChunkedEncoder, encoder


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_keys_sort_as_identifiers():
    ids = [None, -(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    assert sorted(key_of(i) for i in ids) == [key_of(i) for i in ids]
    assert [identifier_of(key_of(i)) for i in ids] == ids


@pytest.mark.parametrize("width", [2, 4])
def test_shard_round_trip_and_lookup(width):
    rng = np.random.default_rng(3)
    rows = sorted([(int(i), rng.integers(0, 60_000, rng.integers(0, 4_000)).astype(np.uint32)) for i in rng.integers(-1000, 100_000, 300)] + [(None, np.array([7], np.uint32))], key=lambda r: (r[0] is not None, r[0] or 0))
    sink = Source()
    w = Writer(sink, width)
    for r in rows:
        w.add(*r)
    w.close()
    shard = Reader(sink)
    assert len(shard.blocks) > 3
    assert [(k, v.tolist()) for k, v in shard] == [(k, v.tolist()) for k, v in rows]
    for k in {k for k, _ in rows}:
        assert sorted(v.tolist() for v in shard.get(k)) == sorted(v.tolist() for i, v in rows if i == k)
    absent = [k for k in range(200_000, 201_000)]
    assert all(shard.get(k) == [] for k in absent)
    assert sum(shard.may_hold(k) for k in absent) < 60
    with pytest.raises(ValueError):
        Reader(Source(sink.getvalue()[:-9]))
    with pytest.raises(ValueError):
        w.add(-(1 << 62), np.zeros(0, np.uint32))


def test_damage_is_an_error_and_never_another_answer():
    rng = random.Random(4)
    sink = Source()
    w = Writer(sink, 2)
    rows = [(k, np.arange(k % 50, dtype=np.uint32)) for k in range(2000)]
    for r in rows:
        w.add(*r)
    w.close()
    good = sink.getvalue()
    for _ in range(300):
        at = rng.randrange(len(good))
        bad = good[:at] + bytes([good[at] ^ 1 << rng.randrange(8)]) + good[at + 1 :]
        try:
            shard = Reader(Source(bad))
            told = [(k, v.tolist()) for k, v in shard]
            assert all(shard.may_hold(k) for k, _ in rows[:3])
        except ValueError:
            continue
        raise AssertionError(f"byte {at} of {len(good)} went unnoticed: {told == [(k, v.tolist()) for k, v in rows]}")


def test_a_hot_id_is_split(spark):
    docs = spark.createDataFrame([(None if k % 3 else k, f"text {k}" if k % 2 else "same") for k in range(900)], "doc_id long, text string")
    got = op2_token_output(spark, "", docs.repartition(6)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((r.doc_id is not None, r.doc_id or 0, len(encoder(tokenizer_path()).ids(r.text)) + 1) for r in docs.collect())
    from leafmill.llm.common import shared_dir

    shards = write_tokens(docs.repartition(6), tokenizer_path(), 2, shared_dir(spark, "hot"), shards=6).collect()
    assert max(s.entries for s in shards) < 450


def test_encoder_equals_the_library():
    e = encoder(tokenizer_path())
    rng = random.Random(5)
    odd = ["it's ok", "I’ll don't  x", "éa ́b", "Ｆｕｌｌ ① ½ x\x85y z", "a\x1cb", "<|endoftext|> a", "ΑΣ ΟΔΟΣ. Σ", "ß İstanbul ǅ", "日本語 text 12345 !!?", "​x", "tab\tnew\n\r\x0b\x0c z", "word.'s don't.- 'tis rock'n'roll a-b- x---y ###12 #a", "(foo) [bar], \"baz\" — – … “q” ‘r’ €5 §7 a&b <b> x<y"]
    texts = ["", " ", *odd, *("".join(rng.choice(odd) for _ in range(5)) for _ in range(60)), *("".join(chr(rng.choice([rng.randint(32, 0x17F), 32, rng.randint(97, 122)])) for _ in range(80)) for _ in range(500))]
    for t in texts:
        assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert e.ids(None).tolist() == []


class Counted:
    """A tokenizer that keeps what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode(self, text, **options):
        self.given.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.given.extend(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def _counted():
    e = ChunkedEncoder(tokenizer_path())
    e.tokenizer = Counted(e.tokenizer)
    return e


def _word(n: int) -> str:
    return "w" + "".join(chr(97 + int(c)) for c in str(n))


def test_a_word_is_learnt_once_whatever_stands_around_it():
    e = _counted()
    for around in ("{}", "({})", "{}, ", "{}?!", "#{}", "x.{}/y", "{}12", '"{}"', "[{}];", "{}'s"):
        text = " ".join(around.format(_word(n)) for n in range(1000))
        assert e.ids(text).tolist() == e.tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, around
    assert sum(map(len, e.tokenizer.given)) < 1.1 * sum(len(_word(n)) + 1 for n in range(1000))


def test_words_in_use_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 500)
    e, common = _counted(), [_word(n) for n in range(100)]
    for k in range(50):
        text = " ".join([*common, *(_word(1000 + 200 * k + n) for n in range(200))])
        assert e.ids(text).tolist() == e.tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    given = " ".join(e.tokenizer.given).split()
    assert [given.count(w) for w in common] == [1] * 100
    assert len(e.known) + len(e.older) < 4 * 500


def test_texts_together_and_long_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 200)
    e, rng = ChunkedEncoder(tokenizer_path()), random.Random(6)
    odd = "'''sStTrRevVmMlLdD.,!-\"12 \n\téÉ×÷ėķŸœß¿ª²¼µ·“”’—…‰⁄€#"
    texts = ["".join(rng.choice(odd) for _ in range(rng.choice((0, 3, 30, 300, 1500)))) for _ in range(2000)]
    texts += [None, "", " \n", "x" * 900, " " * 900, "á " * 200, "1" * 450 + " end", *("".join(rng.choice("ab ,") for _ in range(n)) for n in range(195, 205))]
    rng.shuffle(texts)
    got = list(e.many(iter(texts)))
    assert [g.tolist() for g in got] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(e.many([])) == []


def _expected(rows):
    e, start, out = encoder(tokenizer_path()).tokenizer, 0, []
    for i, t in rows:
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_by_brute_force(spark):
    from tests_llm_data import table

    docs = table(spark, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, op2_token_output(spark, "", docs).collect())) == _expected(rows)


def test_awkward_rows_and_no_rows(spark, awkward, empty):
    got = [tuple(r) for r in op2_token_output(spark, "", awkward).collect()]
    assert len(got) == awkward.count()
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, *_expected([(r[0], r[1])])[0][2:]) for r in awkward.select("doc_id", "text").collect())
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == [sum(x[2] for x in by_start[:k]) for k in range(len(by_start))]
    assert [(r[0] is not None, r[0] or 0) for r in by_start] == sorted((r[0] is not None, r[0] or 0) for r in by_start)
    assert op2_token_output(spark, "", empty).collect() == []


def test_lookup_in_written_shards(spark, awkward, tmp_path):
    shards = write_tokens(awkward, tokenizer_path(), 2, f"file://{tmp_path}/t")
    found = [ids.tolist() for s in shards.collect() for ids in open_shard(s.path).get(10)]
    assert found == [[*encoder(tokenizer_path()).ids("one two three").tolist(), 2]]
    wanted = spark.createDataFrame([(10,), (77,), (None,), (3,), (1,)], "doc_id long")
    got = sorted(((r.doc_id, len(r.ids)) for r in lookup_tokens(shards, wanted).collect()), key=str)
    there = [(r.doc_id, len(encoder(tokenizer_path()).ids(r.text)) + 1) for r in awkward.collect() if r.doc_id in (10, None, 3, 1)]
    assert got == sorted(there, key=str)
