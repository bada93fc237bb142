"""Token files: exact round trips of the coding and of whole tables."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer, normalizers, pre_tokenizers

from casegrid.llm import token_files as K
from casegrid.llm.common import public_tokenizer, scratch_path

PATH = public_tokenizer("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=70))
def test_numbers_round_trip(x):
    control, data = K.encode_numbers(np.array(x, np.uint32))
    assert len(control) == -(-len(x) // 4)
    assert K.decode_numbers(control, data, len(x)).tolist() == x


ENCODER = K.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1'é ß  \t\n　.,!Ġ\U0001f600<|>s")) | st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=4))
def test_pieces_encode_as_the_whole(texts):
    got = [np.frombuffer(b, ENCODER.dtype).tolist() for b in ENCODER.encode(texts)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZé×÷ɏɐ19²'’.,!%<|>\n\n  ßñ中…\u0301\u00a0")), max_size=60), min_size=1, max_size=4))
def test_cut_pieces_encode_as_the_whole(texts):
    texts = [*texts, "a <|endoftext|>x y.<|endoftext|>. it's,don't!'s\nNew\n\nline 3rd $$$x"]
    got = [np.frombuffer(b, ENCODER.dtype).tolist() for b in ENCODER.encode(texts)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]
    assert ENCODER.lengths(texts).tolist() == [len(g) for g in got]


@pytest.mark.parametrize("change", ["lower", "spaces", "prefix"])
def test_other_kinds_of_tokenizer_encode_whole(tmp_path, change):
    other = Tokenizer.from_file(PATH)
    if change == "lower":
        other.normalizer = normalizers.Lowercase()
    elif change == "spaces":
        other.add_tokens([AddedToken("two words", normalized=False)])
    else:
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    other.save(str(tmp_path / "t.json"))
    texts = ["Some TWO words and two words.", "", "x  y"]
    e = K.Encoder(str(tmp_path / "t.json"))
    want = [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert not e.splits and e.lengths(texts).tolist() == [len(w) for w in want]
    assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == want


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(K, "CACHE", 3)
    e = K.Encoder(PATH)
    for t in ["one two three four", "five six", "one <|endoftext|> six"]:
        assert np.frombuffer(e.encode([t])[0], e.dtype).tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def check(spark, make_docs, rows, monkeypatch=None):
    path = scratch_path(spark, "test-tokens")
    K.write(make_docs(rows, extra=True), path, PATH)
    got = sorted(tuple(r) for r in K.read(spark, path).collect())
    want, start = [], 0
    for i, t in sorted(rows):
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_table_round_trip(spark, make_docs, monkeypatch):
    rows = [(i * 7 % 50, f"doc {i} " + "word " * i + "é") for i in range(50)] + [(60, None), (61, ""), (62, "long " * 50_000)]
    check(spark, make_docs, rows)


def test_ranks_are_by_frequency(spark, make_docs):
    path = scratch_path(spark, "test-ranks")
    K.write(make_docs([(1, "a a a b"), (2, "a a")]), path, PATH)
    ids = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ids[0] == TOKENIZER.encode(" a", add_special_tokens=False).ids[0] and len(ids) == len(set(ids))


def test_repeats_null_ids_and_empty_table(spark, make_docs):
    path = scratch_path(spark, "test-odd")
    K.write(make_docs([(2, "x"), (2, "x"), (None, "y"), (1, "z z")]), path, PATH)
    out = sorted(K.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [1, 2, 2, None] and [r.start for r in out] == [0, 3, 5, 7]
    empty = scratch_path(spark, "test-none")
    K.write(make_docs([]), empty, PATH)
    assert K.read(spark, empty).count() == 0
