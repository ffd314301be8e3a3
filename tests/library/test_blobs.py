import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.operators import blobs


def samples():
    r = random.Random(1)
    return [b"", b"a", bytes(300), bytes(range(256)) * 3, b"banana" * 40, b'{"a": "x\\"y", "b": [1, 2]}\n' * 20, b"<a>\n <b>t</b>\n</a>" * 9, bytes(r.randrange(256) for _ in range(700)), struct.pack("<200f", *[i * 1.5 for i in range(200)]), struct.pack("<100Q", *[7 + 3 * i for i in range(100)]), "é漢字 text ".encode() * 30]


@pytest.mark.parametrize("name", sorted(blobs.TRANSFORMS))
def test_round_trips(name):
    f, g = blobs.TRANSFORMS[name]
    for data in samples():
        if data:
            assert g(f(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.sampled_from(sorted(blobs.TRANSFORMS)))
def test_any_bytes(data, name):
    f, g = blobs.TRANSFORMS[name]
    assert g(f(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_bwt_is_sorted_suffixes(data):
    order = sorted(range(len(data)), key=lambda i: data[i:])
    assert blobs.suffix_array(data).tolist() == order
    assert blobs.unbwt(*blobs.bwt(data)) == data


def test_transposition_needs_a_multiple():
    assert blobs.transpose(b"abcdef", 2) == b"acebdf"
    with pytest.raises(ValueError):
        blobs.transpose(b"abc", 2)


def test_savings():
    assert len(blobs.rle(bytes(1000))) < 5 and len(blobs.const_elim(bytes(990) + b"x" * 10)) < 150
    assert len(blobs.stride_elim(struct.pack("<100Q", *range(100)))) < 30
    assert blobs.normalize(b'{ "a" : " x " }')[0] == b'{"a":" x "}'


def test_gains_are_gated():
    assert blobs.gains(b"") == {}
    g = blobs.gains(bytes(5000))
    assert "const_elim" in g and "rle" in g and "predict" not in g
    assert "bwt_chain" in blobs.gains(b"some words of plain text " * 40)


def test_apply_on_columns(spark):
    df = spark.createDataFrame([(1, bytearray(b"aaab")), (2, None), (3, bytearray(b""))], "id long, data binary")
    back = blobs.apply(blobs.apply(df, "data", "rle"), "encoded", "rle", True, "back")
    assert {r.id: None if r.back is None else bytes(r.back) for r in back.collect()} == {1: b"aaab", 2: None, 3: b""}
