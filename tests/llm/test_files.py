"""Token files and archives: exact round trips, and damage that is noticed."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import token_files as tf
from sparkloom.llm import warc

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = tf.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (tf.from_planes(planes, n) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=50), max_size=12), st.booleans(), st.integers(1, 40))
def test_file_round_trip(docs, bits, block):
    out = Source()
    w = tf.Writer(out, bits, block)
    for k, ids in enumerate(docs):
        w.add(k, np.array(ids, np.uint32))
    w.close()
    assert [(k, ids.tolist()) for k, ids in tf.Reader(out).documents()] == list(enumerate(docs))


def test_damage():
    out = Source()
    w = tf.Writer(out)
    w.add(1, np.arange(100, dtype=np.uint32))
    w.close()
    data = out.getvalue()
    for bad in (b"", data[:-1], data[:20] + data[21:], data[:-30] + b"\x00" + data[-29:]):
        with pytest.raises(Exception):  # noqa: B017
            list(tf.Reader(Source(bad)).documents())


ALPHABET = st.lists(st.sampled_from([*"abcXYZ 019'\n\t.,-_\u00b2\u00aa\u00e9\u00df\u00f1\u0416\u65e5\u0301\xa0\u2028\x1c\x85", "'ll", "<|endoftext|>", "  ", "'S"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(ALPHABET | st.text(max_size=30))
def test_encoder_is_the_librarys(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    e = tf.encoder(PATH)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_librarys_on_every_character_and_pair():
    """All the characters that the cut knows by class, each alone, doubled, within letters and before and behind any other."""
    known = [chr(c) for c in range(0x2B0) if not tf.OTHER.search(chr(c))]
    texts = [x for c in known for x in (c, c * 2, f"a{c}b", f" {c}", f"{c} ", f"1{c}2", f"'{c}", f"\n{c}")] + [f"{a}{b}" for a in known for b in known]
    e = tf.encoder(PATH)
    for k in range(0, len(texts), 50_000):
        some = texts[k : k + 50_000]
        want = e.tokenizer.encode_batch(some, add_special_tokens=False)
        assert all(np.frombuffer(e.encode(t), "<u4").tolist() == w.ids for t, w in zip(some, want, strict=True))


def test_remembered_pieces_stay_right():
    e = tf.Encoder(PATH, remembered=3)
    for _ in range(3):
        for text in ("the cat sat", "on the mat", "a b c d e f"):
            assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("options", [{}, {"bits": True, "task_docs": 7, "file_ids": 50}])
def test_documents(spark, options):
    r = random.Random(1)
    texts = [" ".join(r.choice(["the", "ünïcode", "x\n", "  y", "日本"]) for _ in range(r.choice((0, 1, 30, 300)))) for _ in range(60)]
    rows = [(100 - i, t, 5, "x") for i, t in enumerate(texts)] + [(3, None, 5, "x"), (None, "no id", 5, "x"), (50, texts[50], 5, "x"), (2, "long " * 40_000, 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long, name string").repartition(5)
    got = [(x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in tf.encode_and_read(df, PATH, **options).collect()]
    want, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array(tf.encoder(PATH).tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda x: (x[1], str(x))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_no_documents(spark):
    assert tf.encode_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


# --- WARC


def archive(records, dictionary=b""):
    out = io.BytesIO()
    w = warc.Writer(out, dictionary)
    for r in records:
        w.add(r)
    return out.getvalue()


RECORDS = [warc.page_record(i, f"http://x/{i} é", f"<p>{i}</p>".encode() * 50, warc.digest(f"<p>{i}</p>".encode() * 50), i, False) for i in range(300)]


def test_dictionary_leads():
    dictionary = warc.train([r for r in RECORDS for _ in range(20)], 2048)
    assert dictionary
    data = archive(RECORDS, dictionary)
    assert struct.unpack("<II", data[:8]) == (0x184D2A5D, len(dictionary))
    assert list(warc.frames(io.BytesIO(data))) == RECORDS
    packed = zstandard.compress(dictionary)
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + data[8 + len(dictionary) :]
    assert list(warc.frames(io.BytesIO(again))) == RECORDS
    skipped = data[: 8 + len(dictionary)] + struct.pack("<II", 0x184D2A51, 3) + b"abc" + data[8 + len(dictionary) :]
    assert list(warc.frames(io.BytesIO(skipped))) == RECORDS


def test_small_reads(monkeypatch):
    monkeypatch.setattr(warc, "READ", 5)
    assert list(warc.frames(io.BytesIO(archive(RECORDS[:20])))) == RECORDS[:20]


def test_bad_archives():
    data = archive(RECORDS[:3])
    for bad, error in ((b"", "no leading frame"), (data[8:], "not that of a dictionary"), (data[:-5], "cut short"), (data + b"junkjunk", "between frames"), (struct.pack("<II", 0x184D2A5D, 99) + b"x", "cut short")):
        with pytest.raises(ValueError, match=error):
            list(warc.frames(io.BytesIO(bad)))


@pytest.mark.parametrize("change,error", [((b"WARC/1.1", b"WARC/9.9"), "head"), ((b"Content-Length: ", b"Content-Length: 1"), "Content-Length"), ((b"WARC-Date", b"X-Date"), "warc-date"), ((b"<p>1<", b"<p>2<"), "digest"), ((b"X-Page-Id:", b"X-Page-Id"), "header|head")])
def test_bad_records(change, error):
    with pytest.raises(ValueError, match=error):
        warc.page(RECORDS[1].replace(*change, 1))


def test_slices_for_the_dictionary_have_a_bound(spark):
    pages = [(i, f"<p>{i}</p>" + "x" * 20_000) for i in range(400)] + [(7, "equal " * 3000)] * 3000
    own = spark.createDataFrame(pages, "page_id long, html string")
    got = [r.s for r in warc.drawn(own, len(pages), 200).collect()]
    assert 2 <= len(got) <= 300 and all(len(s) <= warc.SLICE for s in got)
    assert len(warc.drawn(own, len(pages), 10_000).collect()) == 401


def test_pages(spark):
    rows = [(i, f"http://p/{i}", f"<html>{i % 40}é</html>", "x") for i in range(200)] + [(500, None, None, "x"), (501, "u", "", "x"), (7, "http://p/7", "<html>7é</html>", "x"), (None, "n", "<i>only</i>", "x"), (900, "big", "z" * 3_000_000, "x")]
    rows += [(1000 + i, "hot", "hot", "x") for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string").repartition(6)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    best = {}
    for i, _, h, _ in rows:
        best[digest(h)] = max((x for x in (best.get(digest(h)), i) if x is not None), default=None)
    want = [(i, len((h or "").encode()), digest(h), "response" if best[digest(h)] == i else "revisit", None if best[digest(h)] == i else best[digest(h)]) for i, _, h, _ in rows]
    got = [tuple(x)[:5] for x in warc.archive_and_read(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_and_read(df.limit(0)).count() == 0
