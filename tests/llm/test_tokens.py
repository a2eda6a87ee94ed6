import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wanderframe.llm import flatfiles, order
from wanderframe.llm.common import stored, work_dir

PATH, PATTERN, END = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256
TEXTS = [None, "", "a", "Hello there, general.", "é ß 日本語 😀", "word " * 3000, "x" * 6000, "\n\n  \t", "https://" + "abcdefgh" * 4000]


ODD = "abcdefgh" * 12_500
LONG = ["https://" + ODD, ODD + " " + ODD, "日本語のテキスト" * 8000, "1 22 333 " * 15_000, "one\nword\na\nline\n" * 9000, "  x" + " " * 9000 + "y" + "\n" * 5000, " " * 300_000 + "end", "\u3000" * 5000 + " z"]


@pytest.fixture(scope="module")
def library():
    """The tokenizer itself, without anything of the package."""
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("tests", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(library, t):
    return library.encode_ordinary(t) if t else []


def split(ids, end):
    want, at = [], 0
    for i, x in enumerate(ids):
        if x == end:
            want.append((at, i - at, True))
            at = i + 1
    return want + [(at, len(ids) - at, False)] * (at < len(ids))


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_scan_equals_split(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(flatfiles, "CHUNK", 3)
    rng = np.random.default_rng(block)
    want = []
    for n in (0, 1, 5, 50, 200):
        ids = rng.integers(0, 4, n).astype("<u2")
        (tmp_path / f"f{n}.bin").write_bytes(ids.tobytes() + b"x" * (n == 50))
        want += [(f"f{n}.bin", k, *x) for k, x in enumerate(split(ids.tolist(), 3))]
    got = flatfiles.scan_flat(spark, f"file://{tmp_path}", 3, block).collect()
    assert sorted((r.file, r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == sorted(want)


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file that no array of the JVM can hold; its separators lie far apart."""
    places = [5, 1_000_000_000, 1_150_000_000]
    with open(tmp_path / "big.bin", "wb") as f:
        for p in places:
            f.seek(2 * p)
            f.write(np.array([7], "<u2").tobytes())
        f.truncate(2 * 1_200_000_000)
    got = flatfiles.scan_flat(spark, f"file://{tmp_path}", 7, 1 << 25).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in got] == [(0, 5, True), (6, 999_999_994, True), (1_000_000_001, 149_999_999, True), (1_150_000_001, 49_999_999, False)]


def test_round_trip_through_flat_files(spark, docs_of, library):
    pairs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    folder = work_dir(spark, "flat")
    written = stored(flatfiles.write_flat(docs_of(pairs), folder, PATH, PATTERN, END))
    got = flatfiles.scan_flat(spark, folder, END, block=50).join(written, ["file", "ordinal"])
    want = sorted((str(i), len(ids_of(library, t))) for i, t in pairs)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == want


def test_flat_files_hold_the_tokens_ids(spark, docs_of, library):
    pairs = list(enumerate(TEXTS))
    folder = work_dir(spark, "flat")
    file = stored(flatfiles.write_flat(docs_of(pairs).coalesce(1), folder, PATH, PATTERN, END)).first().file
    where, at = flatfiles.filesystem(folder)
    assert np.frombuffer(where.open_input_stream(f"{at}/{file}").read(), "<u2").tolist() == [x for _, t in pairs for x in [*ids_of(library, t), END]]


def test_empty_table(spark, docs_of):
    folder = work_dir(spark, "flat")
    assert stored(flatfiles.write_flat(docs_of([]), folder, PATH, PATTERN, END)).count() == 0
    assert flatfiles.scan_flat(spark, folder, END).count() == 0


def test_files_that_go_on(spark, tmp_path):
    parts = [[1, 2, 9], [3], [4, 5], [6, 9, 7], [9, 8]]
    for i, p in enumerate(parts):
        (tmp_path / f"p{i}.bin").write_bytes(np.array(p, "<u2").tobytes())
    got = flatfiles.scan_flat(spark, f"file://{tmp_path}", 9, 2, joined=True).orderBy("file", "ordinal").collect()
    assert [(r.file, r.n_tokens, r.ended) for r in got] == [("p0.bin", 2, True), ("p3.bin", 4, True), ("p4.bin", 1, True), ("p4.bin", 1, False)]


@pytest.mark.parametrize("text", LONG)
def test_long_texts_encode_as_whole_ones(library, text):
    enc = flatfiles.encoder(PATH, PATTERN)
    assert flatfiles.token_ids(enc, text).tolist() == library.encode_ordinary(text)


def test_blanks_beyond_the_encoders_stack():
    enc = flatfiles.encoder(PATH, PATTERN)
    ids = flatfiles.token_ids(enc, "a" + " " * 3_000_000 + "b").tolist()
    assert enc.decode(ids) == "a" + " " * 3_000_000 + "b" and ids[-1] == enc.encode_ordinary(" b")[0]


def test_permutation():
    for n in (1, 2, 3, 10, 255, 1000, 4097):
        p = order.permutation(n, "k")(np.arange(n))
        assert sorted(p.tolist()) == list(range(n))
    a, b = order.permutation(1000, "k")(np.arange(1000)), order.permutation(1000, "l")(np.arange(1000))
    assert (a != b).any() and (a != np.arange(1000)).sum() > 900


def test_shards_hold_every_sequence_in_its_slot(spark, docs_of, library):
    pairs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    seqs = order.sequences(docs_of(pairs), PATH, PATTERN, END, length=16)
    uri = work_dir(spark, "shards")
    rows = order.materialise(seqs, uri, "key", 0, length=16, shard=8).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n))
    assert all(r.byte_offset == r.slot % 8 * 32 and r.shard == r.slot // 8 for r in rows)
    flat = order.read_slots(uri, 0, n, length=16, shard=8)
    assert flat.shape == (n, 16) and (order.read_slots(uri, 5, 9, 16, 8) == flat[5:14]).all()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, flat[r.slot][: r.n_tokens].tolist()))
    for i, t in pairs:
        if i != 3:
            ids = [x for _, p in sorted(by_doc[i]) for x in p]
            assert ids == ids_of(library, t) + [END]
    assert order.materialise(order.sequences(docs_of([]), PATH, PATTERN, END), work_dir(spark, "none"), "k", 0).count() == 0


@pytest.mark.parametrize("length", [1, 7, 16, 5000])
def test_packed_sequences_lose_nothing(spark, docs_of, library, length):
    pairs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    rows = order.packed_sequences(docs_of(pairs).coalesce(1), PATH, PATTERN, END, length).collect()
    each = [(i, ids_of(library, t) + [END]) for i, t in pairs]
    flat = [x for _, ids in each for x in ids]
    got = [np.frombuffer(bytes(r.tokens), "<u2").tolist() for r in rows]
    assert [x for g in got for x in g] == flat and all(len(g) == length for g in got[:-1])
    owner = [k for k, (_, ids) in enumerate(each) for _ in ids]
    for n, r in enumerate(rows):
        ks = sorted(set(owner[n * length : (n + 1) * length]))
        assert r.doc_ids == [each[k][0] for k in ks]


def test_packed_shards(spark, docs_of, library):
    pairs = list(enumerate(TEXTS))
    uri = work_dir(spark, "packed")
    seqs = order.packed_sequences(docs_of(pairs), PATH, PATTERN, END, 32)
    rows = order.materialise(seqs, uri, "key", END, 32, 16).collect()
    flat = order.read_slots(uri, 0, len(rows), 32, 16)
    assert sum(r.n_tokens for r in rows) == sum(len(ids_of(library, t)) + 1 for _, t in pairs)
    assert flat.shape == (len(rows), 32) and {i for r in rows for i in r.doc_ids} == set(range(len(TEXTS)))
