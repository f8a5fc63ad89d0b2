import random
import zlib

import numpy as np
import pytest
from conftest import ROWS

from grove.llm import bpe
from grove.llm.packing import pack_documents, sum_of_squares, token_pieces
from grove.llm.tokens import count_tokens, vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def texts():
    rng = random.Random(3)
    odd = ["it's we're they'll 'x 'r 'v ''s 'l  foo\n\n bar \n x  ", "a" * 3000, " " * 500 + "x", "don't've 'S 're", "\n\n\nfoo \t bar", "", "😀 ñé漢字 １２ ½²", "b\xa0c　d \x1c\x1d x\x85y", "<|endoftext|>", "a <|endoftext|>b"]
    odd += ["".join(rng.choice("a'sretvlmd \n\t1é漢😀-_.   ") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return odd + ["".join(rng.choice(["th", "in", "er", "an", " the", "ing", " re"]) for _ in range(300)) for _ in range(50)]


def test_counts_are_the_librarys(spark, library):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    found = {r.doc_id: r for r in count_tokens(df).collect()}
    for i, t in enumerate(texts()):
        assert found[i].n_tokens == len(library.encode(t, add_special_tokens=False).ids), t
        assert found[i].n_bytes == len(t.encode())
        assert found[i].over_limit == (found[i].n_tokens > 512)


def test_chunk_maps_compose_to_one_run(monkeypatch):
    """Chunks of any size give the marks of one run from the start."""
    classes = np.array([random.Random(5).randrange(12) for _ in range(5000)], np.uint8)
    state, plain = bpe.START, np.zeros(len(classes), bool)
    for i, c in enumerate(classes.tolist()):
        state, marks = bpe._step(state, c)
        plain[i] = bool(marks & bpe.HERE)
        if i and marks & bpe.BEFORE:
            plain[i - 1] = True
    for chunk in (1, 7, 256, 8192):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        assert (bpe._marks(classes) == plain).all()


def test_odd_tables(odd, none, library):
    counts = sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(odd).collect())
    assert counts == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS)
    assert count_tokens(none).count() == 0
    assert pack_documents(none).count() == 0


def test_pieces_and_sequences(odd, library):
    rows = [r.asDict() for r in pack_documents(odd, with_ids=True, capacity=512).collect()]
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in ROWS}
    places: dict = {}
    for r in rows:
        assert r["ids"] == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == 512 or r["piece"] == 0
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(whole[i]) for i, _, _ in ROWS)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 512
    assert len(places) <= -(-sum(r["length"] for r in rows) // 512) + 1


def test_only_longer_documents_are_cut(spark):
    df = spark.createDataFrame([(1, " a" * 2047), (2, " a" * 2048), (3, " a" * 5000)], "doc_id long, text string")
    found = sorted((r.doc_id, r.piece, r.start, r.length) for r in token_pieces(df).collect())
    assert found == [(1, 0, 0, 2048), (2, 0, 0, 1), (2, 1, 1, 2048), (3, 0, 0, 905), (3, 1, 905, 2048), (3, 2, 2953, 2048)]


def test_sum_of_squares_is_the_rule():
    """Each item's bin is one of least sum of squared counts of open bins by gap."""
    lengths = np.sort(np.random.default_rng(2).integers(1, 41, 400))[::-1]
    bins, offsets = sum_of_squares(lengths, 40)
    used: dict = {}
    squares = lambda: sum(v * v for v in np.unique([40 - u for u in used.values() if u < 40], return_counts=True)[1].tolist())
    for size, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        options = {}
        for o, u in list(used.items()):
            if u + size <= 40:
                used[o] = u + size
                options[o] = squares()
                used[o] = u
        assert (b in options and options[b] == min(options.values())) if options else b not in used
        assert used.get(b, 0) == at
        used[b] = at + size
    # No packing can have fewer bins: for each size k, large pieces need bins of their own and
    # what of the sizes k to 20 doesn't fit beside them needs more.
    large = [lengths[(lengths > 20) & (lengths <= 40 - k)] for k in range(21)]
    rest = [lengths[(lengths >= k) & (lengths <= 20)].sum() - (40 * len(x) - x.sum()) for k, x in enumerate(large)]
    assert len(used) == max((lengths > 40 - k).sum() + len(x) + max(0, -(-r // 40)) for k, (x, r) in enumerate(zip(large, rest, strict=True)))


def thue_morse(zero: str, one: str, n: int) -> str:
    return "".join(one if i.bit_count() % 2 else zero for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark, library):
    """Thue-Morse words and their opposites agree under every polynomial hash modulo 2^64."""
    own = [thue_morse(*pair, n) for n in (1024, 2048, 4096) for pair in ("ab", "ba", "iq", "qi")]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1)
    whole = [library.encode(t, add_special_tokens=False).ids for t in own]
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(x) for i, x in enumerate(whole)}
    found: dict = {}
    for r in sorted(token_pieces(df, with_ids=True).collect(), key=lambda r: r.start):
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == {i: [*x, 0] for i, x in enumerate(whole)}


def test_texts_of_several_slices(spark, library):
    """Texts longer than a slice, with and without places to cut at, among short ones."""
    rng = random.Random(4)
    words = ["it's", "12 345", "\n\n  x", "ñandú", "漢字漢字", "  ", "don't've", "　", "...", "a\tb"]
    long = " ".join(rng.choice(words) for _ in range(250_000))
    own = ["short", long, "漢字" * 60_000, "", "tail it's", "é" * 200_000 + " x", long[:1000] + "<|endoftext|>" + long[:700_000]]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1)
    whole = [library.encode(t, add_special_tokens=False).ids for t in own]
    assert len(long.encode()) > 1 << 20
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(x) for i, x in enumerate(whole)}
    found: dict = {}
    for r in sorted(token_pieces(df, with_ids=True).collect(), key=lambda r: r.start):
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == {i: [*x, 0] for i, x in enumerate(whole)}


def test_what_is_forgotten_changes_nothing(library, monkeypatch):
    own = [t.encode() for t in texts() if "<|endoftext|>" not in t]
    lengths = np.array([len(t) for t in own])
    monkeypatch.setattr(bpe.Compiled, "WORDS", 500)
    monkeypatch.setattr(bpe.Compiled, "STATES_KEPT", 50)
    monkeypatch.setattr(bpe.Ids, "WORDS", 500)
    counts, ids = bpe.Compiled(vocabulary()), bpe.Ids(vocabulary())
    for _ in range(2):
        for t, n in zip(own, lengths, strict=True):
            if n:
                words, _ = bpe.split(t, np.array([n]))
                want = library.encode(t.decode(), add_special_tokens=False).ids
                assert sum(counts.known(words)) == len(want)
                assert np.frombuffer(b"".join(ids.known(words)), "<u4").tolist() == want
