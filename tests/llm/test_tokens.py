"""Token counts, token files and packing against the tokenizers library itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from release_guard.llm.packing import best_two_fit, encode_pieces, pack, piece_lengths, places, sequences
from release_guard.llm.token_files import (
    decode_codes, document_index, encode_codes, read_documents, token_at, tokens_at, write_token_files,
)
from release_guard.llm.tokens import PieceEncoder, id_bytes, token_counts

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_whole_texts(path, documents, odd_rows):
    texts = [t or "" for _, t in odd_rows + documents]
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", " ", "\n", "\t", ".", "'", "s", "1", "-", "<|endoftext|>", " ", "漢", "́", "ß"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)]
    encoder = PieceEncoder(path, id_bytes, b"".join)
    for _ in range(2):  # the second time from memory
        found = [np.frombuffer(b"".join(kept), "<u4").tolist() for kept in encoder.encode(texts)]
        assert found == library_ids(path, texts)


def test_token_counts(frame, documents, odd_rows):
    rows = odd_rows + documents
    found = token_counts(frame(rows), BYTE).select("doc_id", "text", "n_tokens").collect()
    expected = [(*row, len(ids)) for row, ids in zip(rows, library_ids(BYTE, [t for _, t in rows]), strict=True)]
    assert Counter(map(tuple, found)) == Counter(expected)
    assert token_counts(frame([]), BYTE).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for ids in ([], [0], [255], [256], [70000, 0, 2**32 - 1], rng.integers(0, 50000, 5000), rng.integers(0, 3, 1500)):
        ids = np.array(ids, np.uint32)
        levels, bitmaps, ranks = encode_codes(ids)
        assert decode_codes(levels, bitmaps).tolist() == ids.tolist()
        assert [token_at(levels, bitmaps, ranks, i) for i in range(len(ids))] == ids.tolist()


def test_token_files(spark, frame, documents, odd_rows, tmp_path):
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 1005] + documents
    path = str(tmp_path / "ids")
    write_token_files(frame(rows), path, WORD, end_id=1)
    rows.sort()
    ids = [[*x, 1] for x in library_ids(WORD, [t for _, t in rows])]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    found = sorted(map(tuple, document_index(spark, path).collect()))
    assert found == [(d, s, len(x), crc(x)) for (d, _), s, x in zip(rows, starts, ids, strict=False)]
    flat = [i for x in ids for i in x]
    wanted = [0, 1, len(flat) - 1, len(flat), -1, None, 5, 5, *range(100, 400, 7)]
    got = tokens_at(spark, path, spark.createDataFrame([(w,) for w in wanted], "place long")).collect()
    assert sorted(map(tuple, got)) == sorted({(w, flat[w]) for w in wanted if w is not None and 0 <= w < len(flat)})


def test_token_files_of_repeated_and_missing_ids(spark, frame, odd_rows, tmp_path):
    path = str(tmp_path / "ids")
    write_token_files(frame(odd_rows), path, WORD, end_id=1)
    found = document_index(spark, path).orderBy("start").collect()
    ids = [None if r["doc_id"] is None else r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d) and len(ids) == len(odd_rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == Counter(
        (d, crc([*x, 1])) for (d, _), x in zip(odd_rows, library_ids(WORD, [t for _, t in odd_rows]), strict=True)
    )
    empty = str(tmp_path / "none")
    write_token_files(frame([]), empty, WORD, end_id=1)
    assert read_documents(spark, empty).count() == 0 and document_index(spark, empty).count() == 0


def test_piece_lengths():
    assert piece_lengths(5, 8) == [5] and piece_lengths(8, 8) == [8] and piece_lengths(17, 8) == [1, 8, 8]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choices(range(1, 65), k=rng.choice([1, 10, 500, 3000])))
    bins = best_two_fit(counts, 64)
    assert all(sum(own) <= 64 for own, _ in bins)
    placed = Counter()
    for own, times in bins:
        for length in own:
            placed[length] += times
    assert placed == counts
    used = sum(times for _, times in bins)
    assert used <= 1.1 * -(-sum(k * n for k, n in counts.items()) // 64) + 1
    plan = places(bins)
    assert len(plan) == len({(r[0], r[1]) for r in plan.tolist()})


def test_smallest_piece_gives_way_to_a_tighter_pair():
    # Greedy takes 6 + 3 and leaves 1; 2 + 2 fill the gap of 4 the 3 leaves.
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pack(frame, documents, odd_rows, capacity):
    rows = [r for r in odd_rows if r[0] != 1005 and r[0] is not None] + documents
    ids = {d: [*x, 0] for (d, _), x in zip(rows, library_ids(BYTE, [t for _, t in rows]), strict=True)}
    packed = pack(encode_pieces(frame(rows), BYTE, 0, capacity, keep_ids=True), capacity)
    found = packed.collect()
    by_doc: dict = {}
    for r in sorted(found, key=lambda r: r["piece"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        assert [p["length"] for p in pieces] == piece_lengths(len(ids[doc]), capacity)
        for p in pieces:
            own = ids[doc][p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == crc(own)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in sequences(packed).collect()}
    for r in found:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert sum(map(len, whole.values())) == sum(map(len, ids.values())) and max(map(len, whole.values())) <= capacity
    assert len(whole) <= 1.02 * -(-sum(map(len, ids.values())) // capacity) + 1


def test_pack_repeated_rows_and_empty_tables(frame, odd_rows):
    found = pack(encode_pieces(frame(odd_rows), BYTE, 0, 64), 64).collect()
    places_used = {(r["sequence_id"], r["offset"]) for r in found}
    assert len(places_used) == len(found)
    assert Counter((r["doc_id"], r["piece"]) for r in found)[(1005, 0)] == 3
    assert pack(encode_pieces(frame([]), BYTE, 0, 64), 64).count() == 0


def test_what_a_worker_remembers_changes_no_id(frame):
    texts = ["one two, three.\nfour  five", "one two, three.", None, "Ünïted 12 x-ray; one", ""] * 3
    rows = list(enumerate(texts))
    whole = sorted(map(tuple, encode_pieces(frame(rows), BYTE, 0, 4, keep_ids=True).drop("block").collect()))
    few = encode_pieces(frame(rows), BYTE, 0, 4, keep_ids=True, remembered=(1, 1)).drop("block")
    assert sorted(map(tuple, few.collect())) == whole
