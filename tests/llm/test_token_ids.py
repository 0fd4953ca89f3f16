import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabwise.llm import token_ids
from tests.llm.conftest import clashing, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=600))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded, rest = token_ids.EliasFano.from_bytes(memoryview(token_ids.EliasFano.encode(np.array(values, np.int64)).to_bytes()))
    assert coded.all().tolist() == values and len(rest) == 0
    assert [coded.select(i) for i in range(len(values))] == values


def test_elias_fano_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    bits = 8 * len(token_ids.EliasFano.encode(ends).to_bytes()) / len(ends)
    assert bits < 2.1 + np.log2(ends[-1] / len(ends))


def test_file_round_trip_with_nulls_and_negative_ids():
    ids = np.array([1, 2, 70_000, 2, 2], np.uint32)
    named, ends, got = token_ids.unpack_file(token_ids.pack_file([None, -5, -5, 2**40], [1, 2, 1, 1], ids))
    assert named == [None, -5, -5, 2**40] and ends.all().tolist() == [1, 3, 4, 5] and got.tolist() == ids.tolist()


def test_remembered_words_give_the_library_ids():
    tokenizer, encode, rng = Tokenizer.from_file(PATH), token_ids.Encoder(PATH), random.Random(5)
    pool = ["Don't", "a\x1cb", "\x1c", "x y", "é", "́", "ΣΑΣ", "<|endoftext|>", "end<|endoftext|>ing", "12:30",
            " ", "　", "ﬁ", "İ", "\x00", "word", "!!", "'", "\x85", "s", "'s"]
    for _ in range(500):
        text = "".join(rng.choice(pool) + rng.choice([" ", "", "\n", " \t "]) for _ in range(rng.randint(0, 12)))
        assert encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_characters_side_by_side_give_the_library_ids():
    tokenizer, encode = Tokenizer.from_file(PATH), token_ids.Encoder(PATH)
    plain = [chr(c) for c in range(token_ids.PLAIN + 8)]
    texts = [f"{a}{b}" for a in plain for b in plain] + [f"{a}'{b}{c}" for a in "a.1'" for b in plain for c in "Sé' "]
    codes = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in encode(texts)] == [code.ids for code in codes]


def test_new_words_of_known_pieces_are_not_merged_again():
    encode, merged = token_ids.Encoder(PATH), []
    look_up = encode.pieces.look_up
    encode.pieces.look_up = lambda pieces: merged.extend(pieces) or look_up(pieces)
    encode(["Wherever, only (there) 12", "only, wherever! There 21"])
    encode(["THERE! (only) there, Wherever 1212", None, "", " only(wherever) "])
    assert sorted(merged) == sorted({"wherever", ",", "only", "(", "there", ")", "1", "2", "!"})


@pytest.mark.parametrize("words, pieces", [(3, 2), (0, 0), (50, 0)])
def test_full_memories_change_no_ids(monkeypatch, words, pieces):
    monkeypatch.setattr(token_ids, "REMEMBERED", words)
    monkeypatch.setattr(token_ids, "REMEMBERED_PIECES", pieces)
    tokenizer, encode, rng = Tokenizer.from_file(PATH), token_ids.Encoder(PATH), random.Random(3)
    pool = ["a", "Bé,", "x\u0301y", "don't", "..", "漢字", "42"]
    for _ in range(30):
        texts = [" ".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(4)]
        assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encode.words.numbers) <= words and len(encode.pieces.numbers) <= pieces


def test_long_words_are_not_remembered():
    tokenizer, encode = Tokenizer.from_file(PATH), token_ids.Encoder(PATH)
    texts = [f"short{'abc' * 5000}{k} word, {'+/' * 40} short" for k in range(20)]
    for _ in range(2):
        assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for memory in (encode.words, encode.pieces):
        assert 0 < sum(map(len, memory.numbers)) < 200
        assert len(memory.ends) == len(memory.numbers) + 1 and memory.ends[-1] == len(memory.ids)


IDLE = """
import re, sys
from tabwise.llm import token_ids
from tabwise.llm.common import give_back

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

encode = token_ids.Encoder(sys.argv[1])
before, letters = held(), "abcdefghijklmnopqrst"
for k in range(20):
    encode([" ".join("".join(letters[(n // 20**p) % 20] for p in range(5)) for n in range(k * 25_000, (k + 1) * 25_000))])
give_back()
print(held() - before)
"""


def test_an_idle_worker_holds_little():
    """Half a million different words of as many pieces; a worker stays beside the JVM of the stages that follow."""
    root = Path(token_ids.__file__).parents[2]
    said = subprocess.run([sys.executable, "-c", IDLE, PATH], cwd=root, capture_output=True, text=True, timeout=300)
    assert float(said.stdout) < 100, said.stderr


def test_slices_hold_every_row_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_ids, "TEXT_BYTES", 10)
    texts = ["", None, "a" * 25, "b" * 4, None, "c" * 4, "d" * 3]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = list(token_ids.slices(batch))
    assert len(parts) > 2 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert sum(p.num_rows for p in token_ids.slices(batch.slice(0, 0))) == 0


@pytest.mark.parametrize("file_ids", [token_ids.FILE_IDS, 50])
def test_files_match_direct_encoding(spark, docs, file_ids):
    from tabwise.llm.common import new_folder

    folder = new_folder(spark, "tokens")
    files = token_ids.write(clashing(docs), folder, PATH, file_ids=file_ids)
    got = sorted(map(tuple, token_ids.read(folder, files).collect()), key=lambda r: r[1])
    tokenizer, want, start = Tokenizer.from_file(PATH), [], 0
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(no_docs):
    assert token_ids.report(no_docs, PATH).collect() == []
