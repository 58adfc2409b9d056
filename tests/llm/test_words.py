import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlens.llm import words
from ticketlens.llm.tables import HashTable

from .brute import words as plain

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab \n\t\x0b\x1cé日 "), max_size=30)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 20))
def test_words_are_runs_without_ascii_white_space(some, size):
    batch = pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["text"])
    found = []
    for part in words.chunks(batch, "text", size=size):
        data = part.data.tobytes()
        every = [data[a:b].decode() for a, b in zip(part.start, part.end, strict=True)]
        assert [words.word_hash(w.encode()) for w in every] == part.hash.tolist()
        found += [every[a:b] for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
    assert found == [plain(t) for t in some]


def test_sequences_hash_alike_wherever_they_stand():
    h = np.array([5, 7, 9, 1, 5, 7, 9, 2], np.uint64)
    three = words.sequence_hashes(h, 3)
    assert three[0] == three[4] and len(set(three.tolist())) == 5
    assert len(words.sequence_hashes(h, 9)) == 0
    ends = words.stretch_hashes(h, np.array([0, 4, 0]), np.array([3, 3, 4]))
    assert ends[0] == ends[1] != ends[2]


def test_regular_words_and_sequences_do_not_meet():
    """Thue-Morse sequences, on which sums of powers modulo 2**64 agree."""
    turns = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = (bytes(97 + (t ^ flip) for t in turns) for flip in (0, 1))
    assert words.word_hash(one) != words.word_hash(other)
    many = np.array([(5, 7)[t] for t in turns] + [(7, 5)[t] for t in turns], np.uint64)
    ends = words.sequence_hashes(many, 1024)
    assert len(set(ends.tolist())) == 1025
    assert words.stretch_hashes(many, np.array([0, 3]), np.array([1024, 1024])).tolist() == ends[[0, 3]].tolist()


def test_lower_case_is_ascii_only():
    batch = pa.RecordBatch.from_arrays([pa.array(["AÉ aÉ"])], ["text"])
    (part,) = words.chunks(batch, "text", lower=True)
    assert part.hash[0] == part.hash[1] == words.word_hash("aÉ".encode())


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_lookup(keys, others):
    keys = np.array(sorted(keys), np.uint64)
    table = HashTable.of(keys[::-1], np.arange(len(keys))[::-1])
    wanted = np.concatenate([keys, np.array(others, np.uint64)])
    row, found = table.find(wanted)
    assert found.tolist() == [w in set(keys.tolist()) for w in wanted.tolist()]
    assert table.keys[row[found]].tolist() == wanted[found].tolist()
