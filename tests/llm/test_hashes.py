"""Word hashes without known collisions, and models that fail when files are lost."""

import os

import numpy as np
import pytest

from impressa.llm import jaccard, kneser_ney
from impressa.llm.text import word_hash


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_hash_of_each_length_and_place():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 60_000).astype(np.uint8)
    start = rng.integers(0, 59_900, 4000)
    end = start + rng.integers(1, 100, 4000)
    got = {}
    for a, b, h in zip(start, end, word_hash(data, start, end).tolist(), strict=True):
        assert got.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(got.values())) == len(got)
    other = np.concatenate([rng.integers(97, 99, 5).astype(np.uint8), data])
    assert (word_hash(data, start, end) == word_hash(other, start + 5, end + 5)).all()
    assert len(word_hash(data, start[:0], end[:0])) == 0


def test_words_that_collide_under_polynomials(spark):
    one, two = thue_morse(2048)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one}")], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.classes(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    path, meta = kneser_ney.train(docs.where("doc_id = 1").union(docs.limit(0)), 2, 0)
    model = kneser_ney.Model(path, meta)
    ends = np.array([0, 2048, 4096])
    ids = np.maximum(word_hash(np.frombuffer((one + two).encode(), np.uint8), ends[:-1], ends[1:]) & kneser_ney._ID, np.uint64(3 << 16))
    assert model.words(ids)[:, 1].tolist() == [1, 0]


def test_unseen_words_are_never_known(spark):
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in range(60_000)),)], "text string")
    path, meta = kneser_ney.train(docs, 2, 0)
    unseen = np.random.default_rng(1).integers(1 << 20, 1 << 63, 3_000_000).astype(np.uint64) & kneser_ney._ID
    assert not kneser_ney.Model(path, meta).words(unseen).any()


@pytest.mark.parametrize("kind", ["words", "grams"])
def test_a_lost_file_is_an_error(spark, kind):
    docs = spark.createDataFrame([(i, f"a b c d{i} e f {i}") for i in range(50)], "doc_id long, text string")
    path, meta = kneser_ney.train(docs, 3, 0)
    assert set(meta["files"]) == set(os.listdir(path))
    ids = np.array([1 << 16, 1 << 16, 5 << 16], np.uint64)
    lost = next(n for n in meta["files"] if n.startswith(kind))
    os.rename(f"{path}/{lost}", f"{path}/.{lost}")
    with pytest.raises(FileNotFoundError, match="missing"):
        kneser_ney.Model(path, meta)._arrays(lost)
    os.rename(f"{path}/.{lost}", f"{path}/{lost}")
    assert len(kneser_ney.Model(path, meta).probability(ids, np.array([2]))) == 1
