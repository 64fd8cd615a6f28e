"""What the training-data operators hold or call at once."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from vigil.llm import bpe, lm_scoring

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


class OneTask:
    @staticmethod
    def get():
        return OneTask

    @staticmethod
    def partitionId():
        return 3


def batches_of_texts(texts, folds, rows):
    schema = pa.schema([("did", pa.int64()), ("fold", pa.int32()), ("text", pa.string())])
    for at in range(0, len(texts), rows):
        part = slice(at, at + rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((range(at, at + len(texts[part])), folds[part], texts[part]), schema, strict=True)], schema=schema)


@pytest.mark.parametrize("limit", [1, 40, 1000, 4 << 20])
def test_units_do_not_depend_on_the_batches(monkeypatch, limit):
    monkeypatch.setattr(lm_scoring, "TaskContext", OneTask)
    monkeypatch.setattr(lm_scoring, "UNIT_BYTES", limit)
    texts = [" ".join(f"w{k % 7}" for k in range(n % 11)) for n in range(100)]
    folds = [lm_scoring.DELETED if n % 7 == 3 else lm_scoring.TRAIN for n in range(100)]
    made = []
    for rows in (1, 9, 100):
        units = [u.to_pylist()[0] for u in lm_scoring.unit_rows(batches_of_texts(texts, folds, rows))]
        numbers = [u.pop("unit") for u in units]
        assert len(set(numbers)) == len(numbers) and all(n >> 32 == 3 for n in numbers)
        for number, unit in zip(numbers, units, strict=True):
            kinds = np.frombuffer(unit["folds"], np.int8) == lm_scoring.DELETED
            assert (kinds == number % 2).all()
            dids = np.frombuffer(unit["dids"], np.int64)
            assert unit["tokens"] == sum(len(texts[d].split()) + 1 for d in dids)
            assert len(dids) == 1 or sum(len(texts[d]) for d in dids) <= limit
        made.append(sorted(units, key=lambda u: np.frombuffer(u["dids"], np.int64)[0]))
    assert made[0] == made[1] == made[2]
    assert sorted(d for u in made[0] for d in np.frombuffer(u["dids"], np.int64)) == list(range(100))
    if limit == 4 << 20:
        assert len(made[0]) == 2


class Counting:
    def __init__(self, merging):
        self.merging, self.calls = merging, 0

    def encode_ordinary(self, text):
        self.calls += 1
        return self.merging.encode_ordinary(text)


@pytest.mark.parametrize("between", [" ", "  \n x "])
def test_distinct_words_are_encoded_in_one_call(between):
    own, text = bpe.Codec(VOCABULARY), between.join(f"word{k}x{k * k}" for k in range(500))
    own.merging = Counting(own.merging)
    assert own.encode_plain(text) == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert own.merging.calls == 1
