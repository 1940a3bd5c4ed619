"""Texts of an Arrow batch go through Python few at a time."""

import pyarrow as pa

from tidemark.functions import text as X


class Slices:
    """An Arrow array that notes how many values are asked for at once."""

    def __init__(self, values):
        self.values, self.asked = pa.array(values, pa.string()), []

    def __len__(self):
        return len(self.values)

    def __getitem__(self, key):
        got = self.values[key]
        self.asked.append(len(got))
        return got


def check(udf, f):
    a = Slices([None if i % 7 == 0 else f"Größe {i}" for i in range(300)])
    got = udf.func(a)
    assert max(a.asked) <= 64 and sum(a.asked) == 300
    assert got.to_pylist() == [None if v is None else f(v) for v in a.values.to_pylist()]
    assert udf.func(pa.array([], pa.string())).to_pylist() == []


def test_folding_holds_few_texts():
    check(X.normalise, X.fold)


def test_redaction_holds_few_texts():
    from tidemark.functions import redact as R

    check(R.redacted, R.redact)
    check(R.masked_json, lambda t: R.each_string(t, R.mask))
