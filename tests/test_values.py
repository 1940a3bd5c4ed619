import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import jsons, meter


@pytest.mark.parametrize(
    ("target", "patch", "want"),
    [  # the examples of the standard
        ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":"b","b":"c"}', '{"a":null}', '{"b":"c"}'), ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'),
        ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'), ('["a","b"]', '["c","d"]', '["c","d"]'), ('{"a":"b"}', '["c"]', '["c"]'), ('{"a":"foo"}', "null", "null"),
        ('{"a":"foo"}', '"bar"', '"bar"'), ('{"e":null}', '{"a":1}', '{"a":1,"e":null}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'),
    ],
)
def test_merge_patches(target, patch, want):
    assert jsons.canonical(jsons.merge(jsons.parse(target), jsons.parse(patch))) == want


def test_canonical_text_and_odd_values(spark):
    assert jsons.canonical(jsons.parse('{ "b":[ 1.50, 1e3, {"z":1,"a":"é\\n"}], "a":12345678901234567890 }')) == '{"a":12345678901234567890,"b":[1.50,1e3,{"a":"é\\n","z":1}]}'
    d = spark.createDataFrame([('{"b":1,"a":[{"b":2,"c":3}]}', "{}"), (None, "{}"), ("no json", "{}"), ("[" * 100_000, "1"), ("", None)], "v string, p string")
    got = [tuple(r) for r in d.select(jsons.canonical_text("v"), jsons.merged_text("v", "p"), jsons.without_keys("b")("v")).collect()]
    assert got == [('{"a":[{"b":2,"c":3}],"b":1}', '{"a":[{"b":2,"c":3}],"b":1}', '{"a":[{"c":3}]}')] + [(None, None, None)] * 4


def test_meter_against_the_library(spark):
    from tokenizers import Tokenizer

    path = meter.vocabulary()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    r = random.Random(2)
    texts = ["", "a", "<|endoftext|>", "日本語 and 🙂🙂🙂 text"] + ["".join(r.choice("ab éß🙂\n日.") for _ in range(r.randrange(200))) for _ in range(40)]
    n = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, t string")
    got = sorted(d.select("i", meter.counted(F.col("t")).alias("n"), meter.headed(F.col("t"), 9).alias("h"), meter.token_offsets(F.col("t")).alias("o")).collect())
    assert [x.n for x in got] == [*n, None] and got[-1].h.text is None and got[-1].o is None
    for x, text, k in zip(got, texts, n):
        assert x.h.tokens == k == len(x.o) and x.h.cut == (k > 9) and text.startswith(x.h.text)
        assert len(t.encode(x.h.text, add_special_tokens=False).ids) <= 9 and (x.h.cut or x.h.text == text)
