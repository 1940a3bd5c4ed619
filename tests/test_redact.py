import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import redact as R

AWS = "AKIA" + "A1B2C3D4E5F6G7H8"


@pytest.mark.parametrize(
    "raw",
    ['{"a": "bob@example.org"}', r'{"a": "said \"hi\", mail bob@example.org"}', r'{"a":"x\":bob@example.org"}', '["bob@example.org" ,\n{"b":{"c":[["bob@example.org"]]}}]', '"bob@example.org"', r'{"u":"bob\u0040example.org"}', '{"a": "bob@example.org"', 'no json: bob@example.org "'],
)
def test_no_address_is_left_in_json(raw):
    out = R.each_string(raw, R.mask)
    assert "[email]" in out and "example.org" not in out
    if raw.count("{") == raw.count("}") and raw[:2] != "no":
        assert json.dumps(json.loads(out)).count("[email]") == 1 + raw.count("bob", raw.find("bob") + 1)


def test_shape_keys_and_numbers_stay():
    raw = '{ "a@b.org" : 1.50 , "n":1e400, "big": 123456789012345678901234567890, "s":"\\u00e9 \\n", "t":[true,null,-0] }'
    assert R.each_string(raw, R.mask) == raw
    assert R.each_string('{"k":"' + "\\n" * 100_000 + 'a@b.org"}', R.mask).endswith('[email]"}')


def test_placeholders_are_stable_and_never_nest():
    a = R.redact(f"one {AWS}, again {AWS} and password = {AWS}")
    mark = R.placeholder("aws_key", AWS)
    assert a == f"one {mark}, again {mark} and password = {mark}"
    assert R.redact(a) == a and R.redact("token: " + mark) == "token: " + mark


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Authorization: Bearer abcdef0123456789XYZ", "bearer"), ("postgres://me:s3cr3t@host/db", "dsn_password"), ('"api_key": "abcd1234efgh"', "assignment"), ("ghp_" + "a1" * 18, "github_token"), ("sk-ant-" + "x9" * 15, "model_key"), ("xoxb-1234567890-abc", "slack_token"), ("eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "jwt"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("-----BEGIN RSA PRIVATE KEY-----\nabc\n", "private_key"), ("sk_live_" + "a1" * 10, "stripe_key"), ("AIza" + "b2" * 18, "google_key")],
)
def test_each_kind(text, kind):
    assert f"⟦{kind}:" in R.redact(text) and R.redact(text).count("⟦") == 1


@pytest.mark.parametrize("text", ["password: required", "password = ${DB_PASSWORD}", "token: env:TOKEN_NAME_1", "secret is /etc/keys/file1", "GB82 WEST 1234 5698 7654 33", "", "the pass was open", "DE00 0000 0000 0000 0000 00"])
def test_what_is_no_secret_stays(text):
    assert R.redact(text) == text


def test_columns_with_nulls(spark):
    d = spark.createDataFrame([(f'{{"a": "{AWS}"}}',), (None,), ("",)], "t string").select(R.redacted_json("t").alias("a"), R.redacted("t").alias("b"), R.masked_json(F.col("t")).alias("c"))
    mark = R.placeholder("aws_key", AWS)
    assert [tuple(x) for x in d.collect()] == [(f'{{"a": "{mark}"}}', f'{{"a": "{mark}"}}', '{"a": "[aws-key]"}'), (None, None, None), ("", "", "")]
